"""Mixing of sources to target weights.

Every row gets a random key (a seeded hash of its id), rows are range-sorted by it within their source, and distributed
prefix sums of the token counts tell how many tokens of its source come before each row. A source's budget is its target
share of the total. It is met by whole epochs over the source and a last, partial epoch that is cut in the random order
where the budget is reached; ``max_repeats`` bounds the epochs. Sources that cannot reach their budget give all they may;
that is how they are told: they stay below it with no row left that could be repeated once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelode.llm.prefix import prefix_sums
from farelode.tables import clean_id


def source_budgets(df: DataFrame, source: str, tokens: Column, targets: DataFrame) -> DataFrame:
    """Per listed source: ``source`` as listed, ``source_key``, ``target_share``, ``max_repeats``, ``available_tokens``,
    ``total_tokens`` (of all rows with a listed source, each once) and ``budget``.

    Sources are compared without surrounding white space and case. A source listed twice has the sum of its shares and
    the lower ``max_repeats``. Rows of unlisted or null sources count nowhere; a listed source without rows has 0 tokens.
    Token sums are folded before the shuffle, so a hot source costs no more than others.
    """
    listed = (
        targets.select(clean_id(F.col("source")).alias("source_key"), F.trim("source").alias("source"), "target_share", "max_repeats")
        .where("source_key IS NOT NULL")
        .groupBy("source_key")
        .agg(F.min("source").alias("source"), F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    held = df.select(clean_id(F.col(source)).alias("_key"), tokens.cast("bigint").alias("_tokens")).groupBy("_key").agg(F.sum("_tokens").alias("_sum"))
    both = listed.join(held, F.col("source_key") == F.col("_key"), "left").withColumn("available_tokens", F.coalesce("_sum", F.lit(0).cast("bigint"))).drop("_key", "_sum")
    total = both.agg(F.coalesce(F.sum("available_tokens"), F.lit(0)).alias("total_tokens"))
    return (
        both.crossJoin(total)  # one row
        .withColumn("budget", F.col("target_share") * F.col("total_tokens"))
    )


def random_key(key: str, seed: int) -> Column:
    """The random place of a row: 60 bits of the MD5 of its id and the seed, which SQL engines compute alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")


def place_rows(df: DataFrame, key: str, source: str, tokens: Column, budgets: DataFrame, seed: int = 42) -> DataFrame:
    """All rows of listed sources with the repeats that the budgets give them: ``key``, ``source``, ``tokens``, ``max_repeats``,
    ``repeats`` (from 0).

    Rows are never cut; the last partial epoch ends with the row that brings the source closest to its budget. Rows with
    null tokens, or of null or unlisted sources, have no place; repeated keys are rows of their own. The places depend on
    the seed and the keys alone. ``budgets`` are few rows, one per listed source.
    """
    rows = df.select(F.col(key).alias(key), clean_id(F.col(source)).alias("_key"), tokens.cast("bigint").alias("tokens")).where("tokens IS NOT NULL AND _key IS NOT NULL")
    wanted = budgets.select(F.col("source_key"), "source", "max_repeats", "available_tokens", "budget")
    listed = rows.join(wanted.select("source_key"), F.col("_key") == F.col("source_key"), "left_semi")
    ordered = prefix_sums(listed.withColumn("_random", random_key(key, seed)), "_key", ["_random", key], "tokens")
    full = F.least(F.floor(F.col("budget") / F.col("available_tokens")), F.col("max_repeats")).cast("int")
    rest = F.col("budget") - F.col("_full") * F.col("available_tokens")
    part = (F.col("_full") < F.col("max_repeats")) & (F.col("before") + F.col("tokens") / 2 <= rest)
    return (
        ordered.join(wanted, F.col("_key") == F.col("source_key"))
        .withColumn("_full", F.when(F.col("available_tokens") > 0, full).otherwise(0))
        .withColumn("repeats", F.col("_full") + part.cast("int"))
        .select(key, "source", "tokens", "max_repeats", "repeats")
    )


def mix_sources(df: DataFrame, key: str, source: str, tokens: Column, targets: DataFrame, seed: int = 42) -> DataFrame:
    """The chosen rows: ``key``, ``source``, ``tokens``, ``repeats`` (1 to the source's ``max_repeats``); see ``place_rows``."""
    placed = place_rows(df, key, source, tokens, source_budgets(df, source, tokens, targets), seed)
    return placed.where("repeats > 0").select(key, "source", "tokens", "repeats")


def reached_shares(placed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per listed source what the mix took of it: ``used_tokens``, ``used_rows``, ``spare_rows`` (that could be repeated once
    more), ``reached_share`` of all used tokens, and ``short``.

    A source is short if it stays below its budget although no row with tokens is spare; one without rows too, if it has a
    budget. This is the case exactly where ``max_repeats`` times its tokens are below the budget: a source that has more
    either meets the budget with its whole epochs or keeps rows out of the last one.
    """
    used = placed.groupBy(F.col("source").alias("_source")).agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("_used"), F.count_if(F.col("repeats") > 0).alias("_rows"), F.count_if((F.col("repeats") < F.col("max_repeats")) & (F.col("tokens") > 0)).alias("_spare")
    )
    none = F.lit(0).cast("bigint")
    both = budgets.join(used, F.col("source") == F.col("_source"), "left").withColumns({"used_tokens": F.coalesce("_used", none), "used_rows": F.coalesce("_rows", none), "spare_rows": F.coalesce("_spare", none)})
    total = both.agg(F.sum("used_tokens").alias("_all"))
    share = F.when(F.col("_all") > 0, F.col("used_tokens") / F.col("_all"))
    short = (F.col("used_tokens") < F.col("budget")) & (F.col("spare_rows") == 0)
    return (
        both.crossJoin(total)  # one row
        .withColumns({"reached_share": share, "short": short})
        .select("source", "target_share", "max_repeats", "available_tokens", "budget", "used_rows", "used_tokens", "spare_rows", "reached_share", "short")
    )
