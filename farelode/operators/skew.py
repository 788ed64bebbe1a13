"""Joins of a large side with one row per key, in which hot keys of the large side are spread over many tasks.

Hot keys, and only they, carry a salt; the other side's row is repeated for every salt. They are found by a frequent-items
sketch in one partial aggregation, so no keys are shuffled for it. The sketch only steers the spreading: a key that it
counts wrong is joined all the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_share_of(df: DataFrame) -> float:
    """The share of the rows from which on a key is hot: a quarter of what a shuffle partition should hold."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(1 / (4 * parts), 1 / 10_000)


def hot_keys(keys: DataFrame, share: float) -> DataFrame:
    """The keys that hold more than ``share`` of the rows: ``hot_key``, ``salts`` (into how many parts to spread them).

    ``keys`` is one column; nulls are no keys. At most ``1 / share`` keys can hold so much, so there are no more rows, and the
    sketch tracks eight times as many.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    most = math.ceil(1 / share)
    name = keys.columns[0]
    counted = keys.where(F.col(name).isNotNull()).agg(F.expr(f"approx_top_k(`{name}`, {most}, {8 * most})").alias("top"), F.count(F.lit(1)).alias("rows"))
    found = counted.select("rows", F.explode("top").alias("x")).where(F.col("x.count") > F.col("rows") * share)
    return found.select(F.col("x.item").alias("hot_key"), F.ceil(F.col("x.count") / (F.col("rows") * share)).cast("int").alias("salts"))


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", salt_by: Column | None = None, hot_share: float | None = None, hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``left_key = right_key`` by sort-merge; all columns of both sides.

    ``how``: inner or left. ``right`` should have one row per key, or few. ``salt_by``: a number that tells the rows of a key
    apart and does not change when a task is repeated; unless given, the hash of the left row (without maps, which have no
    hash). Columns that start with ``_skew_`` are reserved. ``hot_share`` 1 turns the spreading off. ``hot``: the
    hot keys where they are known, or found more cheaply, else they are looked for in ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if hot is None:
        hot = hot_keys(left.select(left_key), hot_share_of(left) if hot_share is None else hot_share)
    if salt_by is None:
        salt_by = F.xxhash64(*[f"`{f.name}`" for f in left.schema if "map<" not in f.dataType.simpleString()])
    # at most 1 / share rows
    hot = F.broadcast(hot.select(F.col("hot_key").alias("_skew_hot"), F.col("salts").alias("_skew_salts")))
    salted = left.join(hot, F.col(left_key) == F.col("_skew_hot"), "left").withColumn("_skew_salt", F.coalesce(F.pmod(salt_by, F.col("_skew_salts")), F.lit(0)).cast("int")).drop("_skew_hot", "_skew_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_skew_salts"), F.lit(1)) - 1))
    repeated = right.join(hot, F.col(right_key) == F.col("_skew_hot"), "left").select(*right.columns, copies.alias("_skew_copy"))
    return salted.join(repeated.hint("merge"), (F.col(left_key) == F.col(right_key)) & (F.col("_skew_salt") == F.col("_skew_copy")), how).drop("_skew_salt", "_skew_copy")
