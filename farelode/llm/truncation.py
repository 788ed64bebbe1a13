"""Texts that were cut by field limits or broken transfers.

1. *Lengths.* Every text is measured as it may have been stored: in characters, UTF-8 bytes or UTF-16 units, with entities
   escaped, as JSON, with line feeds turned into CR LF. Grouped by source and representation, a hidden limit shows as a
   length that far more different texts have than the lengths just below it.
2. *Endings.* What stands at the end of a text is compared with all texts: an ending model counts, for every context
   inside a sentence unit, how often the unit ends there and how often it goes on. Contexts are the last two tokens, and
   in short units the opening tokens with the position and the shape of the last one. A last word that occurs nowhere
   else is a fragment. A mark of omission is taken off first; it proves nothing alone, as some sentences end in one.
3. *Verdict.* At a hidden limit a text counts as cut unless it ends with a sentence; elsewhere if its ending goes on in
   other texts.

The counts are folded per batch before they are shuffled, and joined back by key, with hot keys (common endings, large
sources, repeated texts) spread; every text takes part whole.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelode.llm.sentences import sentences, thai_words
from farelode.operators.skew import hot_keys, hot_share_of, spread_join
from farelode.tables import clean_id, stored

REPRESENTATIONS = ("characters", "utf8", "utf16", "entities", "entities_without_quotes", "entities_utf8", "json", "json_utf8", "json_ascii", "crlf", "crlf_utf8")
BYTE_SLACK = 3  # a limit in bytes may fall short of it by part of a character
SHORT = 12  # the order of the ending model: so many tokens of a unit count by their position; further ones by the tokens before them
ENDS_OFTEN = 0.25  # share of the units that end in a context from which on an ending there counts as complete
SURPRISE = 7.0  # a chance of about 1 in 1,000
SURE = 30.0  # a chance that stays small over all lengths, representations and sources
ENDS_SELDOM = 0.1  # the same for endings with a terminator, which abbreviations have too
MARKS = ("[…]", "[...]", "(…)", "(...)", "(more)", "(continued)", "(cont.)", "(cont)", "…")  # and three dots or more
# a character that lost some of its bytes, and vowels that Thai writes before their consonant
BROKEN = ("\ufffd", "เ", "แ", "โ", "ใ", "ไ")
_TOKEN = re.compile(r"[฀-๿]+|[A-Z]{2,}(?:-[A-Z]{2,})+|\d+(?:[.,:]\d+)*|[぀-ヿ一-鿿]|[^\W_]+|[^\w\s]|_")
_THAI = re.compile(r"[\u0e00-\u0e7f]")
_OPENING = re.compile(r"[\"“„«「(（]")
_TERMINATORS, _CLOSING = ".!?؟۔।॥。！？｡", "\"”“»」』)'’"


def stored_lengths(text: str) -> list[int]:
    """The length of a text under each of ``REPRESENTATIONS``."""
    ascii_only = text.isascii()
    n = len(text)
    bytes8 = n if ascii_only else len(text.encode("utf-8", "surrogatepass"))
    wide = n if ascii_only else len(text.encode("utf-16-le", "surrogatepass")) // 2
    feeds = text.count("\n") - text.count("\r\n")
    markup = 4 * text.count("&") + 3 * (text.count("<") + text.count(">"))
    quotes = 5 * text.count('"') + 5 * text.count("'")
    escaped = sum(map(text.count, '"\\\n\r\t\b\f'))
    ascii_json = n + escaped if ascii_only else len(json.dumps(text)) - 2
    return [n, bytes8, wide, n + markup + quotes, n + markup, bytes8 + markup + quotes, n + escaped, bytes8 + escaped, ascii_json, n + feeds, bytes8 + feeds]


def tokens(text: str) -> list[str]:
    """Words, digits and marks as they stand; Thai runs cut into dictionary words."""
    found = _TOKEN.findall(text)
    if _THAI.search(text) is None:
        return found
    out = []
    for t in found:
        if "\u0e00" <= t[0] <= "\u0e7f":
            out.extend(thai_words(t))
        else:
            out.append(t)
    return out


def _plain(token: str) -> str:
    """Digits as one class; codes of capitals as another; other words in lower case."""
    if token[0].isdigit():
        return "0"
    if len(token) > 1 and token.isupper():
        return "X"
    return token.lower()


def _shape(token: str) -> str:
    if token[0].isdigit():
        return "0"
    if len(token) > 1 and token.isupper():
        return "X"
    if token.isalpha():
        return "Aa" if token[0].isupper() else "aa" if token[0].islower() else token
    return token


class _Forms(dict):
    """A word's form, found once."""

    def __init__(self, form: Callable[[str], str]) -> None:
        self.form = form

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = self.form(word)
        return found


def _kind(words: list[str]) -> str:
    """List item, table row, heading with a value, or running text."""
    if words[0] in "•‣▪*–-(" or words[0][0].isdigit() and len(words) > 1 and words[1] in ".)":
        return "L"
    if "|" in words:
        return "T"
    for i in range(len(words) - 2, max(0, len(words) - 5), -1):
        if words[i] in ":：":
            rest = words[i + 1 :]
            if i <= SHORT and all(w[0].isdigit() or w in "$€£¥%" or len(w) == 3 and w.isupper() for w in rest):
                return "H"
    return "R"


def _pair(kind: str, plain: tuple[str, ...], i: int) -> str:
    """The last two tokens; before a period the last three, as short words before one are often abbreviated."""
    before = plain[i - 1] if i else "^"
    if plain[i] == "." and i > 1:
        before = f"{plain[i - 2]} {before}"
    return f"2{kind}\t{before}\t{plain[i]}"


def contexts(kind: str, plain: tuple[str, ...], shapes: tuple[str, ...], i: int) -> tuple[str, ...]:
    """The keys of the position behind token ``i``: of the last two tokens, and in short running units of the first two and
    the first four tokens with the position and the shape of the last one."""
    pair = _pair(kind, plain, i)
    if kind != "R" or i >= SHORT:
        return (pair,)
    end = f"{i}\t{shapes[i]}"
    return pair, f"3{' '.join(plain[: min(2, i + 1)])}\t{end}", f"4{' '.join(plain[: min(4, i + 1)])}\t{end}"


def split_mark(text: str) -> tuple[str, bool]:
    """The text without a mark of omission at its end, and whether there was one. A text that is only a mark has none."""
    bare = text.rstrip()
    mark = next((m for m in MARKS if bare.endswith(m)), "")
    kept = bare[: -len(mark)] if mark else bare.rstrip(".") if bare.endswith("...") else bare
    kept = kept.rstrip()
    return (kept, True) if kept and len(kept) < len(bare) else (bare, False)


def _ends_with_terminator(text: str) -> bool:
    return text.rstrip(_CLOSING).endswith(tuple(_TERMINATORS))


def _units(text: str) -> list[tuple[int, int]]:
    """Sentence units line by line. Where lines are only wrapped, few of many units of a context end there."""
    return sentences(text, lines=True)


COUNTS = "context string, ends bigint, marked_ends bigint, goes_on bigint"
FACTS = "lengths array<int>, bare_lengths array<int>, marked boolean, sentence boolean, open_quote boolean, broken boolean, word string, ends_in array<string>"


class _Counts:
    """Context counts of many units. Equal units, digits aside, are counted first and taken apart once."""

    def __init__(self) -> None:
        self.units: Counter = Counter()

    def add(self, kind: str, plain: tuple[str, ...], shapes: tuple[str, ...], marked: bool) -> None:
        self.units[kind, plain, shapes, marked] += 1

    def rows(self) -> pd.DataFrame:
        on: dict[str, int] = {}
        end: dict[str, int] = {}
        mark: dict[str, int] = {}
        for (kind, plain, shapes, marked), n in self.units.items():
            before, keys = "^", []
            for i, p in enumerate(plain[:-1]):
                keys.append(f"2{kind}\t{before}\t{p}" if p != "." or i < 2 else _pair(kind, plain, i))
                before = p
            if kind == "R":
                two, four = " ".join(plain[:2]), " ".join(plain[:4])
                for i in range(min(len(plain) - 1, SHORT)):
                    at = f"\t{i}\t{shapes[i]}"
                    keys.append(f"3{two if i else plain[0]}{at}")
                    keys.append(f"4{four if i > 2 else ' '.join(plain[: i + 1])}{at}")
            for key in keys:
                on[key] = on.get(key, 0) + n
            for key in contexts(kind, plain, shapes, len(plain) - 1):
                end[key] = end.get(key, 0) + n
                if marked:
                    mark[key] = mark.get(key, 0) + n
        self.units.clear()
        keys = list(on.keys() | end.keys())
        return pd.DataFrame([(k, end.get(k, 0), mark.get(k, 0), on.get(k, 0)) for k in keys], columns=["context", "ends", "marked_ends", "goes_on"])


def _unclosed(text: str) -> bool:
    """Whether the last unit of the last block leaves a quotation or bracket open."""
    block = text[text.rfind("\n\n") + 1 :]
    if _OPENING.search(block) is None:
        return False
    a, b = sentences(block)[-1]
    unit = block[a:b]
    if unit.count('"') % 2 or unit.count("«") > unit.count("»") or unit.count("「") > unit.count("」"):
        return True
    if "„" in unit:
        return unit.count("„") > unit.count("“") + unit.count("”")
    # a list marker such as 1) or (a) is balanced or closes only
    return unit.count("“") > unit.count("”") or unit.count("(") > unit.count(")") or unit.count("（") > unit.count("）")


def _scan(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One pass over the texts that gives two kinds of rows: one per non-blank text (``context`` null) with its lengths, its
    mark, whether it ends like a sentence and the contexts of its end; and the counts of all contexts, folded per batch.

    A context's counts: how many units end there, how many of them with a mark of omission, and how many go on.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, source string, text_hash bigint, {FACTS}, {COUNTS}"
    names = [c.split()[0] for c in FACTS.split(", ")]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain_of, shape_of = _Forms(_plain).__getitem__, _Forms(_shape).__getitem__
        counts = _Counts()
        for batch in batches:
            rows = []
            for t in batch["_text"].tolist():
                bare, mark = split_mark(t)
                units = _units(bare)
                word, ends_in = None, []
                for u, (a, b) in enumerate(units):
                    words = tokens(bare[a:b])
                    if not words:
                        continue
                    final = u == len(units) - 1
                    unit = (_kind(words), tuple(map(plain_of, words)), tuple(map(shape_of, words[:SHORT])))
                    counts.add(*unit, final and mark)
                    if final:
                        word, ends_in = f"1\t{unit[1][-1]}", list(contexts(*unit, len(words) - 1))
                lengths = stored_lengths(t)
                whole = bare.rstrip("\ufffd")
                rows.append((lengths, stored_lengths(whole) if mark or len(whole) < len(bare) else lengths, mark, _ends_with_terminator(bare), bool(units) and _unclosed(bare), bare.endswith(BROKEN), word, ends_in))
                if len(counts.units) > 200_000:
                    yield _both(counts.rows())
            found = pd.concat([batch[[key, "source", "text_hash"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)
            yield _both(found)
        yield _both(counts.rows())

    order = [key, "source", "text_hash", *names, *[c.split()[0] for c in COUNTS.split(", ")]]

    def _both(part: pd.DataFrame) -> pd.DataFrame:
        """The part with the other kind's columns empty."""
        return part.assign(**{c: pd.Series([None] * len(part), dtype=object) for c in order if c not in part.columns})[order]

    texts = df.select(F.col(key).alias(key), F.coalesce(clean_id(F.col(source)), F.lit("unknown")).alias("source"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("_text"))
    return texts.where(F.length(F.trim("_text")) > 0).mapInPandas(look, schema)


def _facts(scanned: DataFrame) -> DataFrame:
    return scanned.where("context IS NULL").drop("context", "ends", "marked_ends", "goes_on")


def _statistics(scanned: DataFrame) -> DataFrame:
    return scanned.where("context IS NOT NULL").groupBy(F.col("context").alias("key")).agg(F.sum("ends").alias("ends"), F.sum("marked_ends").alias("marked"), F.sum("goes_on").alias("goes_on"))


def _surprise(n: Column, mean: Column) -> Column:
    """Minus the logarithm of a bound of the chance (Chernoff's) that ``n`` texts have a length where ``mean`` are expected."""
    return F.when(n <= mean, F.lit(0.0)).otherwise(n * F.log(n / mean) - n + mean)


def hidden_limits(facts: DataFrame, least: int = 5, share: float = 0.03, factor: float = 6.0, near: int = 60) -> DataFrame:
    """Per source its limits: ``source, representation`` (its number), ``stored`` (the length), ``texts`` (that have it).

    A length is a limit if at least ``least`` different texts reach it (in bytes, up to three less) and more than ``factor``
    times as many as the mean of the ``near`` lengths on its denser side lets expect, plus one half. They must also be a
    ``share`` of the source's texts, or be too many for chance beside that mean, however large the source.
    In bytes, texts of one limit end at up to four lengths, and in some scripts few or none at the highest: the limit is the
    highest length whose window holds most, without lengths above that hold no more than those that follow.
    A spike counts only with the texts that no clearly larger one of its source explains: so of the representations of one
    limit those are left that explain nearly as many texts as the best, and further limits of the source stay.
    The windows run over distinct lengths, whose number the longest text
    bounds, not over texts.
    """
    # what stands for a broken character may be longer than the bytes that were left of it
    lengths = F.when(F.col("broken") & ~F.col("marked"), F.col("bare_lengths")).otherwise(F.col("lengths")) if "broken" in facts.columns else F.col("lengths")
    # a text comes once per source; its lengths are counted where it lies, before anything is shuffled by length
    unique = stored(facts.select("source", "text_hash", lengths.alias("_lengths")).dropDuplicates(["source", "text_hash"]))
    counted = unique.select("source", F.posexplode("_lengths").alias("representation", "stored")).groupBy("source", "representation", "stored").agg(F.count(F.lit(1)).alias("texts"))
    in_bytes = F.col("representation").isin([i for i, r in enumerate(REPRESENTATIONS) if "utf8" in r])
    w = Window.partitionBy("source", "representation").orderBy("stored")
    spikes = (
        counted.withColumn("window", F.when(in_bytes, F.sum("texts").over(w.rangeBetween(-BYTE_SLACK, 0))).otherwise(F.col("texts")))
        .withColumn("below", F.coalesce(F.sum("texts").over(w.rangeBetween(-near - BYTE_SLACK, -BYTE_SLACK - 1)), F.lit(0)))
        .withColumn("above", F.coalesce(F.sum("texts").over(w.rangeBetween(1, near)), F.lit(0)))
        .withColumn("width", F.when(in_bytes, BYTE_SLACK + 1).otherwise(1))
        .where((F.col("window") >= least) & (F.col("window") > factor * (F.greatest("below", "above") / near * F.col("width") + 0.5)) )
    )
    # in bytes: what a length holds may be its share of the limit's texts, or only what the lengths above hold too
    beyond = F.col("above") / near
    its_share = F.col("window") / (BYTE_SLACK + 1)
    of_limit = ~in_bytes | (F.col("above") == 0) | (_surprise(F.col("texts"), beyond) > SURPRISE) | (F.col("texts") * F.log(its_share / beyond) >= its_share - beyond)
    around = w.rangeBetween(-BYTE_SLACK, BYTE_SLACK)
    spikes = spikes.where(of_limit).withColumn("most", F.max(F.struct("window", "stored")).over(around)).where(~in_bytes | (F.col("most.stored") == F.col("stored")))
    sizes = unique.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_all"))
    expected = (F.greatest("below", "above") + 1) / near * F.col("width")
    spikes = spikes.withColumn("expected", expected).join(sizes, F.col("source") == F.col("_s")).where((F.col("window") >= share * F.col("_all")) | (_surprise(F.col("window"), F.col("expected")) > SURE))
    # of each spike, the texts that no clearly larger one explains
    per_source = spikes.groupBy(F.col("source").alias("_s")).agg(F.collect_list(F.struct("representation", "stored", "window", (F.col("width") - 1).alias("slack"))).alias("spikes"))
    texts = spread_join(unique, per_source, "source", "_s", salt_by=F.col("text_hash"))
    on = F.filter("spikes", lambda x: F.element_at("_lengths", x["representation"] + 1).between(x["stored"] - x["slack"], x["stored"]))
    best = F.array_max(F.transform("_on", lambda x: x["window"]))
    own = texts.withColumn("_on", on).withColumn("_on", F.filter("_on", lambda x: x["window"] >= 0.9 * best)).select(F.col("source").alias("_s"), F.explode("_on").alias("_x"))
    own = own.groupBy("_s", F.col("_x.representation").alias("_r"), F.col("_x.stored").alias("_l")).agg(F.count(F.lit(1)).alias("own"))
    kept = spikes.drop("_s").join(own, (F.col("source") == F.col("_s")) & (F.col("representation") == F.col("_r")) & (F.col("stored") == F.col("_l")))
    alone = (F.col("own") >= least) & (F.col("own") > factor * (F.greatest("below", "above") / near * F.col("width") + 0.5))
    alone &= (F.col("own") >= share * F.col("_all")) | (_surprise(F.col("own"), F.col("expected")) > SURE)
    return kept.where(alone).select("source", "representation", "stored", F.col("window").alias("texts"))


def find_truncated(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Every non-blank text with its verdict: ``key``, ``source``, ``at_limit``, ``marked``, ``ending``, ``truncated``.

    ``source`` comes without surrounding white space and case, "unknown" where null or blank. ``ending`` is ``sentence``,
    ``complete`` (units elsewhere end so), ``fragment`` (an unknown word or a broken character), ``open`` (units elsewhere go on) or ``quote`` (left open). Null and
    blank texts have no row: nothing shows whether they were cut. Repeated texts are judged each; keys should be unique.
    """
    scanned = stored(_scan(df, key, text, source))
    facts = _facts(scanned)
    hot_texts = hot_keys(facts.select("text_hash"), hot_share_of(facts))
    # each of these is read several times; written, they keep the plans short
    copies = stored(facts.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("word", "ends_in", "marked")).alias("end")))
    limits = stored(hidden_limits(facts).coalesce(1))  # few rows a source
    slack = F.when(F.col("representation").isin([i for i, r in enumerate(REPRESENTATIONS) if "utf8" in r]), BYTE_SLACK).otherwise(0)
    per_source = limits.groupBy("source").agg(F.collect_set(F.struct("representation", "stored", slack.alias("slack"))).alias("limits"))

    def reaches(lengths: str) -> object:
        return F.exists("limits", lambda x: F.element_at(lengths, x["representation"] + 1).between(x["stored"] - x["slack"], x["stored"]))

    placed = spread_join(facts, per_source.withColumnRenamed("source", "_s"), "source", "_s", "left", salt_by=F.xxhash64(key)).drop("_s")
    placed = placed.withColumn("at_limit", F.coalesce(reaches("lengths") | reaches("bare_lengths"), F.lit(False)))
    statistics = stored(_statistics(scanned))  # read three times
    # how often a last word stands anywhere follows from the pairs that end in it
    parts = F.split("key", "\t")
    pairs = statistics.where(F.col("key").startswith("2")).select("key", parts[0].alias("k"), parts[1].alias("p"), parts[2].alias("w"), "ends", "goes_on")
    uses = pairs.groupBy(F.concat(F.lit("1\t"), F.col("w")).alias("key")).agg(F.sum("ends").alias("ends"), F.lit(0).cast("bigint").alias("marked"), F.sum("goes_on").alias("goes_on"))
    statistics_and_uses = statistics.unionByName(uses)
    # the ending of a text and of its exact copies is not counted for it
    asked = copies.select("text_hash", F.col("copies").alias("own"), F.when(F.col("end.marked"), F.col("copies")).otherwise(0).alias("own_marked"), F.explode(F.concat(F.array("end.word"), "end.ends_in")).alias("_key")).where("_key IS NOT NULL")
    told = (
        spread_join(asked, statistics_and_uses, "_key", "key", salt_by=F.col("text_hash"))  # very many texts end in a period
        .select(F.col("text_hash").alias("_h"), F.substring("_key", 1, 1).alias("kind"), (F.col("ends") - F.col("own")).alias("ends"), (F.col("marked") - F.col("own_marked")).alias("with_mark"), "goes_on")
        .groupBy("_h")
        .agg(*[F.max(F.when(F.col("kind") == k, F.struct("ends", "with_mark", "goes_on"))).alias(n) for k, n in (("1", "w"), ("2", "p"), ("3", "o"), ("4", "f"))])
    )
    # a last word that begins a longer word which stands elsewhere in the same place, and itself stands there nowhere, is cut
    # only beginnings as long as some last word are made
    asked_lengths = asked.where(F.col("_key").startswith("2")).agg(F.collect_set(F.length(F.split("_key", "\t")[2])).alias("_asked"))
    begun = (
        pairs.select("k", "p", "w", (F.col("ends") + F.col("goes_on")).alias("n"))
        .where(F.length("w") > 1)
        .crossJoin(F.broadcast(asked_lengths))
        .select("n", F.explode(F.transform(F.filter("_asked", lambda n: n < F.length("w")), lambda n: F.concat_ws("\t", "k", "p", F.substring("w", F.lit(1), n)))).alias("_begun"))
        .groupBy("_begun")
        .agg(F.sum("n").alias("_longer"))
    )
    cut_words = spread_join(asked.where(F.col("_key").startswith("2")), begun, "_key", "_begun", salt_by=F.col("text_hash")).select(F.col("text_hash").alias("_h"), "_longer")
    told = stored(told.join(cut_words, "_h", "left"))
    both = spread_join(placed, told, "text_hash", "_h", "left", salt_by=F.xxhash64(key), hot=hot_texts)
    known = (F.coalesce(F.col("w.goes_on") + F.col("w.ends"), F.lit(0)) > 0) & ~((F.coalesce("_longer", F.lit(0)) > F.coalesce(F.col("p.ends"), F.lit(0))) & (F.coalesce(F.col("p.goes_on"), F.lit(0)) == 0))
    loose = F.col("word").isin([f"1\t{c}" for c in "-–—/,:;(&"])
    # of the openings that were seen the one that ends more often decides, else the last two tokens
    def ends_share(c: str) -> Column:
        return F.try_divide(F.col(f"{c}.ends"), F.col(f"{c}.ends") + F.col(f"{c}.goes_on"))

    openings = F.when(F.coalesce(ends_share("f"), F.lit(-1.0)) >= F.coalesce(ends_share("o"), F.lit(-1.0)), F.col("f")).otherwise(F.col("o"))
    seen = F.when(ends_share("f").isNotNull() | ends_share("o").isNotNull(), openings).when(ends_share("p").isNotNull(), F.col("p"))
    both = both.withColumn("_known", known).withColumn("_seen", seen)
    share = F.coalesce(F.try_divide(F.col("_seen.ends"), F.col("_seen.ends") + F.col("_seen.goes_on")), F.lit(0.0))
    pair_share = F.coalesce(ends_share("p"), F.lit(1.0))
    own_mark = F.col("marked") & (F.coalesce(F.col("_seen.goes_on"), F.lit(1)) == 0) & (F.col("_seen.with_mark") > 0) & (F.col("_seen.with_mark") == F.col("_seen.ends"))
    ending = (
        F.when(F.col("broken"), "fragment")
        .when(F.col("open_quote"), "quote")
        .when(F.col("sentence") & (pair_share >= ENDS_SELDOM), "sentence")
        .when(F.col("marked") & own_mark, "complete")
        .when(~F.col("_known"), "fragment")
        .when(F.col("marked") | loose, "open")
        .when(share >= ENDS_OFTEN, "complete")
        .otherwise("open")
    )
    judged = both.withColumn("ending", ending)
    cut = F.when(F.col("at_limit"), F.col("marked") | (F.col("ending") != "sentence")).otherwise(F.col("ending").isin("fragment", "open", "quote") | F.col("marked") & (F.col("ending") != "complete"))
    return judged.select(key, "source", "at_limit", "marked", "ending", cut.alias("truncated"))


def length_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the length of every text under each of ``REPRESENTATIONS``; null and blank texts have no row."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.concat([batch[[key]].reset_index(drop=True), pd.DataFrame([stored_lengths(t) for t in batch["_text"]], columns=REPRESENTATIONS, dtype="int64")], axis=1)

    texts = df.select(key, F.col(text).cast("string").alias("_text")).where(F.length(F.trim("_text")) > 0)
    return texts.mapInPandas(measure, ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *(f"{r} bigint" for r in REPRESENTATIONS)]))


def truncation_rates(found: DataFrame) -> DataFrame:
    """Per source its texts, its truncated texts and their share."""
    return found.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if("truncated").alias("truncated_texts"), F.count_if("at_limit").alias("texts_at_limit"), (F.count_if("truncated") / F.count(F.lit(1))).alias("rate")
    )
