"""Filling of fixed-capacity containers by minimum bin slack.

The items enter the search only as a histogram: for each length how many items have it. Lengths are at most the capacity,
so the histogram has at most ``capacity`` rows however many items there are. The search runs on that bounded table:

* The largest remaining length is placed; a bitset subset-sum program (bit *s* set: some multiset of remaining lengths
  sums to *s*) over the next lengths finds the fill closest to the capacity and stops as soon as a fill without slack
  exists; tracing the bitsets back gives the multiset, its counts bounded by the remaining items of each length.
* The same multiset is repeated as often as the remaining counts allow, so each step uses up at least one length and the
  number of distinct patterns is bounded by the capacity, not by the number of containers.

The items then take their places: within each length they are numbered by a distributed prefix count (hash order, one
count per partition), and a number belongs to one slot of one container of one pattern. That lookup needs only the
bounded pattern table; no group of items is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelode.llm.prefix import prefix_sums

PATTERN_COLUMNS = ("pattern_no", "copies", "first_container", "length", "per_container", "first_rank")


@dataclass(frozen=True)
class Pattern:
    """``copies`` containers, each with ``counts`` = (length, items of it)."""

    copies: int
    counts: tuple[tuple[int, int], ...]

    @property
    def fill(self) -> int:
        return sum(length * n for length, n in self.counts)


def _fill(lengths: list[int], left: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of remaining lengths (descending) whose sum is at most ``room`` and closest to it."""
    if room <= 0:
        return []
    mask = (1 << (room + 1)) - 1
    goal = 1 << room
    reach = 1
    steps: list[tuple[int, int, int]] = []  # (bitset before, length, copies allowed)
    for length in lengths:
        if length > room:
            continue
        n = min(left[length], room // length)
        if not n:
            continue
        before = reach
        # all multiples up to n by doubling
        part, k = 1, n
        while k > 0:
            take = min(part, k)
            reach |= (reach << (length * take)) & mask
            k -= take
            part *= 2
        if reach == before:
            continue
        steps.append((before, length, n))
        if reach & goal:
            break
    total = reach.bit_length() - 1
    chosen = []
    for before, length, n in reversed(steps):
        used = 0
        while not before >> total & 1:
            total -= length
            used += 1
            if total < 0 or used > n:
                raise AssertionError("the bitsets do not lead back")
        if used:
            chosen.append((length, used))
    return chosen


def fill_patterns(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Containers for items of the given lengths (each 1 to ``capacity``), as patterns with their copies."""
    left = {length: n for length, n in histogram.items() if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("lengths must be between 1 and the capacity")
    order = sorted(left, reverse=True)
    patterns = []
    while order:
        first = order[0]
        left[first] -= 1
        counts = {first: 1}
        for length, n in _fill(order, left, capacity - first):
            counts[length] = counts.get(length, 0) + n
        left[first] += 1
        copies = min(left[length] // n for length, n in counts.items())
        for length, n in counts.items():
            left[length] -= n * copies
        order = [length for length in order if left[length]]
        patterns.append(Pattern(copies, tuple(sorted(counts.items(), reverse=True))))
    return patterns


def _slots(patterns: list[Pattern]) -> pd.DataFrame:
    """The pattern table: which ranks of each length go to which pattern. It has a row per pattern and length."""
    used: dict[int, int] = {}
    rows, container = [], 0
    for no, p in enumerate(patterns):
        for length, n in p.counts:
            rows.append((no, p.copies, container, length, n, used.get(length, 0)))
            used[length] = used.get(length, 0) + n * p.copies
        container += p.copies
    return pd.DataFrame(rows, columns=PATTERN_COLUMNS, dtype="int64").sort_values(["length", "first_rank"], ignore_index=True)


def _pieces(items: DataFrame, capacity: int) -> DataFrame:
    """The items with their pieces: one for an item that fits, else full pieces and a rest.

    An item of exactly a multiple of the capacity has only full pieces.
    """
    count = F.greatest(F.lit(1), F.ceil(F.col("item_tokens") / F.lit(capacity))).cast("int")
    return items.select("*", count.alias("pieces")).select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece_no")).withColumn(
        "piece_tokens", F.least(F.lit(capacity), F.col("item_tokens") - F.col("piece_no") * capacity).cast("int")
    )


def pack(df: DataFrame, key: str, tokens: Column, capacity: int = 8192) -> DataFrame:
    """One row per piece: ``key``, ``item_tokens``, ``pieces``, ``piece_no``, ``start_token``, ``piece_tokens``, ``container_id``.

    Items larger than the capacity, and only they, have several pieces (``pieces`` > 1). Items without a size (null) or of
    size zero need no room; they have one piece of 0 tokens and no container. Repeated keys are packed each. The result is
    the same in every run: items of one length are numbered by the hash of their key, then the key.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = df.select(F.col(key).alias(key), F.coalesce(tokens.cast("bigint"), F.lit(0).cast("bigint")).alias("item_tokens"))
    pieces = _pieces(sized, capacity).withColumn("start_token", F.col("piece_no").cast("bigint") * capacity)
    # full pieces fill a container alone, whatever their number; they take part in the histogram as one length
    histogram = {r["piece_tokens"]: r["n"] for r in pieces.where("piece_tokens > 0").groupBy("piece_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(fill_patterns(histogram, capacity))
    if slots.empty:
        return pieces.select(key, "item_tokens", "pieces", "piece_no", "start_token", "piece_tokens", F.lit(None).cast("bigint").alias("container_id"))
    empty = pieces.where("piece_tokens = 0").select(key, "item_tokens", "pieces", "piece_no", "start_token", "piece_tokens", F.lit(None).cast("bigint").alias("container_id"))
    return _place(_rank_within_length(pieces, key), slots, key).unionAll(empty)


def _rank_within_length(pieces: DataFrame, key: str) -> DataFrame:
    """``before``: the number of each piece within its length, from 0; a length that many items share spans many tasks."""
    spread = pieces.where("piece_tokens > 0").withColumns({"_hash": F.xxhash64(F.col(key).cast("string"), F.col("piece_no")), "_one": F.lit(1)})
    return prefix_sums(spread, "piece_tokens", ["_hash", key, "piece_no"], "_one")


def _place(ranked: DataFrame, slots: pd.DataFrame, key: str) -> DataFrame:
    """The container of every ranked piece; ``slots`` is bounded by the capacity."""
    lengths = slots["length"].to_numpy()
    table = {c: slots[c].to_numpy() for c in PATTERN_COLUMNS}
    by_length = {int(a): (int(np.searchsorted(lengths, a, "left")), int(np.searchsorted(lengths, a, "right"))) for a in np.unique(lengths)}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, ranks = batch["piece_tokens"].to_numpy(), batch["before"].to_numpy()
            container = np.zeros(len(batch), dtype="int64")
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                a, b = by_length[int(size)]
                slot = a + np.searchsorted(table["first_rank"][a:b], ranks[rows], "right") - 1
                container[rows] = table["first_container"][slot] + (ranks[rows] - table["first_rank"][slot]) // table["per_container"][slot]
            yield batch[[key, "item_tokens", "pieces", "piece_no", "start_token", "piece_tokens"]].assign(container_id=container)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(key, "item_tokens", "pieces", "piece_no", "start_token", "piece_tokens").schema)
    return ranked.mapInPandas(place, schema + ", container_id bigint")


def container_fill(packed: DataFrame, capacity: int = 8192) -> DataFrame:
    """Per container its pieces, its tokens and the share of the capacity that they fill."""
    return (
        packed.where("container_id IS NOT NULL")
        .groupBy("container_id")
        .agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_tokens").cast("bigint").alias("tokens"))
        .withColumn("fill", F.col("tokens") / F.lit(capacity))
    )
