import random
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from farelode.llm.mixing import mix_sources, place_rows, reached_shares, source_budgets
from farelode.llm.packing import container_fill, fill_patterns, pack
from farelode.llm.prefix import prefix_sums


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_every_item_once(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 64, 1000])
    histogram = Counter(draw.randint(1, capacity) if draw.random() < 0.5 else draw.choice([1, 3, capacity]) for _ in range(draw.randint(0, 400)))
    patterns = fill_patterns(histogram, capacity)
    used = Counter()
    for p in patterns:
        assert 0 < p.fill <= capacity and p.copies > 0
        for length, n in p.counts:
            used[length] += n * p.copies
    assert used == histogram
    bins = sum(p.copies for p in patterns)
    total = sum(k * v for k, v in histogram.items())
    assert bins <= 1.25 * -(-total // capacity) + 1 or any(k > capacity / 2 for k in histogram)


def test_patterns_are_bounded_by_lengths_not_items():
    few, many = (fill_patterns({3: n, 5: n, 7: n}, 20) for n in (10, 10_000_000))
    assert len(many) <= 2 * len(few) + 3 and sum(p.copies for p in many) == -(-150_000_000 // 20)
    with pytest.raises(ValueError):
        fill_patterns({9: 1}, 8)


def check_packed(rows, sizes, capacity):
    load, pieces = Counter(), defaultdict(list)
    for r in rows:
        pieces[r["k"]].append(r)
        if r["piece_tokens"]:
            assert r["container_id"] is not None
            load[r["container_id"]] += r["piece_tokens"]
        else:
            assert r["container_id"] is None
    assert all(v <= capacity for v in load.values()) and sorted(load) == list(range(len(load)))
    for k, size in sizes.items():
        own = sorted(pieces[k], key=lambda r: r["piece_no"])
        assert sum(r["piece_tokens"] for r in own) == size and len(own) == max(1, -(-size // capacity)) == own[0]["pieces"]
        assert [r["start_token"] for r in own] == [i * capacity for i in range(len(own))]
    return len(load)


@pytest.mark.parametrize("partitions", ["2", "7"])
def test_pack(spark, partitions):
    draw = random.Random(9)
    sizes = {i: draw.choice([0, 5, 5, 5, 100, 250, draw.randint(1, 100)]) for i in range(500)}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()] + [(1000, None, "x")], "k bigint, n int, container_id string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = pack(df, "k", F.col("n"), 100).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, pack(df, "k", F.col("n"), 100).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    bins = check_packed(rows, sizes | {1000: 0}, 100)
    assert bins <= -(-sum(sizes.values()) // 100) + 2
    fill = container_fill(spark.createDataFrame(rows), 100)
    assert fill.count() == bins and fill.agg(F.max("fill")).first()[0] == 1.0


def test_pack_edges(spark):
    df = spark.createDataFrame([(1, 300)], "k bigint, n int")
    assert pack(df.limit(0), "k", F.col("n"), 100).count() == 0
    assert {r["container_id"] for r in pack(df, "k", F.col("n"), 100).collect()} == {0, 1, 2}
    assert [r["container_id"] for r in pack(df.withColumn("n", F.lit(0)), "k", F.col("n"), 100).collect()] == [None]
    with pytest.raises(ValueError):
        pack(df, "k", F.col("n"), 0)


def test_prefix_sums(spark):
    draw = random.Random(4)
    rows = [(draw.choice([None, "a", "a", "a", "a", "b", "c"]), i, draw.randint(0, 9)) for i in range(700)]
    draw.shuffle(rows)
    got = {(r["g"], r["o"]): r["before"] for r in prefix_sums(spark.createDataFrame(rows, "g string, o int, v int"), "g", ["o"], "v").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((o, v) for h, o, v in rows if h == g)
        want |= {(g, o): s for (o, _), s in zip(own, accumulate([0, *(v for _, v in own)]))}
    assert got == want
    assert prefix_sums(spark.createDataFrame([], "g string, o int, v int"), "g", ["o"], "v").count() == 0


DOCS = "id bigint, source string, n int, repeats int, budget int"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    draw = random.Random(8)
    rows = [(i, draw.choice([" Big", "big", "BIG ", "big", "small", "other", None, ""]), draw.randint(1, 50), None, None) for i in range(1500)] + [(5000, "big", None, 0, 0)]
    docs, targets = spark.createDataFrame(rows, DOCS), spark.createDataFrame([("big", 0.3, 1), ("small", 0.5, 3), ("tiny", 0.2, 4)], TARGETS)
    tokens = defaultdict(int)
    for _, s, n, *_ in rows:
        tokens[(s or "").strip().lower()] += n or 0
    total = tokens["big"] + tokens["small"]
    budgets = {r["source"]: r for r in source_budgets(docs, "source", F.col("n"), targets).collect()}
    assert {s: r["available_tokens"] for s, r in budgets.items()} == {"big": tokens["big"], "small": tokens["small"], "tiny": 0}
    mix = mix_sources(docs, "id", "source", F.col("n"), targets)
    rows_ = mix.collect()
    assert sorted(map(tuple, rows_)) == sorted(map(tuple, mix_sources(docs, "id", "source", F.col("n"), targets).collect()))
    used = defaultdict(int)
    for r in rows_:
        used[r["source"]] += r["tokens"] * r["repeats"]
        assert 1 <= r["repeats"] <= {"big": 1, "small": 3}[r["source"]]
    for s, share in (("big", 0.3), ("small", 0.5)):
        assert abs(used[s] - min(share * total, {"big": 1, "small": 3}[s] * tokens[s])) <= 25  # half of the largest row
    assert len({r["id"] for r in rows_}) == len(rows_) and len({r["repeats"] for r in rows_ if r["source"] == "small"}) == 2
    budgets_ = source_budgets(docs, "source", F.col("n"), targets)
    shares = {r["source"]: r for r in reached_shares(place_rows(docs, "id", "source", F.col("n"), budgets_), budgets_).collect()}
    assert {s: r["short"] for s, r in shares.items()} == {"big": tokens["big"] < 0.3 * total, "small": 3 * tokens["small"] < 0.5 * total, "tiny": True}
    assert shares["tiny"]["used_tokens"] == 0 and sum(r["reached_share"] for r in shares.values()) == pytest.approx(1)


def test_mix_edges(spark):
    docs, targets = spark.createDataFrame([(1, "a", 5, None, None), (2, "b", 5, None, None)], DOCS), spark.createDataFrame([("A ", 1.0, 2), ("a", 1.0, 5), (None, 1.0, 1)], TARGETS)
    b = source_budgets(docs, "source", F.col("n"), targets).collect()
    assert [(r["source_key"], r["target_share"], r["max_repeats"]) for r in b] == [("a", 2.0, 2)]
    assert [tuple(r) for r in mix_sources(docs, "id", "source", F.col("n"), targets).collect()] == [(1, b[0]["source"], 5, 2)]
    assert mix_sources(docs.limit(0), "id", "source", F.col("n"), targets).count() == 0 and mix_sources(docs, "id", "source", F.col("n"), targets.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [[1, 1], [5], [0, 0], [0, 7], [3, 3, 4], [10, 1], []])
def test_short_sources_are_those_without_enough_tokens(spark, sizes):
    """The mix tells the same as the sums, also where a budget is met exactly and where rows have no tokens."""
    rows = [(i, "a", n, None, None) for i, n in enumerate(sizes)] + [(90 + i, "b", 5, None, None) for i in range(4)]
    docs = spark.createDataFrame(rows, DOCS)
    total = sum(r[2] for r in rows)
    for share in (0.0, 0.1, sum(sizes) / total, 2 * sum(sizes) / total, 0.9):
        targets = spark.createDataFrame([("a", share, 2), ("b", 1 - share, 1)], TARGETS)
        budgets = source_budgets(docs, "source", F.col("n"), targets)
        got = {r["source"]: r["short"] for r in reached_shares(place_rows(docs, "id", "source", F.col("n"), budgets), budgets).collect()}
        assert got == {"a": 2 * sum(sizes) < share * total, "b": 20 < (1 - share) * total}
