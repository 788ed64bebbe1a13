import datetime as dt
import random

from farelode.operators.references import orphan_references, orphan_report, reference_status, validity_intervals
from farelode.operators.skew import hot_keys, spread_join

P = "row_no bigint, key string, ingested_at timestamp, deleted_at timestamp, at string, valid_key int"
C = "row_no bigint, ref string, at timestamp, orphan_kind string, valid_from string"


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def judge(children, parents):
    """Brute force over all pairs."""
    out = []
    for no, ref, at, *_ in children:
        k = (ref or "").strip().lower()
        if not k:
            continue
        own = [p for p in parents if (p[1] or "").strip().lower() == k]
        kind = None
        if not own:
            kind = "missing"
        else:
            newest = max(own, key=lambda p: (p[2] is not None, p[2] or day(0), p[0]))
            arrivals = [p[2] for p in own if p[2] is not None]
            if newest[3] is not None:
                kind = "deleted"
            elif at is not None and arrivals and min(arrivals) > at:
                kind = "late"
        if kind:
            out.append(("t", no, kind, at.strftime("%Y-%m") if at else None))
    return sorted(out, key=str)


def run(spark, children, parents):
    found = orphan_references(spark.createDataFrame(children, C), "t", "ref", "at", spark.createDataFrame(parents, P), "key")
    return sorted(map(tuple, found.collect()), key=str)


def test_against_brute_force(spark):
    draw = random.Random(5)
    keys = [f"K{i}" for i in range(12)]
    spell = lambda k: draw.choice([k, k.lower(), f" {k}", f"{k}\t", f" {k} "])
    parents = [(i, spell(draw.choice(keys[:9])), draw.choice([None, *map(day, range(60))]), draw.choice([None, None, day(40)]), "x", 1) for i in range(40)]
    children = [(i, draw.choice([None, "", "  ", *map(spell, keys)]), draw.choice([None, *map(day, range(60))]), None, None) for i in range(300)]
    assert run(spark, children, parents) == judge(children, parents)


def test_hot_key_and_repeated_rows(spark):
    children = [(1, "gone", day(i % 50), None, None) for i in range(400)] + [(2, "here", day(5), None, None)] * 3
    parents = [(1, "here", day(1), None, None, None)]
    assert run(spark, children, parents) == judge(children, parents)
    assert len(run(spark, children, parents)) == 400


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", day(0), None, None)], []) == [("t", 1, "missing", "2026-01")]
    assert validity_intervals(spark.createDataFrame([], P), "key").count() == 0


def test_ties_of_arrival_go_by_row_number(spark):
    parents = [(1, "a", day(1), day(2), None, None), (2, "a", day(1), None, None, None)]
    assert run(spark, [(1, "a", day(3), None, None)], parents) == []
    assert run(spark, [(1, "a", day(3), None, None)], [(3, "a", day(1), day(2), None, None), *parents[1:]]) == [("t", 1, "deleted", "2026-01")]


def test_report_counts(spark):
    found = orphan_references(spark.createDataFrame([(i, "x" * 5000, day(0), None, None) for i in range(7)], C), "t", "ref", "at", spark.createDataFrame([], P), "key")
    assert [tuple(r) for r in orphan_report(found).collect()] == [("t", "2026-01", "missing", 7)]


def test_only_hot_keys_are_spread(spark):
    keys = spark.createDataFrame([("gone",)] * 4000 + [(f"k{i}",) for i in range(6000)] + [(None,)] * 500, "k string")
    assert [tuple(r) for r in hot_keys(keys, 1 / 16).collect()] == [("gone", 7)]
    assert hot_keys(keys, 1.0).count() == 0 and hot_keys(keys.limit(0), 0.1).count() == 0


def test_spreading_keeps_tasks_even_and_changes_nothing(spark):
    """With a third of all references on one missing id and a third on one present id no merge task has more than a fair share."""
    rows = [(i, "gone" if i % 3 == 0 else "here" if i % 3 == 1 else f"k{i % 700}", day(3), None, None) for i in range(9_000)]
    children, parents = spark.createDataFrame(rows, C), spark.createDataFrame([(i, k, day(1), None, None, None) for i, k in enumerate(["here", *(f"k{n}" for n in range(0, 700, 2))])], P)
    intervals = validity_intervals(parents, "key")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        judged = reference_status(children.select("row_no", "ref", "at"), "ref", "at", intervals)
        sizes = [len(p) for p in judged.select("row_no", "orphan_kind").rdd.glom().collect()]
        plain = reference_status(children.select("row_no", "ref", "at"), "ref", "at", intervals, hot_share=1.0)
        assert max(sizes) < 4 * sum(sizes) / 16 < max(len(p) for p in plain.select("row_no").rdd.glom().collect())
        assert sorted(map(tuple, judged.select("row_no", "orphan_kind").collect()), key=str) == sorted(map(tuple, plain.select("row_no", "orphan_kind").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_spread_join_is_a_join(spark):
    left = spark.createDataFrame([(i, f"k{i % 3}" if i % 7 else None, {"m": 1}) for i in range(200)], "n bigint, k string, m map<string,int>")
    right = spark.createDataFrame([("k0", "a"), ("k1", "b"), ("k9", "c"), (None, "d")], "r string, v string")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, left["k"] == right["r"], how).select("n", "v").collect()))
        assert sorted(map(str, spread_join(left, right, "k", "r", how).select("n", "v").collect())) == want
        assert spread_join(left.limit(0), right, "k", "r", how).count() == 0
