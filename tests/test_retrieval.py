import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from farelode.operators import answers, index, vectors
from farelode.operators.index import HybridIndex

META = "struct<source_id:string,document_id:string,document_type:string,carrier:string,supplier:string,offer_or_circular_id:string,section_title:string>"
CHUNK = f"row_no bigint, chunk_id string, text string, metadata {META}"
CLAUSE = "row_no bigint, record_id string, chunk_id string, clause_text string, policy_topic string, action string, source_id string, document_id string, document_type string, carrier string, supplier string, offer_or_circular_id string, section_title string, effective_from string, effective_to string"


def chunk(no, cid, text, carrier=None, **meta):
    return (no, cid, text, (meta.get("source_id"), meta.get("document_id"), meta.get("document_type"), carrier, None, None, None))


def clause(no, cid, text, topic="refund", action="allowed", **more):
    return (no, f"r{no}", cid, text, topic, action, more.get("source_id"), None, more.get("document_type"), more.get("carrier"), None, None, None, None, None)


@pytest.fixture
def build(spark, tmp_path):
    def make(chunks, clauses):
        return HybridIndex.build(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(clauses, CLAUSE), str(tmp_path / "index"))

    return make


def model(chunks, clauses, query):
    """The scores of every chunk, by plain loops."""
    last = {}
    for c in chunks:
        if c[1]:
            last[c[1]] = c
    own = {i: [x for x in clauses if x[2] == i] for i in last}
    text = {i: " ".join(p for p in [c[2] or "", " ".join(x[3] or "" for x in own[i]), " ".join(f"{x[4] or ''} {x[5] or ''}".replace("_", " ") for x in own[i])] if p).strip() for i, c in last.items()}
    tok = lambda t: [w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 1]
    gram = lambda t: (w := re.findall(r"\w\w+", t.lower())) + [" ".join(p) for p in zip(w, w[1:])]
    n, lens = len(text), {i: len(tok(t)) for i, t in text.items()}
    avg = sum(lens.values()) / n or 1
    tf, gf = {i: Counter(tok(t)) for i, t in text.items()}, {i: Counter(gram(t)) for i, t in text.items()}
    df, dg = Counter(w for c in tf.values() for w in c), Counter(g for c in gf.values() for g in c)
    idf = {g: math.log((1 + n) / (1 + d)) + 1 for g, d in dg.items()}
    q = {g: k * idf[g] for g, k in Counter(gram(query)).items() if g in idf}
    qn = math.sqrt(sum(v * v for v in q.values()))
    out = {}
    for i in text:
        bm = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[i][w] * 2.5 / (tf[i][w] + 1.5 * (0.25 + 0.75 * lens[i] / avg)) for w in tok(query) if tf[i][w])
        norm = math.sqrt(sum((k * idf[g]) ** 2 for g, k in gf[i].items()))
        vec = sum(gf[i][g] * idf[g] * v for g, v in q.items()) / norm / qn if norm and qn else 0
        boost = 0
        for x in own[i]:
            shared = len(set(tok(query)) & set(tok(x[3] or "")))
            boost += min(1.5, 0.3 * shared) if shared else 0
            for value, gain in ((x[4], 0.5), (x[5], 0.2)):
                v = (value or "").replace("_", " ").lower()
                boost += gain if v and v in query.lower() else 0
        if not tok(query):
            boost = 0
        if bm > 0 or vec > 0 or boost > 0:
            out[i] = tuple(round(s, 6) for s in (bm, vec, boost, bm + 4 * vec + boost))
    return out


def test_ranking_fixture(spark, build):
    i = build([chunk(1, "c1", "AA refund before departure allowed with fee", "AA"), chunk(2, "c2", "Baggage policy and allowance", "BB")], [clause(1, "c1", "Refund permitted before departure with USD 50 fee", "refund", "conditional")])
    hits = i.search(spark, "AA refund before departure fee").collect()
    assert hits[0]["chunk_id"] == "c1" and hits[0]["hybrid"] > 0 and [h["rank"] for h in hits] == [1]


def test_scores_against_loops(spark, build):
    draw = random.Random(11)
    vocabulary = "refund fee Café change departure no_show x USD 50 waiver été other another".split()
    say = lambda: draw.choice([None, "", *[" ".join(draw.choices(vocabulary, k=draw.randint(1, 9))) for _ in range(6)]])
    chunks = [chunk(i, draw.choice([None, "", *[f"c{k}" for k in range(12)]]), say()) for i in range(25)]
    clauses = [clause(i, draw.choice(["", None, "zz", *[f"c{k}" for k in range(12)]]), say(), draw.choice([None, "refund", "no_show", "other"]), draw.choice([None, "allowed"])) for i in range(40)]
    i = build(chunks, clauses)
    for query in ("another refund fee fee", "no show waiver café", "zzz", "!", "été USD 50"):
        got = {r["chunk_id"]: tuple(round(r[c], 6) for c in ("bm25", "vector", "clause_boost", "hybrid")) for r in i.search(spark, query, None).collect()}
        want = model(chunks, clauses, query)
        assert got.keys() == want.keys(), query
        assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want), query


def test_ties_filters_and_duplicates(spark, build):
    same = "refund fee rule text"
    i = build([chunk(1, "a", "old"), chunk(2, "b", same, "BB"), chunk(3, "a", same, "AA"), chunk(4, None, same), chunk(5, "c", same, None)], [clause(1, "c", "x", carrier="aa")])
    assert [r["rank"] for r in i.search(spark, "fee", 2).collect()] == [1, 2]
    ranked = [r["chunk_id"] for r in i.search(spark, "text", 20).orderBy("rank").collect()]
    assert ranked.index("a") < ranked.index("b")  # the first place of the repeated id counts
    assert {r["chunk_id"] for r in i.search(spark, "refund", 5, {"carrier": "aA"}).collect()} == {"a", "c"}
    assert i.search(spark, "refund", 5, {"carrier": "", "supplier": ""}).count() == 3
    assert i.search(spark, "refund", 5, {"carrier": "zz"}).count() == 0
    with pytest.raises(ValueError):
        i.search(spark, "refund", 5, {"color": "x"})


def test_empty_corpus(spark, build):
    i = build([], [])
    assert i.search(spark, "refund").count() == 0
    assert answers.ask(spark, i, "refund").first()["answer"] == answers.NO_HITS


def test_cache_follows_the_fingerprint(spark, tmp_path):
    chunks, clauses = spark.createDataFrame([chunk(1, "a", "refund")], CHUNK), spark.createDataFrame([], CLAUSE)
    path = str(tmp_path / "i")
    i = index.cached_index(spark, chunks, clauses, path, "one")
    assert i.is_current(spark, "one") and not i.is_current(spark, "two")
    index.cached_index(spark, chunks.limit(0), clauses, path, "one")
    assert i.search(spark, "refund").count() == 1
    index.cached_index(spark, chunks.limit(0), clauses, path, "two")
    assert i.search(spark, "refund").count() == 0
    (tmp_path / "f.json").write_text("{}")
    before = index.input_fingerprint(spark, str(tmp_path / "f.json"), str(tmp_path / "absent"))
    (tmp_path / "f.json").write_text('{"a": 1}')
    assert before != index.input_fingerprint(spark, str(tmp_path / "f.json"), str(tmp_path / "absent"))


def test_answer_and_citations(spark, build):
    i = build([chunk(1, "c1", "refund text", "AA", source_id="s9", document_id="d9")], [clause(1, "c1", "Refund one"), clause(2, "c1", ""), clause(3, "c1", "Three", source_id="x")])
    row = answers.ask(spark, i, "refund").first()
    assert (row["answer"], row["hits"], row["mode"]) == ("1. Refund one", 1, "retrieval_only")
    c = row["citations"][0]
    assert (c["source_id"], c["document_id"], c["carrier"], len(c["matched_clauses"])) == ("s9", "d9", "AA", 3)
    bare = build([chunk(1, "c1", "refund text")], [])
    c = answers.citations(bare.search(spark, "refund")).first()
    assert (c["source_id"], c["document_id"], c["preview"]) == ("unknown", "unknown", "refund text")
    with pytest.raises(ValueError):
        answers.ask(spark, i, "x", 21)


def test_source_summary(spark):
    records = spark.createDataFrame([clause(1, "c", "x", source_id="b", carrier="AA"), clause(2, "c", "x", source_id="a"), clause(3, "c", "x", source_id="b", carrier="ZZ"), clause(4, "c", "x", source_id=""), clause(5, "c", "x")], CLAUSE)
    got = [(r["source_id"], r["carrier"], r["record_count"]) for r in answers.summarize_sources(records, "row_no").collect()]
    assert got == [("b", "AA", 2), ("unknown", None, 2), ("a", None, 1)]
    totals, sources = answers.list_sources(records, "row_no", 2)
    assert tuple(totals.first()) == (5, 2) and sources.count() == 2
    assert answers.filter_records(records, carrier="none").count() == 3 and answers.filter_records(records, carrier="aa").count() == 1
    with pytest.raises(ValueError):
        answers.list_sources(records, "row_no", 501)


def test_vectors(spark, tmp_path):
    v = vectors.VectorIndex(spark, str(tmp_path / "v"), 2)
    assert v.search([1, 0]).count() == 0
    v.upsert(["a", "b"], [[1, 0], [0, 1]])
    v.upsert(["a", "z"], [[0, 2], [0, 0]], ['{"k": 1}', "{}"])
    assert [(r["id"], round(r["score"], 6)) for r in v.search([0, 1], 5).collect()] == [("a", 1.0), ("b", 1.0)]
    assert [r["id"] for r in v.search([0, 1], 5, F.col("payload") != "{}").collect()] == ["a"]
    with pytest.raises(ValueError):
        v.upsert(["a"], [[1, 0], [0, 1]])


def test_keyword_index(spark, tmp_path):
    k = index.KeywordIndex(spark, str(tmp_path / "k"))
    assert k.search("refund").count() == 0
    k.index(spark.createDataFrame([("a", "refund fee", None), ("b", "fee fee", "{}"), ("c", None, None), (None, "fee", None)], "id string, text string, metadata string"))
    assert [r["id"] for r in k.search("refund fee").collect()] == ["a", "b"] and k.search("fee", 1).count() == 1
    k.index(spark.createDataFrame([("a", "nothing", '{"x": 1}')], "id string, text string, metadata string"))
    assert [r["id"] for r in k.search("refund fee").collect()] == ["b"] and k.search("nothing").first()["metadata"] == '{"x": 1}'


def test_nearest_all_against_brute_force(spark):
    draw = random.Random(2)
    rows = [(i, [draw.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 3), (63, [1.0])]
    df = spark.createDataFrame(rows, "k bigint, e array<double>")
    got = vectors.nearest_all(df, df.where("k % 20 = 0 OR k = 60"), "k", "e", 4, block=2)
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 12)
    good = [(k, e) for k, e in rows if e and len(e) == 3 and any(e)]
    want = {(q, k) for q, e in good if q % 20 == 0 for k, _ in sorted(((k, cos(e, f)) for k, f in good), key=lambda x: (-x[1], x[0]))[:4]}
    assert {(r["query_id"], r["k"]) for r in got.collect()} == want
    assert vectors.nearest_all(df, df.limit(0), "k", "e").count() == 0
