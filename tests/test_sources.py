import json

import pytest

from farelode import cli
from farelode.operators.labels import LabelLog, health, queue_response, save_response
from farelode.schema import CHUNK_SCHEMA, CLAUSE_SCHEMA, LABEL_SCHEMA
from farelode.sources import files as S
from farelode.sources.label_stores import JdbcLabels, SqliteLabels, label_backend, open_store
from farelode.streaming.feeds import stream_clauses, stream_labels

PAGE = "<html><head><title>T</title><style>p{}</style><script>if (a < b) '</p>'</script></head><body><!-- c --><p>Some HTML &amp; content<p>two&nbsp;é</body></html>"
MANIFEST = "source_id,document_id,document_type,carrier,supplier,source_filename,market,cabin,effective_from\n,d1,supplier_offer, ,Sup,A.HTML,US,mixed,2026-01-01\ns2,,nonsense,AA,,a.html ,,,\ns3,d3,other,,,,,,\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.html").write_text(PAGE)
    (tmp_path / "in" / "B.HTM").write_text("<p>x")
    (tmp_path / "in" / "c.txt").write_text("no")
    (tmp_path / "in" / "noending").write_text("no")
    (tmp_path / "in" / "d.html").write_bytes(b"<p>\xff\xfe</p>")
    (tmp_path / "m.csv").write_text(MANIFEST)
    return tmp_path


def test_html_text():
    assert S.html_text(PAGE).split("\n") == ["T", "Some HTML & content", "two\xa0é"]
    assert S.html_text("") == "" and S.html_text(None) is None and S.html_text("<script>x</script>") == "" and S.html_text("a < b") == "a < b"


def test_scan_and_quarantine(spark, folder):
    documents, quarantine = S.parse_documents(S.scan_files(spark, str(folder / "in")))
    got = {r["metadata"]["document_id"]: r for r in documents.collect()}
    assert set(got) == {"a.html", "B.HTM"} and got["a.html"]["metadata"]["document_type"] == "terms_page"
    assert got["a.html"]["metadata"]["source_id"] == str(folder / "in" / "deep" / "a.html")
    assert {r["path"].split("/")[-1]: r["reason"] for r in quarantine.collect()} == {"c.txt": "unsupported format", "noending": "unsupported format", "d.html": "not UTF-8"}
    with pytest.raises(ValueError):
        S.parse_document(spark, str(folder / "in" / "c.txt"))


def test_manifest_overlay(spark, folder):
    manifest = S.read_manifest(spark, str(folder / "m.csv"))
    assert manifest.count() == 3 and {r[0] for r in S.manifest_source_ids(manifest).collect()} == {"s2", "s3"}
    row = S.parse_document(spark, str(folder / "in" / "deep" / "a.html"), manifest).first()["metadata"]
    # the last row of the file counts as a whole; its blanks and unknown type leave what was there
    assert (row["source_id"], row["document_id"], row["document_type"], row["carrier"], row["supplier"], row["market"]) == ("s2", "a.html", "terms_page", "AA", None, None)
    assert S.read_manifest(spark, str(folder / "absent.csv")).count() == 0


def test_jsonl(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"chunk_id": "a", "text": "x"}\n\n{bad\n[1]\n5\n{"chunk_id": null, "extra": 1}\n')
    assert [r["chunk_id"] for r in S.read_jsonl(spark, str(path), CHUNK_SCHEMA).collect()] == ["a", None]
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(path), CHUNK_SCHEMA, strict=True).collect()
    assert S.read_jsonl(spark, str(tmp_path / "absent"), CHUNK_SCHEMA).count() == 0
    S.write_jsonl(spark.createDataFrame([("a", None)], "a string, b string"), str(tmp_path / "out"))
    assert [json.loads(line) for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()] == [{"a": "a", "b": None}]


def saves(spark, *rows):
    return spark.createDataFrame([tuple({f.name: r.get(f.name) for f in LABEL_SCHEMA}.values()) for r in rows], LABEL_SCHEMA)


@pytest.fixture(params=["sqlite", "jdbc", "log"])
def store(spark, tmp_path, request):
    if request.param == "sqlite":
        yield SqliteLabels(spark, str(tmp_path / "labels.db"), batch=2)
    elif request.param == "log":
        yield LabelLog(spark, str(tmp_path / "log"))
    else:  # any database that knows MERGE; the one at hand keeps long texts as CLOB
        yield JdbcLabels(spark, f"jdbc:derby:memory:l{tmp_path.name.replace('-', '')};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, "VARCHAR(30000)", text_type="VARCHAR(30000)")


def test_label_stores(spark, store, tmp_path):
    assert store.count() == 0 and store.rows().count() == 0 and store.export(str(tmp_path / "none")) == 0
    first = store.upsert(saves(spark, {"record_id": "r1", "action": "allowed", "label_status": " DONE"}, {"record_id": "0b", "exceptions": ["x", "X"]}, {"record_id": "zz"}))
    second = store.upsert(saves(spark, {"record_id": "r1", "label_status": "skip"}, {"record_id": "r9"}))
    assert {tuple(r) for r in first.collect()} == {("r1", False), ("0b", False), ("zz", False)} and {tuple(r) for r in second.collect()} == {("r1", True), ("r9", False)}
    rows = {r["record_id"]: r for r in store.labels().collect()}
    assert set(rows) == {"r1", "0b", "zz", "r9"} and (rows["r1"]["action"], rows["r1"]["label_status"], rows["0b"]["exceptions"]) == (None, "skip", ["x"]) and store.count() == 4
    assert store.export(str(tmp_path / "out")) == 4 and store.import_if_empty(saves(spark, {"record_id": "more"})) == 0
    with pytest.raises(ValueError):
        store.upsert(saves(spark, {"record_id": " "}))
    header, shown = queue_response(spark.createDataFrame([("r1",), ("zz",), ("new",), (None,)], "record_id string"), store)
    assert tuple(header.first()) == (store.backend, 4, 3, 2, 1, 1) and {r["record_id"]: r["manual_label"] is not None for r in shown.collect()} == {"r1": True, "zz": True, "new": False}
    header, shown = queue_response(spark.createDataFrame([("r1",), ("zz",), ("new",), (None,)], "record_id string"), store, include_labeled=False)
    assert tuple(header.first()) == (store.backend, 1, 1, 0, 0, 1)
    answer = save_response(store, saves(spark, {"record_id": "r1", "carrier": " AA "})).first()
    assert (answer["record_id"], answer["saved"], answer["updated"], answer["backend"], answer["record"]["carrier"]) == ("r1", True, True, store.backend, "AA") and health(store).first()["labels"] == 4


def test_bootstrap_order(spark, tmp_path):
    gold, db = tmp_path / "gold.jsonl", str(tmp_path / "l.db")
    gold.write_text('{"record_id": "g"}\n{broken\n{"record_id": ""}\n')
    jdbc = lambda n: JdbcLabels(spark, f"jdbc:derby:memory:{n}{tmp_path.name.replace('-', '')};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, "VARCHAR(30000)", text_type="VARCHAR(30000)")
    assert [r["record_id"] for r in open_store(spark, "postgres", sqlite=db, jdbc=jdbc("a"), gold_file=str(gold)).rows().collect()] == ["g"]  # the SQLite file is empty
    SqliteLabels(spark, db).upsert(saves(spark, {"record_id": "s"}))
    assert [r["record_id"] for r in open_store(spark, " Postgres", sqlite=db, jdbc=jdbc("b"), gold_file=str(gold)).rows().collect()] == ["s"]
    assert [r["record_id"] for r in open_store(spark, "sqlite", sqlite=db, gold_file=str(gold)).rows().collect()] == ["s"]
    assert [r["record_id"] for r in open_store(spark, None, sqlite=str(tmp_path / "new.db"), gold_file=str(gold)).rows().collect()] == ["g"]
    assert [r["record_id"] for r in open_store(spark, "jsonl", log=str(tmp_path / "log"), gold_file=str(gold)).rows().collect()] == ["g"]
    for wrong in ({"backend": "postgres"}, {"backend": "sqlite"}, {"backend": "jsonl"}):
        with pytest.raises(ValueError):
            open_store(spark, **wrong)
    assert [label_backend(x) for x in (None, "Postgres ", "x", "jsonl")] == ["sqlite", "postgres", "sqlite", "jsonl"]


def test_streams(spark, tmp_path):
    (tmp_path / "chunks").mkdir()
    chunk = {"chunk_id": "c1", "text": "Refund is permitted. No change is allowed here.", "metadata": {"source_id": "s", "document_id": "d", "document_type": "other"}}
    (tmp_path / "chunks" / "1.jsonl").write_text(json.dumps(chunk) + "\n{bad\n")
    go = lambda: stream_clauses(spark, str(tmp_path / "chunks"), str(tmp_path / "records"), str(tmp_path / "cp")).awaitTermination()
    go()
    (tmp_path / "chunks" / "2.jsonl").write_text(json.dumps(chunk | {"chunk_id": "c2"}) + "\n")
    go()
    go()
    got = spark.read.schema(CLAUSE_SCHEMA).parquet(str(tmp_path / "records"))
    assert sorted(r["record_id"] for r in got.collect()) == ["c1:0", "c1:1", "c2:0", "c2:1"]
    (tmp_path / "saves").mkdir()
    (tmp_path / "saves" / "1.jsonl").write_text('{"record_id": "r", "action": "allowed"}\n{"record_id": " "}\n')
    log = LabelLog(spark, str(tmp_path / "log"))
    for _ in range(2):
        stream_labels(spark, str(tmp_path / "saves"), log, str(tmp_path / "cp2")).awaitTermination()
    assert [(r["record_id"], r["action"]) for r in log.labels().collect()] == [("r", "allowed")]


def test_command_line(spark, folder):
    out = lambda n: str(folder / n)
    assert cli.run(spark, ["ingest", "--input", out("in"), "--output", out("chunks"), "--manifest", out("m.csv"), "--max-tokens", "10", "--overlap", "2"])["chunks"] == 2
    assert cli.run(spark, ["extract", "--input", out("chunks"), "--output", out("records")])["records"] == 2
    status = cli.run(spark, ["queue", "--manifest", out("absent.csv"), "--chunks", out("chunks"), "--clauses", out("records"), "--output", out("queue"), "--limit", "1"])
    assert status == {"status": "ok", "queued_records": 1}
    assert cli.run(spark, ["evaluate", "--gold", out("records"), "--pred", out("records"), "--fields", "action"])["overall_field_accuracy"] == 1.0
    assert cli.run(spark, ["compare", "--pred", out("records"), "--manual-gold", out("absent")])["status"] == "blocked"
    assert cli.run(spark, ["compare", "--pred", out("records"), "--manual-gold", out("records")])["manual_gold_backend"] == "jsonl"
