import json

import pytest
from pyspark.sql import functions as F

from farelode.operators import evaluation as V
from farelode.operators import labels as L
from farelode.schema import CLAUSE_SCHEMA, LABEL_SCHEMA, QUEUE_SCHEMA

CHUNK = "row_no bigint, chunk_id string, text string"


def label(**values):
    return {f.name: values.get(f.name) for f in LABEL_SCHEMA}


def frame(spark, *rows):
    return spark.createDataFrame([tuple(label(**r).values()) for r in rows], LABEL_SCHEMA)


def clauses(spark, *rows):
    return spark.createDataFrame([tuple({f.name: r.get(f.name) for f in CLAUSE_SCHEMA}.values()) for r in rows], CLAUSE_SCHEMA)


TIER = (" 0-3 days ", " ", "fixed_amount", 10.0, "USD", None, None, "")
OPTION = (" voucher", None, None, None, None, None, None, None, None)


def test_normalization(spark):
    row = L.normalize_labels(frame(spark, {
        "record_id": " r1", "carrier": "  ", "label_status": " DONE ", "eligibility_conditions": ["a ", None, "A", "", "b"], "exceptions": [" "], "penalty_tiers": [TIER, (None,) * 8, (" ",) * 3 + (None,) * 5],
        "refund_payout_options": [OPTION], "penalty_amount": 5.0,
    })).first()
    assert (row["record_id"], row["carrier"], row["label_status"], row["eligibility_conditions"], row["exceptions"]) == (" r1", None, "done", ["a", "b"], None)
    assert [tuple(t) for t in row["penalty_tiers"]] == [("0-3 days", None, "fixed_amount", 10.0, "USD", None, None, None)]
    assert row["refund_payout_options"][0]["method"] == "voucher"


def test_log_replaces_whole_records(spark, tmp_path):
    log = L.LabelLog(spark, str(tmp_path / "log"))
    assert log.count() == 0 and log.labels().count() == 0
    first = log.upsert(frame(spark, {"record_id": "r1", "action": "allowed", "eligibility_conditions": ["x", "X"]}, {"record_id": "r2", "label_status": "Skip"}))
    assert {tuple(r) for r in first.collect()} == {("r1", False), ("r2", False)}
    second = log.upsert(frame(spark, {"record_id": "r1", "policy_topic": "refund"}))
    assert [tuple(r) for r in second.collect()] == [("r1", True)]
    rows = {r["record_id"]: r for r in log.labels().collect()}
    assert rows["r1"]["action"] is None and rows["r1"]["policy_topic"] == "refund" and rows["r2"]["label_status"] == "skip" and log.count() == 2
    with pytest.raises(ValueError):
        log.upsert(frame(spark, {"record_id": " "}))


def test_import_only_into_an_empty_log(spark, tmp_path):
    log = L.LabelLog(spark, str(tmp_path / "log"))
    assert log.import_if_empty(frame(spark, {"record_id": "a"}, {"record_id": ""}, {"record_id": None})) == 1
    assert log.import_if_empty(frame(spark, {"record_id": "b"})) == 0 and log.count() == 1


def test_payloads(spark):
    rows = spark.createDataFrame([("c1", '{"record_id": "p1", "action": "x", "other": 1}', None), ("c2", "{broken", None), ("c3", "{}", None), ("", "{}", None), ("c5", None, None), ("c6", "[1]", None)], "record_id string, payload_json string, label_status string")
    assert [(r["record_id"], r["label"]["record_id"], r["label"]["action"]) for r in L.parse_labels(rows).orderBy("record_id").collect()] == [("c3", "c3", None), ("p1", "p1", "x")]


def test_queue(spark):
    cl = clauses(spark, *[{"record_id": r, "source_id": s, "chunk_id": c, "clause_text": "t", "policy_topic": "refund"} for r, s, c in [("r3", "s2", "c1"), ("r1", None, "c1"), ("r2", "s1", "c2"), ("r4", "s1", "absent"), ("r5", "s1", "c2"), ("r6", "s9", "c2")]])
    ch = spark.createDataFrame([(1, "c1", "one"), (2, "c2", None)], CHUNK)
    labeled = spark.createDataFrame([("r5",)], "record_id string")
    status, queue = L.build_queue(cl, ch, "row_no", labeled)
    assert status == {"status": "ok", "queued_records": 4} and [r["record_id"] for r in queue.collect()] == ["r1", "r2", "r3", "r6"]  # a null source sorts as None
    assert queue.first()["chunk_text"] == "one" and queue.first()["heuristic"]["exceptions"] == [] and [f.name for f in queue.schema] == [f.name for f in QUEUE_SCHEMA]
    status, queue = L.build_queue(cl, ch, "row_no", labeled, spark.createDataFrame([("s1",)], "source_id string"), 1)
    assert [r["record_id"] for r in queue.collect()] == ["r2"]
    assert L.build_queue(cl, ch, "row_no", labeled, spark.createDataFrame([], "source_id string"))[0]["queued_records"] == 4  # no ids, no restriction
    assert L.build_queue(cl.limit(0), ch, "row_no", labeled)[0]["reason"] == "missing_chunks_or_clauses"


def test_made_up_chunks_block(spark):
    ch = lambda *ids: spark.createDataFrame([(i, c, "t") for i, c in enumerate(ids)], CHUNK)
    assert L.is_synthetic(ch("pilot_chunk_1", "", None), "row_no") and L.is_synthetic(ch("", None), "row_no")
    assert not L.is_synthetic(ch(), "row_no") and not L.is_synthetic(ch("pilot_chunk_1", "x"), "row_no")
    assert L.is_synthetic(ch(*[f"pilot_chunk_{i}" for i in range(20)], "real"), "row_no")
    cl = clauses(spark, {"record_id": "r", "chunk_id": "pilot_chunk_1"})
    assert L.build_queue(cl, ch("pilot_chunk_1"), "row_no", spark.createDataFrame([], "record_id string"))[0]["reason"] == "synthetic_chunks_detected"


def test_flags(spark):
    queue = spark.createDataFrame([("a",), ("b",), ("c",), ("",), (None,)], "record_id string")
    labels = spark.createDataFrame([("a", "SKIP"), ("b", None)], "record_id string, label_status string")
    assert {tuple(r) for r in L.queue_flags(queue, labels).collect()} == {("a", True, True), ("b", True, False), ("c", False, False)}
    assert [r[0] for r in L.queue_flags(queue, labels, include_labeled=False).collect()] == ["c"]
    assert tuple(L.queue_counts(L.queue_flags(queue, labels)).first()) == (3, 2, 1, 1)


def test_accuracy_fixture(spark):
    gold = frame(spark, *[{"record_id": r, "policy_topic": "refund", "penalty_type": "free", "action": "allowed"} for r in "ab"])
    pred = frame(spark, {"record_id": "a", "policy_topic": "refund", "penalty_type": "free", "action": "allowed"}, {"record_id": "b", "policy_topic": "refund", "penalty_type": "free", "action": "unknown"}, {"record_id": "c"})
    r = V.evaluate(gold, pred)
    assert (r["gold_records"], r["matched_records"], r["extra_prediction_records"], r["missing_predictions_for_gold_records"]) == (2, 2, 1, 0)
    assert r["per_field_accuracy"]["action"] == 0.5 and r["per_field_accuracy"]["policy_topic"] == 1.0 and r["per_field_accuracy"]["penalty_amount"] is None
    assert r["overall_field_accuracy"] == pytest.approx(5 / 6)


def test_accuracy_of_values(spark):
    gold = frame(spark, {"record_id": "a", "penalty_amount": 50.0, "penalty_percent": 0.0000005, "eligibility_conditions": [], "exceptions": ["x", "y"], "fare_difference_required": True})
    pred = frame(spark, {"record_id": "a", "penalty_amount": 50.0000001, "penalty_percent": 0.0, "eligibility_conditions": [], "exceptions": ["y", "x"]})
    s = {r["field"]: (r["correct"], r["total"], r["missing_pred_value"]) for r in V.field_accuracy(gold, pred).collect()}
    assert s["penalty_amount"] == (1, 1, 0) and s["penalty_percent"] == (1, 1, 0)  # half goes to even
    assert s["eligibility_conditions"] == (1, 1, 0) and s["exceptions"] == (0, 1, 0) and s["fare_difference_required"] == (0, 1, 1) and s["action"] == (0, 0, 0)
    with pytest.raises(ValueError):
        V.evaluate(gold, frame(spark, {"record_id": ""}))


def test_compare(spark):
    pred = frame(spark, {"record_id": "a", "action": "allowed"})
    good, skipped = frame(spark, {"record_id": "a", "action": "allowed"}, {"record_id": "b", "label_status": "SKIP"}), frame(spark, {"record_id": "b", "label_status": "skip"})
    r = V.compare(pred, [("postgres", None), ("sqlite", good)], None)
    assert (r["status"], r["manual_gold_backend"], r["gold_records"], r["overall_field_accuracy"]) == ("ok", "sqlite", 1, 1.0)
    assert V.compare(pred, [("postgres", skipped), ("sqlite", good)], None) == {"status": "blocked", "reason": "manual_gold_empty", "manual_gold_backend": "postgres"}
    assert V.compare(pred, [], None)["status"] == "blocked" and V.compare(pred, [], good.limit(0))["status"] == "blocked"
    r = V.compare(pred, [("sqlite", good.limit(0))], skipped)  # a file of skipped labels is no block
    assert (r["status"], r["gold_records"], r["overall_field_accuracy"], r["manual_gold_backend"]) == ("ok", 0, None, "jsonl")


def test_latest(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", None, "w")], "k string, seq int, v string")
    assert {tuple(r) for r in L.latest(rows, "k", "seq").select("k", "v").collect()} == {("a", "y"), ("b", "w")}
    assert json.loads(rows.select(F.to_json(F.struct("k"))).first()[0]) == {"k": "a"}
