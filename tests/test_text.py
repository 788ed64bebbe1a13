import random
import re

import pytest
from pyspark.sql import functions as F

from farelode.functions import extract as E
from farelode.functions import text as X
from farelode.operators.clauses import chunk_documents, extract_records
from farelode.schema import CHUNK_SCHEMA, CLAUSE_FIELDS, METADATA_FIELDS


def values(spark, expression, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def one(spark, expression, text):
    return values(spark, expression, [text])[0]


@pytest.mark.parametrize(
    "text, clauses",
    [
        ("Refund permitted before departure with USD 50 fee; After departure no refund. Taxes are refundable.", ["Refund permitted before departure with USD 50 fee", "After departure no refund.", "Taxes are refundable."]),
        (";;;", [";;;"]), ("", []), (None, []), ("  \n ", []), ("One two. Three", ["One two. Three"]), ("Fee is due. Ok then.", ["Fee is due. Ok then."]),
        ("A. B. C. D.", ["A. B. C. D."]), ("one two three\r\nfour five six\rseven", ["one two three", "four five six seven"]), ("• First item here\n- Second item here", ["First item here", "Second item here"]),
        ("No lower. case split here", ["No lower. case split here"]), ("a b c.  9 d e f", ["a b c.", "9 d e f"]), ("x;" * 3, ["x x x"]),
    ],
)
def test_clauses(spark, text, clauses):
    assert one(spark, X.split_clauses, text) == clauses


def model_windows(tokens, size, overlap):
    out, i = [], 0
    while tokens:
        end = min(i + size, len(tokens))
        out.append((i, end, " ".join(tokens[i:end])))
        if end == len(tokens):
            break
        i = end - overlap
    return out


def test_windows_against_a_loop(spark):
    draw = random.Random(3)
    texts = [draw.choice([" ", "\n", " 　"]).join(f"w{i}" for i in range(n)) for n in (0, 1, 9, 10, 11, 17, 18, 25, 26, 33, 100)]
    for size, overlap in ((10, 2), (5, 0), (7, 6)):
        got = values(spark, lambda c, s=size, o=overlap: X.token_windows(c, s, o), [None, *texts])
        assert [[tuple(w) for w in g] for g in got] == [model_windows((t or "").split(), size, overlap) for t in [None, *texts]]
    with pytest.raises(ValueError):
        X.token_windows(F.lit(""), 10, 10)


def test_tokens_and_grams(spark):
    assert one(spark, X.search_tokens, "A USD50 café x9, no_show") == ["usd50", "caf", "x9", "no", "show"]
    assert one(spark, X.grams, "Ab cd é é2") == ["ab", "cd", "é2", "ab cd", "cd é2"]
    assert one(spark, X.grams, None) == [] and one(spark, X.grams, "ab") == ["ab"]


TOPICS = {
    "No-show fee": "no_show", "A no show and a refund": "no_show", "go show": "go_show", "re-book it": "reissue_change", "Change of date": "reissue_change", "changes": "reissue_change",
    "changed refund": "refund", "échanges": "other", "changeable": "other", "rebooking": "other", "cancelled": "cancellation", "WAIVED": "waiver", "": "other",
}
ACTIONS = {
    "Refund not permitted": "not_allowed", "not refundable": "allowed", "refundable if unused": "conditional", "permitted with a fee": "conditional", "permitted, fees vary": "allowed",
    "subject to rules": "conditional", "a fee": "conditional", "fees": "unknown", "forfeited": "not_allowed", "": "unknown",
}


def test_classifiers(spark):
    assert values(spark, E.policy_topic, list(TOPICS)) == list(TOPICS.values())
    assert values(spark, E.policy_action, list(ACTIONS)) == list(ACTIONS.values())
    assert values(spark, E.policy_topic, [None]) == ["other"]
    assert values(spark, E.time_window, ["after departure and before departure", "within 24 hrs", "x"]) == ["before departure", "within 24 hrs", None]
    assert values(spark, E.departure_side, ["prior to departure, after no-show", "before  departure", "after departure", ""]) == ["both", "before_departure", "after_departure", None]


def test_tax_rules(spark):
    texts = ["Only taxes are refunded", "Taxes are non-refundable", "not refundable: tax", "not refundable, the taxes", "Taxes refundable", "refundable taxes", "tax only", "refundable"]
    assert values(spark, E.tax_refund_rule, texts) == ["only taxes refundable", "taxes non-refundable", None, "taxes non-refundable", "taxes refundable", "taxes refundable", None, None]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("full forfeiture of USD 5", ("forfeiture", None, None, None, None)), ("free of charge", ("free", None, None, None, None)), ("fare difference only", ("fare_difference_only", None, None, None, True)),
        ("12.5 % of USD 9", ("percentage", None, None, 12.5, None)), ("pay usd50 now", ("fixed_amount", 50.0, "USD", None, None)), ("$35.50 or EUR 20", ("fixed_amount", 35.5, "USD", None, None)),
        ("EUR 35.00 or $20", ("fixed_amount", 35.0, "EUR", None, None)), ("USD 50.5x", ("fixed_amount", 50.0, "USD", None, None)), ("plus fare difference", (None, None, None, None, True)), ("", (None,) * 5), (None, (None,) * 5),
    ],
)
def test_penalties(spark, text, expected):
    assert tuple(one(spark, E.penalty, text)) == expected


def test_snippets(spark):
    text = "Refund only if unused, subject to approval with USD 35.00; if late. Except for infants. Does not apply to groups unless booked"
    assert one(spark, E.eligibility_conditions, text) == ["subject to approval", "only if unused, subject to approval", "if unused, subject to approval", "if late"]
    assert one(spark, E.exceptions, text) == ["Except for infants", "Does not apply to groups unless booked", "unless booked"]
    assert one(spark, E.eligibility_conditions, None) == [] and one(spark, E.exceptions, "x") == []
    assert one(spark, E.exceptions, "Unless late; UNLESS LATE; unless  late") == ["Unless late"]


def chunk(spark, *texts, **meta):
    row = {n: meta.get(n) for n in METADATA_FIELDS} | {"source_id": "s", "document_id": "d", "document_type": "fare_rule"}
    return spark.createDataFrame([(f"chunk-{i}", t, row, None, None) for i, t in enumerate(texts, 1)], CHUNK_SCHEMA)


def test_records(spark):
    got = extract_records(chunk(spark, "Refund permitted before departure with USD 50 fee.", cabin="economy", carrier="AA")).collect()[0]
    want = {"record_id": "chunk-1:0", "policy_topic": "refund", "action": "conditional", "penalty_type": "fixed_amount", "penalty_amount": 50.0, "penalty_currency": "USD", "before_after_departure": "before_departure", "time_window": "before departure", "needs_review": False, "confidence": 0.8, "carrier": "AA", "cabin": None, "notes": None}
    assert {k: got[k] for k in want} == want
    stub = extract_records(chunk(spark, "Refunds not permitted after no-show."), "stub").collect()[0]
    assert (stub["record_id"], stub["policy_topic"], stub["action"], stub["needs_review"], stub["confidence"]) == ("chunk-1:0", "other", "unknown", True, None)
    assert [f.name for f in extract_records(chunk(spark, "")).schema] == [n for n, _ in CLAUSE_FIELDS]


def test_chunks_without_clauses_keep_one(spark):
    got = [(r["record_id"], r["clause_text"]) for r in extract_records(chunk(spark, None, "", ";;;", "One two three. Four five six.")).orderBy("record_id").collect()]
    assert got == [("chunk-1:0", None), ("chunk-2:0", ""), ("chunk-3:0", ";;;"), ("chunk-4:0", "One two three."), ("chunk-4:1", "Four five six.")]
    with pytest.raises(ValueError):
        extract_records(chunk(spark, "x"), "other")


def test_document_chunks_have_stable_ids(spark):
    docs = chunk(spark, " ".join(f"w{i}" for i in range(80)), None).select("text", "metadata")
    a, b = (sorted(map(tuple, chunk_documents(docs, 50, 10).select("chunk_id", "start_token", "end_token", "metadata.chunk_id", "metadata.section_title").collect())) for _ in range(2))
    assert a == b and sorted((r[1], r[2]) for r in a) == [(0, 50), (40, 80)] and all(r[0] == r[3] and r[4] == "" for r in a) and len({r[0] for r in a}) == 2


def test_very_long_text(spark):
    text = "Refund is permitted. " * 5000
    assert len(one(spark, X.split_clauses, text)) == 5000
    assert re.match("Refund", one(spark, X.split_clauses, text)[-1])


def test_numbers_or_zero(spark):
    from farelode.functions.text import number_or_zero

    rows = spark.createDataFrame([("1.5",), ("x",), (None,), ("",), ("-2",)], "v string")
    assert [r[0] for r in rows.select(number_or_zero(rows["v"])).collect()] == [1.5, 0.0, 0.0, 0.0, -2.0]
