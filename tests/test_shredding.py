import json

import pytest

from farelode.operators.shredding import _dumps, _loads_deep, decode, document_plan, element_name, inline_plan, is_blank, parse, rejected_documents, schema_graph, shred, structural_edges

ORDER = {
    "orderId": 7, "customer": {"name": "a", "address": {"city": "b"}},
    "lines": [{"sku": "x", "parts": [{"sku": "p"}, {"sku": "q", "parts": [{"sku": "r"}]}]}, None, {"sku": "y", "parts": []}],
    "address": {"city": "c"},
}


def rows(spark, documents, plan=None, tables=None, **always):
    df = spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d), "extra") for i, d in enumerate(documents)], "id bigint, body string, fields string")
    plan = plan or inline_plan(schema_graph(df, "body").collect(), **always)
    return plan, [r.asDict() for r in shred(df, "id", "body", plan, tables).collect()]


def test_names():
    assert element_name("penaltyTiers") == element_name("penalty_tiers") == element_name("Penalty-Tiers") == "penalty_tiers"
    assert element_name("ABC") == "abc" and element_name("") == "_"


def test_shared_and_recursive_elements_have_tables(spark):
    plan, found = rows(spark, [ORDER])
    assert plan.tables == {"lines", "parts", "address"}  # repeated, recursive, shared
    assert plan.recursive == {"parts"}
    by = {}
    for r in found:
        by.setdefault(r["table_name"], []).append(r)
    assert by["document"][0]["fields"] == {"order_id": "7", "customer.name": "a"}
    assert [(r["ordinal"], r["is_empty"], r["fields"].get("sku")) for r in sorted(by["lines"], key=lambda r: r["ordinal"])] == [(0, False, "x"), (1, True, None), (2, False, "y")]
    assert {(r["row_key"], r["parent_table"], r["parent_key"]) for r in by["parts"]} == {("/lines.0/parts.0", "lines", "/lines.0"), ("/lines.0/parts.1", "lines", "/lines.0"), ("/lines.0/parts.1/parts.0", "parts", "/lines.0/parts.1")}
    assert sorted(r["fields"]["city"] for r in by["address"]) == ["b", "c"]
    keys = {(r["doc_key"], r["row_key"]) for r in found}
    assert len(keys) == len(found)
    assert all((r["doc_key"], r["parent_key"]) in keys for r in found if r["parent_key"] is not None)


def test_the_plan_needs_only_the_structure(spark):
    df = spark.createDataFrame([(json.dumps(ORDER),), (json.dumps({"saves": [{f"k{i}": i for i in range(50)}]}),), ('{"a": {"b": {"a": 1}}}',), ('{"x": {"y": {"x": {"z": 1}}}}',)], "body string")
    edges = schema_graph(df, "body")
    some = structural_edges(edges).collect()
    assert inline_plan(some) == inline_plan(edges.collect()) and len(some) <= edges.count() - 50  # none of the plain keys


def test_running_numbers_follow_the_document(spark):
    body = {"batches": [{"saves": [{"tiers": [1]}, {"tiers": [2, 3]}]}, {"saves": [{"tiers": [4]}]}]}
    _, found = rows(spark, [body, body])
    got = [(r["doc_key"], r["numbers"]["saves"], r["ordinal"], r["fields"]["value"]) for r in found if r["table_name"] == "tiers"]
    assert sorted(got) == [(d, *x) for d in (0, 1) for x in ((0, 0, "1"), (1, 0, "2"), (1, 1, "3"), (2, 0, "4"))]


def test_encoded_text_counts_like_what_it_encodes(spark):
    plain = {"saves": [{"tiers": [{"a": 1}, {"a": 2}]}]}
    texts = [plain, json.dumps(json.dumps(plain)), {"saves": [{"tiers": json.dumps([{"a": 1}, {"a": 2}])}]}, {"saves": json.dumps([json.dumps(plain["saves"][0])])}]
    plan, found = rows(spark, texts, always=("saves", "tiers"))
    for i in range(len(texts)):
        assert sorted((r["ordinal"], r["fields"]["a"]) for r in found if r["doc_key"] == i and r["table_name"] == "tiers") == [(0, "1"), (1, "2")]


@pytest.mark.parametrize("text", [None, "", "  ", "{", '{"a": [1,', "[1, 2", "nonsense", '{"a": NaN}', "1", '"x"', "null"])
def test_nothing_comes_of_no_document(spark, text):
    _, found = rows(spark, [text])
    assert found == []


def test_broken_lists_in_valid_documents_are_no_elements(spark):
    _, found = rows(spark, [{"tiers": '[{"a": 1}, {"b"'}, {"tiers": "plain"}, {"tiers": {"a": 1}}, {"tiers": None}], always=("tiers",))
    assert [(r["doc_key"], r["ordinal"], r["fields"]) for r in found if r["table_name"] == "tiers"] == [(1, 0, {"value": "plain"}), (2, 0, {"a": "1"})]


def test_deep_nesting_and_long_texts(spark):
    deep = {"a": None}
    for _ in range(300):
        deep = {"x": [deep]}
    _, found = rows(spark, [deep, {"t": "y" * 200_000}])
    assert sum(r["table_name"] == "x" for r in found) == 300
    assert any(len(r["fields"].get("t") or "") == 200_000 for r in found)


def test_empty_table(spark):
    plan, found = rows(spark, [])
    assert found == [] and plan.tables == frozenset()


def test_blank_and_decode():
    assert is_blank({"a": " ", "b": [None, {}]}) and not is_blank({"a": 0})
    assert decode('"[1]"') == [1] and decode("[1") is None and decode('"x"') == '"x"' and decode("x") == "x"
    assert parse('﻿{"a": 1}') == {"a": 1}


def test_texts_and_numbers_among_items_are_items(spark, tmp_path):
    from farelode.plans.quality_queries import p4_found

    payload = json.dumps({"penalty_tiers": ["50 EUR", {"value": 3}, None, " ", 7, {"amount": 1}], "refund_payout_options": ["voucher", {"value": ""}]})
    spark.createDataFrame([(1, payload)], "row_no bigint, payload_json string").write.parquet(str(tmp_path / "manual_labels.parquet"))
    spark.createDataFrame([], "request_id bigint, body_json string").write.parquet(str(tmp_path / "label_save_requests.parquet"))
    rows = [(r["child_kind"], r["item_no"]) for r in p4_found(spark, str(tmp_path)).collect()]
    first = min(n for _, n in rows)
    assert sorted((k, n - first) for k, n in rows) == [("penalty_tiers", 0), ("penalty_tiers", 1), ("penalty_tiers", 4), ("penalty_tiers", 5), ("refund_payout_options", 0)]


@pytest.mark.parametrize("depth", [1_000, 50_000])
def test_no_depth_loses_a_document(spark, depth):
    """As objects, lists and singletons; nothing is lost and nothing fails."""
    deep = {"objects": '{"x": [' * depth + '{"a": 1}' + "]}" * depth, "lists": '{"y": ' + "[" * depth + "1" + "]" * depth + ', "z": {"b": " "}}'}
    df = spark.createDataFrame([(i, d) for i, d in enumerate(deep.values())], "id bigint, body string")
    plan, _ = document_plan(df, "body")
    assert plan.tables == {"x", "y"} and rejected_documents(df, "id", "body").count() == 0
    found = shred(df, "id", "body", plan, ("x",)).select("row_key", "parent_key", "is_empty").collect()
    assert len(found) == depth and len({r["row_key"] for r in found}) == depth and not any(r["is_empty"] for r in found)
    assert {r["parent_key"] for r in found} - {r["row_key"] for r in found} == {""}


def test_the_deep_reader_is_the_usual_one():
    for text in ('{"a": [1, -2.5e3, true, null, "x\\u0041\\n"], "b": {}, "c": [[], {"d": {"e": ""}}]}', " [ ] ", '"x"', "0", '{"a":1,"a":2}'):
        assert _loads_deep(text) == json.loads(text) and _dumps(json.loads(text)) == json.dumps(json.loads(text), ensure_ascii=False)
    for text in ("", "{", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "01", "1 2", "NaN", "[}", '{1: 2}'):
        with pytest.raises(ValueError):
            _loads_deep(text)
    deep = "[" * 30_000 + '{"k": "v"}' + "]" * 30_000
    assert _dumps(_loads_deep(deep)) == deep
    known = {}
    blank = {"a": [{"b": " "}], "c": None}
    assert is_blank(blank, known) and is_blank(blank["a"], known) and len(known) == 3 and not is_blank([[], [0]], known)


def test_members_named_by_data_are_entries_of_a_map(spark):
    bodies = [{"labels": {f"id{i}-{k}": {"tiers": [i, k], "by": {f"u{i}": {"n": [1]}}} for k in range(6)}, "meta": {"v": 1}} for i in range(5)]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "id bigint, body string")
    plan, edges = document_plan(df, "body", map_members=4)
    assert plan.maps == {"labels", "by"} and edges.count() < 10
    assert plan.tables >= {"labels.entries", "tiers", "by.entries", "n"}
    rows_ = shred(df, "id", "body", plan).collect()
    entries = [r for r in rows_ if r["table_name"] == "labels.entries"]
    assert sorted(r["fields"]["_key"] for r in entries) == sorted(k for b in bodies for k in b["labels"])
    tiers = [r for r in rows_ if r["table_name"] == "tiers"]
    assert len(tiers) == 60 and {(r["doc_key"], r["parent_key"]) for r in tiers} == {(r["doc_key"], r["row_key"]) for r in entries}
    plain, _ = document_plan(df, "body")
    assert not plain.maps


def test_the_graph_decides_and_requests_only_add(spark):
    df = spark.createDataFrame([(1, '{"a": [1], "b": {"c": 1}}')], "id bigint, body string")
    plan, _ = document_plan(df, "body", always=("a", "b"))
    assert plan.tables == {"a", "b"} and plan.requested == {"b"}


def test_rejected_documents_are_listed(spark):
    texts = ['{"a": 1}', "[]", "{", '"{"', "5", "null", '"x"', "", None, " ", '{"a": NaN}', '"{\\"a\\": 1}"']
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, body string")
    assert {(r["doc_key"], r["reason"]) for r in rejected_documents(df, "id", "body").collect()} == {(2, "not_json"), (3, "not_json"), (4, "no_record"), (5, "no_record"), (6, "no_record"), (10, "not_json")}
