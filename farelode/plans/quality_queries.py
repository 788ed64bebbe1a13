"""Queries on references that lead nowhere (p2) and on nested label payloads (p4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelode.operators.references import orphan_references, orphan_report
from farelode.operators.shredding import InlinePlan, document_plan, rejected_documents, shred
from farelode.plans import quality_sql
from farelode.tables import table

CHILD_KINDS = ("penalty_tiers", "refund_payout_options", "eligibility_conditions", "exceptions")
SAVES = "saves"


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses without their chunk and labels without their clause: missing, deleted or late."""
    clauses = table(spark, folder, "policy_clauses")
    by_chunk = orphan_references(clauses, "policy_clauses", "chunk_id", "ingested_at", table(spark, folder, "chunks"), "chunk_id")
    by_record = orphan_references(table(spark, folder, "manual_labels"), "manual_labels", "record_id", "updated_at", clauses, "record_id")
    return by_chunk.unionByName(by_record)


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, month and kind."""
    return orphan_report(p2_found(spark, folder))


def label_plan(spark: SparkSession, folder: str) -> tuple[InlinePlan, DataFrame]:
    """The plan and the schema graph of label payloads and save requests together.

    The graph decides. The save and the four kinds of items are asked for besides, as tables where no document repeats them.
    """
    both = table(spark, folder, "manual_labels").select(F.col("payload_json").alias("body")).unionAll(table(spark, folder, "label_save_requests").select(F.col("body_json").alias("body")))
    return document_plan(both, "body", always=(SAVES, *CHILD_KINDS))


def label_rows(spark: SparkSession, folder: str, tables: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of all tables, of both sources, with ``source_table``."""
    plan, _ = label_plan(spark, folder)
    labels = shred(table(spark, folder, "manual_labels"), "row_no", "payload_json", plan, tables)
    requests = shred(table(spark, folder, "label_save_requests"), "request_id", "body_json", plan, tables)
    return labels.select(F.lit("manual_labels").alias("source_table"), "*").unionAll(requests.select(F.lit("label_save_requests").alias("source_table"), "*"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every item of the four kinds that is not empty, with its document, its save and its position."""
    rows = label_rows(spark, folder, CHILD_KINDS).where("NOT is_empty")
    return rows.select(
        F.col("source_table").alias("table_name"),
        F.col("doc_key").alias("row_no"),
        F.when(F.col("source_table") == "manual_labels", 0).otherwise(F.coalesce(F.col("numbers")[SAVES], F.col("numbers")["item"], F.lit(0))).alias("save_no"),
        F.col("table_name").alias("child_kind"),
        F.col("ordinal").alias("item_no"),
    )


def p4_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The schema graph with the decision taken for each element."""
    plan, edges = label_plan(spark, folder)

    def among(elements: frozenset[str]) -> Column:
        return F.array_contains(F.lit(sorted(elements)) if elements else F.array().cast("array<string>"), F.col("child"))

    return edges.withColumns({"own_table": among(plan.tables), "only_requested": among(plan.requested)})


def p4_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All flat rows: document, saves and items, with their keys and inlined values."""
    return label_rows(spark, folder).select("source_table", "doc_key", "table_name", "row_key", "parent_table", "parent_key", "ordinal", F.to_json("fields").alias("fields_json"), "is_empty")


def p4_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The keys of all flat rows: table, own key, parent and position."""
    return label_rows(spark, folder).select("source_table", "doc_key", "table_name", "row_key", "parent_table", "parent_key", "ordinal")


def p4_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """The payloads and requests that are no JSON records."""
    labels = rejected_documents(table(spark, folder, "manual_labels"), "row_no", "payload_json")
    requests = rejected_documents(table(spark, folder, "label_save_requests"), "request_id", "body_json")
    both = labels.select(F.lit("manual_labels").alias("table_name"), "*").unionAll(requests.select(F.lit("label_save_requests").alias("table_name"), "*"))
    return both.withColumnRenamed("doc_key", "row_no")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p4_found": p4_found,
    "p4_graph": p4_graph,
    "p4_tables": p4_tables,
    "p4_keys": p4_keys,
    "p4_rejected": p4_rejected,
}

_P2 = r"""
WITH refs AS (
  SELECT 'policy_clauses' AS table_name, row_no, lower(regexp_replace(chunk_id, '^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$', '', 'g')) AS ref, ingested_at AS at FROM policy_clauses
  UNION ALL
  SELECT 'manual_labels', row_no, lower(regexp_replace(record_id, '^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$', '', 'g')), updated_at FROM manual_labels
), parents AS (
  SELECT 'policy_clauses' AS table_name, row_no, lower(regexp_replace(chunk_id, '^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$', '', 'g')) AS k, ingested_at, deleted_at FROM chunks
  UNION ALL
  SELECT 'manual_labels', row_no, lower(regexp_replace(record_id, '^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$', '', 'g')), ingested_at, deleted_at FROM policy_clauses
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY table_name, k ORDER BY ingested_at DESC NULLS LAST, row_no DESC) AS rn,
         min(ingested_at) OVER (PARTITION BY table_name, k) AS first_at
  FROM parents WHERE k <> ''
), judged AS (
  SELECT r.table_name, r.row_no, strftime(r.at, '%Y-%m') AS period,
         CASE WHEN p.k IS NULL THEN 'missing' WHEN p.deleted_at IS NOT NULL THEN 'deleted' WHEN p.first_at > r.at THEN 'late' END AS orphan_kind
  FROM refs r LEFT JOIN ranked p ON p.table_name = r.table_name AND p.k = r.ref AND p.rn = 1 WHERE r.ref <> ''
)
"""

ORACLES: dict[str, str] = {
    "p4_found": quality_sql.ITEMS,
    "p4_graph": quality_sql.GRAPH,
    "p4_keys": quality_sql.KEYS,
    "p4_rejected": quality_sql.REJECTED,
    "p2_found": _P2 + "SELECT table_name, row_no, orphan_kind, period FROM judged WHERE orphan_kind IS NOT NULL",
    "p2_report": _P2 + "SELECT table_name, period, orphan_kind, CAST(count(*) AS BIGINT) AS orphans FROM judged WHERE orphan_kind IS NOT NULL GROUP BY ALL",
}
