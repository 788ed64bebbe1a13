"""Answers with citations, and summaries of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelode.operators.index import HybridIndex

# ---------------------------------------------------------------------------------------------------------------------
# Fixed values.
NO_HITS = "No matching policy chunks were found in the indexed records."
SOURCE_ATTRIBUTES = ("document_id", "document_type", "carrier", "supplier", "offer_or_circular_id", "effective_from", "effective_to")
MATCHED_CLAUSES, PREVIEW_CLAUSES = 5, 2
# ---------------------------------------------------------------------------------------------------------------------


def _first(name: str) -> Column:
    """The first clause's value unless empty, else the chunk's."""
    return F.coalesce(F.nullif(F.try_element_at("clauses", F.lit(1))[name], F.lit("")), F.col(f"meta_{name}"))


def citations(hits: DataFrame) -> DataFrame:
    """A search's hits as citations with a ``preview`` line: the first two of at most five matched clauses, else the text."""
    matched = F.transform(F.slice("clauses", 1, MATCHED_CLAUSES), lambda c: F.struct(*[c[n].alias(n) for n in ("record_id", "policy_topic", "action", "clause_text")]))
    texts = F.filter(F.transform(F.slice("clauses", 1, PREVIEW_CLAUSES), lambda c: F.coalesce(c["clause_text"], F.lit(""))), lambda t: t != "")
    text = F.coalesce("text", F.lit(""))
    source = F.coalesce(F.nullif(_first("source_id"), F.lit("")), F.lit("unknown"))
    return hits.select(
        "rank", "chunk_id", source.alias("source_id"), F.coalesce(F.nullif(_first("document_id"), F.lit("")), source).alias("document_id"),
        *[_first(n).alias(n) for n in ("document_type", "carrier", "supplier", "offer_or_circular_id", "section_title")],
        text.alias("chunk_text"), matched.alias("matched_clauses"), F.when(F.size(texts) > 0, F.array_join(texts, " | ")).otherwise(text).alias("preview"),
        F.col("hybrid").alias("score"), F.struct("hybrid", "bm25", "vector", "clause_boost").alias("score_breakdown"),
    )


def ask(spark: SparkSession, index: HybridIndex, query: str, top_k: int = 5, document_type: str | None = None, carrier: str | None = None, supplier: str | None = None) -> DataFrame:
    """One row: ``query, answer, hits, mode, citations``. ``top_k`` is 1 to 20.

    The citations of an answer are at most ``top_k`` rows, so gathering them is bounded.
    """
    if not 1 <= top_k <= 20:
        raise ValueError("top_k must be between 1 and 20")
    found = citations(index.search(spark, query, top_k, {"document_type": document_type or "", "carrier": carrier or "", "supplier": supplier or ""}))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("preview"))
    gathered = found.agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("n"), line.alias("line")))).alias("_lines"), F.array_sort(F.collect_list(F.struct(*found.columns))).alias("citations"))
    answer = F.when(F.size("_lines") > 0, F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")).otherwise(NO_HITS)
    return gathered.select(F.lit(query).alias("query"), answer.alias("answer"), F.size("_lines").alias("hits"), F.lit("retrieval_only").alias("mode"), "citations")


def filter_records(records: DataFrame, document_type: str | None = None, carrier: str | None = None, supplier: str | None = None) -> DataFrame:
    """Records whose values equal the given ones without case; a null value reads as ``none``."""
    for name, value in (("document_type", document_type), ("carrier", carrier), ("supplier", supplier)):
        if value:
            records = records.where(F.lower(F.coalesce(F.col(name), F.lit("none"))) == value.lower())
    return records


def summarize_sources(records: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Per source its first-seen attributes and ``record_count``; most records first, then in first-seen order.

    A null or empty source is ``unknown``. Attributes are those of the first record by ``order``, nulls included.
    """
    source = F.coalesce(F.nullif(F.col("source_id"), F.lit("")), F.lit("unknown"))
    grouped = records.groupBy(source.alias("source_id")).agg(F.min_by(F.struct(*SOURCE_ATTRIBUTES), order).alias("_first"), F.count(F.lit(1)).alias("record_count"), F.min(order).alias("_ord"))
    ordered = grouped.orderBy(F.desc("record_count"), F.asc("_ord"))
    return (ordered if limit is None else ordered.limit(limit)).select("source_id", *[f"_first.{a}" for a in SOURCE_ATTRIBUTES], "record_count")


def list_sources(records: DataFrame, order: str, limit: int = 50, document_type: str | None = None, carrier: str | None = None, supplier: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(totals, sources): ``total_records`` counts the filtered records, ``total_sources`` the sources after the limit (1 to 500)."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    kept = filter_records(records, document_type, carrier, supplier)
    sources = summarize_sources(kept, order, limit)
    totals = kept.agg(F.count(F.lit(1)).alias("total_records")).crossJoin(sources.agg(F.count(F.lit(1)).alias("total_sources")))
    return totals, sources
