"""Chunks to clause records: split, classify, extract. One narrow stage without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelode.functions import extract as E
from farelode.functions.text import lowered, none_of, split_clauses, token_windows
from farelode.schema import CLAUSE_FIELDS

_CARRIED = (
    "source_id", "document_id", "document_type", "offer_or_circular_id", "source_url", "source_filename", "carrier", "supplier", "market", "route_scope",
    "fare_family", "effective_from", "effective_to", "travel_from", "travel_to", "ticketing_from", "ticketing_to", "section_title",
)


def chunk_documents(documents: DataFrame, size: int = 150, overlap: int = 30) -> DataFrame:
    """``documents`` (``text``, ``metadata``) as chunks: ``chunk_id, text, metadata, start_token, end_token``.

    The id is a hash of document, source and window number, so a repeated task gives the same ids. A null section title
    becomes empty, and the chunk's id is written into its metadata. Texts without tokens have no chunk.
    """
    windows = documents.select("metadata", F.posexplode(token_windows(F.col("text"), size, overlap)).alias("window_no", "window"))
    key = F.sha2(F.concat_ws("|", F.coalesce("metadata.document_id", F.lit("")), F.coalesce("metadata.source_id", F.lit("")), F.col("window_no")), 256)
    meta = F.col("metadata").withField("section_title", F.coalesce("metadata.section_title", F.lit(""))).withField("chunk_id", F.col("chunk_id"))
    return windows.withColumn("chunk_id", key).select("chunk_id", F.col("window.text").alias("text"), meta.alias("metadata"), F.col("window.start_token").alias("start_token"), F.col("window.end_token").alias("end_token"))


def explode_clauses(chunks: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``chunks`` with ``clause_index`` (from 0) and ``clause_text``.

    A chunk without clauses keeps one clause, its own text, be it empty or null.
    """
    split = chunks.withColumn("_clauses", split_clauses(F.col(text)))
    own = F.when(F.size("_clauses") > 0, F.col("_clauses")).otherwise(F.array(F.col(text)))
    return split.select(*chunks.columns, F.posexplode(own).alias("clause_index", "clause_text"))


def _record(values: dict[str, Column]) -> list[Column]:
    return [values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in CLAUSE_FIELDS]


def _base() -> dict[str, Column]:
    values = {n: F.col(f"metadata.{n}") for n in _CARRIED}
    return values | {
        "record_id": F.concat(F.col("chunk_id"), F.lit(":"), F.col("clause_index").cast("string")), "chunk_id": F.col("chunk_id"), "clause_text": F.col("clause_text"),
        "policy_topic": F.lit("other"), "action": F.lit("unknown"), "eligibility_conditions": none_of(), "exceptions": none_of(), "needs_review": F.lit(True), "notes": F.lit(E.STUB_NOTE),
    }


def stub_records(clauses: DataFrame) -> DataFrame:
    """Clauses with their chunk's ids and dates, marked for review; cabin and passenger type are not carried over."""
    return clauses.select(*_record(_base()))


def heuristic_records(clauses: DataFrame) -> DataFrame:
    """Clauses with all that the extractors find. A clause of unknown topic or action needs review and counts 0.4, others 0.8."""
    text, low = F.col("clause_text"), F.col("_low")
    lowered_once = clauses.withColumn("_low", lowered(text))
    staged = lowered_once.withColumns({"_topic": E.policy_topic(text, low), "_action": E.policy_action(text, low), "_penalty": E.penalty(text, low)})
    known = (F.col("_topic") != "other") & (F.col("_action") != "unknown")
    values = _base() | {
        "policy_topic": F.col("_topic"), "action": F.col("_action"), "needs_review": ~known, "confidence": F.when(known, 0.8).otherwise(0.4), "notes": F.lit(None),
        "eligibility_conditions": E.eligibility_conditions(text), "exceptions": E.exceptions(text), "tax_refund_rule": E.tax_refund_rule(text, low),
        "time_window": E.time_window(text, low), "before_after_departure": E.departure_side(text, low),
        **{n: F.col(f"_penalty.{n}") for n in ("penalty_type", "penalty_amount", "penalty_currency", "penalty_percent", "fare_difference_required")},
    }
    return staged.select(*_record(values))


def extract_records(chunks: DataFrame, mode: str = "heuristic") -> DataFrame:
    """The clause records of chunks. ``mode``: heuristic or stub."""
    if mode not in ("heuristic", "stub"):
        raise ValueError("mode must be heuristic or stub")
    clauses = explode_clauses(chunks)
    return heuristic_records(clauses) if mode == "heuristic" else stub_records(clauses)
