"""Queries of the policy engine's own operators, with the same results in DuckDB SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelode.functions import extract as E
from farelode.functions.text import lowered, token_windows
from farelode.operators import answers, clauses, evaluation, index, labels, vectors
from farelode.plans import policy_sql
from farelode.schema import CLAUSE_SCHEMA, METADATA_FIELDS
from farelode.sources import files
from farelode.tables import durable, shared_folder, spread, table

QUESTION = "What refund is due before departure, and which fee applies to a no-show or waiver?"
FILTERS = {"document_type": "Fare_Rule"}


def _clauses(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "policy_clauses"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "chunks"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def clause_split(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses of all chunks, with their place."""
    return clauses.explode_clauses(_chunks(spark, folder).select("row_no", "text")).select("row_no", "clause_index", "clause_text")


def clause_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Topic and action of every clause text."""
    text = F.col("clause_text")
    return _clauses(spark, folder).select("row_no", E.policy_topic(text).alias("policy_topic"), E.policy_action(text).alias("action"))


def topic_action_counts(spark: SparkSession, folder: str) -> DataFrame:
    return clause_kinds(spark, folder).groupBy("policy_topic", "action").agg(F.count(F.lit(1)).alias("clauses"))


def penalty_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _clauses(spark, folder).select("row_no", E.penalty(F.col("clause_text")).alias("p")).select("row_no", "p.*")


def time_signals(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("clause_text")
    return _clauses(spark, folder).select("row_no", E.time_window(text).alias("time_window"), E.departure_side(text).alias("before_after_departure"))


def tax_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _clauses(spark, folder).select("row_no", E.tax_refund_rule(F.col("clause_text")).alias("tax_refund_rule"))


def snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Conditions and exceptions of every clause text, each joined by bars."""
    text = F.col("clause_text")
    return _clauses(spark, folder).select("row_no", F.array_join(E.eligibility_conditions(text), " | ").alias("eligibility_conditions"), F.array_join(E.exceptions(text), " | ").alias("exceptions"))


def clause_records(spark: SparkSession, folder: str) -> DataFrame:
    """The heuristic records of all chunks; lists are joined by bars."""
    records = clauses.extract_records(_chunks(spark, folder))
    return records.withColumns({c: F.array_join(c, " | ") for c in ("eligibility_conditions", "exceptions")})


def stub_records(spark: SparkSession, folder: str) -> DataFrame:
    records = clauses.extract_records(_chunks(spark, folder), "stub")
    return records.select("record_id", "source_id", "document_type", "cabin", "pax_type", "policy_topic", "action", "clause_text", "confidence", "needs_review", "notes")


def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Token windows of all documents, 150 tokens with 30 shared."""
    windows = _documents(spark, folder).select("doc_id", F.posexplode(token_windows(F.col("text"))).alias("window_no", "w"))
    return windows.select("doc_id", "window_no", "w.start_token", "w.end_token", F.col("w.text").alias("window_text"))


def manifest_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks with the manifest's values laid over their metadata."""
    by_file = files.manifest_by_file(table(spark, folder, "pilot_source_manifest"), "row_no")
    laid = files.overlay_manifest(_chunks(spark, folder).select("row_no", "metadata"), F.col("metadata.source_filename"), by_file)
    return laid.select("row_no", *[f"metadata.{c}" for c in ("source_id", "document_id", "document_type", "carrier", "supplier", "market", "route_scope", "cabin", "effective_from", "source_filename")])


def manifest_sources(spark: SparkSession, folder: str) -> DataFrame:
    return files.manifest_source_ids(table(spark, folder, "pilot_source_manifest"))


def term_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Per term of all documents its document frequency and its occurrences."""
    postings = index.term_counts(_documents(spark, folder), "doc_id", "text")
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def document_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return index.document_lengths(_documents(spark, folder), "doc_id", "text")


def corpus_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return index.corpus_statistics(document_lengths(spark, folder)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def hybrid_index(spark: SparkSession, folder: str) -> index.HybridIndex:
    """The index of a folder's chunks and clauses. It is built once for files of the same names, sizes and times, and in the
    same place again when these change, so a folder has one index."""
    mark = index.input_fingerprint(spark, f"{folder}/chunks.parquet", f"{folder}/policy_clauses.parquet")
    path = shared_folder(spark, f"index-{hashlib.sha256(folder.rstrip('/').encode()).hexdigest()[:16]}")
    return index.cached_index(spark, _chunks(spark, folder), _clauses(spark, folder), path, mark)


def _scores(hits: DataFrame) -> list:
    return [F.round(c, 6).alias(c) for c in ("bm25", "vector", "clause_boost", "hybrid")]


def hybrid_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks that score for one question, with their scores."""
    hits = hybrid_index(spark, folder).search(spark, QUESTION, top_k=None)
    return hits.select("chunk_id", *_scores(hits))


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = hybrid_index(spark, folder).search(spark, QUESTION, top_k=5)
    return hits.select("rank", "chunk_id", *_scores(hits))


def hybrid_filtered(spark: SparkSession, folder: str) -> DataFrame:
    hits = hybrid_index(spark, folder).search(spark, QUESTION, top_k=20, filters=FILTERS)
    return hits.select("rank", "chunk_id", *_scores(hits))


def keyword_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that match one question best by terms alone."""
    docs = _documents(spark, folder).select("doc_id", "text")
    lengths = index.document_lengths(docs, "doc_id", "text")
    postings = durable(index.term_counts(docs, "doc_id", "text").join(lengths, "doc_id").withColumnRenamed("doc_id", "chunk_id"))
    scores = index.bm25_scores(postings, index.document_frequencies(postings), index.corpus_statistics(lengths), spark, QUESTION)
    rounded = scores.select(F.col("chunk_id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))
    return rounded.orderBy(F.desc("bm25"), "doc_id").limit(10)


def citation_list(spark: SparkSession, folder: str) -> DataFrame:
    """The citations of one question's answer."""
    found = answers.citations(hybrid_index(spark, folder).search(spark, QUESTION, top_k=5))
    return found.select("rank", "chunk_id", "source_id", "document_id", "document_type", "carrier", F.size("matched_clauses").alias("clauses"), "preview")


def answer_text(spark: SparkSession, folder: str) -> DataFrame:
    return answers.ask(spark, hybrid_index(spark, folder), QUESTION, 5).select("query", "answer", "hits", "mode")


def source_summary(spark: SparkSession, folder: str) -> DataFrame:
    return answers.summarize_sources(_clauses(spark, folder), "row_no")


def source_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the source list for one document type, with a limit of 50 sources."""
    return answers.list_sources(_clauses(spark, folder), "row_no", 50, document_type="circular")[0]


def latest_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The label table as upserts leave it: the last save of each record."""
    rows = labels.latest(table(spark, folder, "manual_labels"), "record_id", "updated_at", "row_no")
    return rows.select("record_id", "row_no", F.lower("label_status").alias("label_status"))


def _queue(spark: SparkSession, folder: str, labeled: DataFrame) -> DataFrame:
    chunks = labels.latest(_chunks(spark, folder), "chunk_id", "row_no")
    manifest = files.manifest_source_ids(table(spark, folder, "pilot_source_manifest"))
    return labels.queue_candidates(_clauses(spark, folder), chunks, labeled, manifest)


def labeling_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The next 50 clauses to label."""
    queue = _queue(spark, folder, table(spark, folder, "manual_labels").select("record_id"))
    return queue.orderBy(*labels.queue_order(), "clause_text").limit(labels.QUEUE_LIMIT).select("record_id", "source_id", "chunk_id", "clause_text", F.col("heuristic.policy_topic").alias("policy_topic"))


def queue_flag_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many queue rows of all clauses are labeled, skipped and open."""
    nothing = spark.createDataFrame([], "record_id string")
    return labels.queue_counts(labels.queue_flags(_queue(spark, folder, nothing), latest_labels(spark, folder)))


def _label_saves(spark: SparkSession, folder: str) -> DataFrame:
    return labels.parse_labels(table(spark, folder, "manual_labels")).select("label.*")


def label_records(spark: SparkSession, folder: str) -> DataFrame:
    """All valid payloads as normalized labels; lists are joined by bars."""
    clean = labels.normalize_labels(_label_saves(spark, folder))
    kept = ("record_id", "label_status", "source_id", "document_id", "document_type", "carrier", "supplier", "chunk_id", "policy_topic", "action", "penalty_type", "penalty_currency", "time_window", "before_after_departure", "tax_refund_rule", "clause_text", "notes", "penalty_amount", "penalty_percent")
    return clean.select(*kept, *[F.array_join(c, " | ").alias(c) for c in ("eligibility_conditions", "exceptions")])


def label_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """Two saves into a new log, the finished labels and then all: which records were there before."""
    log = labels.LabelLog(spark, shared_folder(spark, f"tables/{uuid.uuid4().hex}"))
    saves = _label_saves(spark, folder).where("trim(record_id) <> ''")
    first = log.upsert(saves.where("lower(trim(label_status)) = 'done'"))
    second = log.upsert(saves)
    return first.select(F.lit(1).alias("save"), "*").unionAll(second.select(F.lit(2), "*"))


def unskipped_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The current labels that evaluation takes: all but skipped ones."""
    rows = labels.latest(table(spark, folder, "manual_labels"), "record_id", "updated_at", "row_no")
    return evaluation.drop_skipped(rows).select("record_id", "row_no")


def synthetic_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the chunks are made up, by their first 20."""
    return spark.createDataFrame([(labels.is_synthetic(table(spark, folder, "chunks"), "row_no"),)], "synthetic boolean")


def queue_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The counts shown above the queue of all clauses, with and without labeled ones."""
    nothing = spark.createDataFrame([], "record_id string")
    queue, saved = _queue(spark, folder, nothing), latest_labels(spark, folder)
    total = queue.agg(F.count(F.lit(1)).alias("_all"))
    shown = []
    for everything in (True, False):
        counts = labels.queue_counts(labels.queue_flags(queue, saved, everything)).crossJoin(total)  # one row each
        shown.append(counts.select(F.lit(everything).alias("include_labeled"), (F.col("_all") if everything else F.col("returned_records")).alias("total_records"), "returned_records", "labeled_records", "skipped_records", "unlabeled_records"))
    return shown[0].unionAll(shown[1])


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as chunks, with ids that follow from document, source and window."""
    meta = F.struct(*[(F.col(c) if c else F.lit(None)).cast("string").alias(n) for n, c in ((n, {"document_id": "document_id", "source_id": "source"}.get(n)) for n in METADATA_FIELDS)])
    chunks = clauses.chunk_documents(_documents(spark, folder).select("text", meta.alias("metadata")))
    return chunks.select("chunk_id", "start_token", "end_token", "text", "metadata.document_id", "metadata.section_title")


def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All clauses written as JSON Lines and read back under their schema."""
    path = shared_folder(spark, f"tables/{uuid.uuid4().hex}")
    files.write_jsonl(_clauses(spark, folder).select("row_no", "record_id", "clause_text", "penalty_amount", "exceptions", "needs_review"), path)
    back = files.read_jsonl(spark, path, T.StructType([T.StructField("row_no", T.LongType()), *[f for f in CLAUSE_SCHEMA if f.name in ("record_id", "clause_text", "penalty_amount", "exceptions", "needs_review")]]), strict=True)
    return back.select("row_no", "record_id", "clause_text", "penalty_amount", F.array_join("exceptions", " | ").alias("exceptions"), "needs_review")


def field_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """How well extraction from the clause text agrees with the clause table's own columns."""
    gold = labels.latest(_clauses(spark, folder), "record_id", "row_no").withColumn("_low", lowered(F.col("clause_text")))
    text, low = F.col("clause_text"), F.col("_low")
    found = gold.select(
        "record_id", E.policy_topic(text, low).alias("policy_topic"), E.policy_action(text, low).alias("action"), E.time_window(text, low).alias("time_window"), E.departure_side(text, low).alias("before_after_departure"),
        E.tax_refund_rule(text, low).alias("tax_refund_rule"), E.eligibility_conditions(text).alias("eligibility_conditions"), E.exceptions(text).alias("exceptions"), E.penalty(text, low).alias("p"),
    ).select("*", "p.*")
    return evaluation.field_accuracy(gold, found).withColumn("accuracy", F.round("accuracy", 6))


def overall_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """The share of right values over all fields."""
    totals = field_accuracy(spark, folder).agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    return totals.withColumn("overall_field_accuracy", F.round(F.try_divide("correct", "total"), 6))


def compare_states(spark: SparkSession, folder: str) -> DataFrame:
    """What a comparison answers when the first store has labels, has only skipped ones, and when there are none."""
    saved = labels.latest(labels.parse_labels(table(spark, folder, "manual_labels")), "record_id", "updated_at", "row_no").select("label.*").where("trim(record_id) <> ''")
    skipped = saved.where("lower(label_status) = 'skip'")
    found = labels.latest(_clauses(spark, folder).where("trim(record_id) <> ''"), "record_id", "row_no").withColumn("label_status", F.lit(None).cast("string"))
    cases = {"labels": [("sqlite", saved)], "only skipped": [("postgres", None), ("sqlite", skipped)], "nothing": [("sqlite", saved.limit(0))]}
    rows = []
    for name, stores in cases.items():
        told = evaluation.compare(found, stores, None, ("policy_topic", "action"))
        rows.append((name, told["status"], told["manual_gold_backend"], told.get("gold_records"), told.get("matched_records")))
    return spark.createDataFrame(rows, "state string, status string, backend string, gold_records bigint, matched_records bigint")


def record_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Records that are labeled, extracted, or both."""
    return evaluation.record_overlap(table(spark, folder, "manual_labels").where("record_id IS NOT NULL"), _clauses(spark, folder).where("record_id IS NOT NULL"))


def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 20, against all."""
    rows = table(spark, folder, "embeddings")
    found = vectors.nearest_all(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


def knn_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors of one label that are nearest to the first vector of the table."""
    rows = table(spark, folder, "embeddings")
    query = rows.orderBy("vec_id").limit(1).collect()  # one row
    if not query or not query[0]["embedding"]:
        return spark.createDataFrame([], "vec_id bigint, score double")
    return vectors.nearest(rows, "vec_id", "embedding", query[0]["embedding"], 10, F.col("label") == 3).select("vec_id", F.round("score", 6).alias("score"))


def html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks written as pages, with scripts, styles and entities, and read back as text."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p>")))
    page = F.concat(F.lit("<html><head><style>p {margin: 0}</style><script>var a = '<p>no text</p>';</script></head><body><!-- no text -->"), F.array_join(lines, ""), F.lit("</body></html>"))
    return _chunks(spark, folder).where("text IS NOT NULL").select("row_no", files.html_to_text(page).alias("page_text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clause_split, clause_kinds, topic_action_counts, penalty_terms, time_signals, tax_rules, snippets, clause_records, stub_records, chunk_windows,
        manifest_overlay, manifest_sources, term_statistics, document_lengths, corpus_statistics, hybrid_scores, hybrid_topk, hybrid_filtered, keyword_topk,
        citation_list, answer_text, source_summary, source_totals, latest_labels, labeling_queue, queue_flag_counts, queue_headers, label_records, label_upserts, unskipped_labels,
        synthetic_guard, document_chunks, jsonl_round_trip, field_accuracy, overall_accuracy, compare_states, record_overlap, knn_cosine, knn_filtered, html_text,
    )
}

ORACLES: dict[str, str] = policy_sql.oracles(QUESTION, FILTERS["document_type"])
