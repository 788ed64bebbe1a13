"""Manual labels: normalization, an append-only label log with latest-wins reads, and the labeling queue."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelode.functions.text import distinct_ignoring_case, none_of, or_null
from farelode.schema import IDENTITY_FIELDS, LABEL_SCHEMA, PAYOUT_FIELDS, PAYOUT_TYPE, SCORED_FIELDS, TIER_FIELDS, TIER_TYPE
from farelode.tables import stored

# ---------------------------------------------------------------------------------------------------------------------
# Fixed values.
QUEUE_NOTE = "Copy labeled fields into data/manual_gold_real_pilot_policy_clauses.jsonl using the same record_id."
SYNTHETIC_PREFIX, SYNTHETIC_SAMPLE = "pilot_chunk_", 20
QUEUE_LIMIT = 50
# ---------------------------------------------------------------------------------------------------------------------

LOG_SCHEMA = "record_id string, payload_json string, label_status string, updated_at timestamp, seq bigint, save_id string"


def _clean_structs(items: Column, fields: tuple, kind: str) -> Column:
    """Text fields trimmed, blank ones null; items without any value dropped; nothing left is null."""

    def clean(x: Column) -> Column:
        return F.struct(*[(or_null(x[n]) if t == "string" else x[n]).alias(n) for n, t in fields])

    kept = F.filter(F.transform(F.coalesce(items, none_of(f"array<{kind}>")), clean), lambda x: F.coalesce(*[x[n].cast("string") for n, _ in fields]).isNotNull())
    return F.when(F.size(kept) > 0, kept)


def clean_list(items: Column) -> Column:
    """Trimmed, without blanks and repetitions whatever their case; nothing left is null."""
    trimmed = F.filter(F.transform(F.coalesce(items, none_of()), or_null), lambda x: x.isNotNull())
    unique = distinct_ignoring_case(trimmed)
    return F.when(F.size(unique) > 0, unique)


def normalize_labels(labels: DataFrame) -> DataFrame:
    """Labels of ``LABEL_SCHEMA`` as they are saved: null where a sparse record has no key. The record id stays as it is."""
    columns = []
    for f in LABEL_SCHEMA:
        c = F.col(f.name)
        if f.name == "record_id":
            columns.append(c)
        elif f.name == "label_status":
            columns.append(F.lower(or_null(c)).alias(f.name))
        elif f.name == "penalty_tiers":
            columns.append(_clean_structs(c, TIER_FIELDS, TIER_TYPE).alias(f.name))
        elif f.name == "refund_payout_options":
            columns.append(_clean_structs(c, PAYOUT_FIELDS, PAYOUT_TYPE).alias(f.name))
        elif f.dataType.typeName() == "array":
            columns.append(clean_list(c).alias(f.name))
        elif f.dataType.typeName() == "string":
            columns.append(or_null(c).alias(f.name))
        else:
            columns.append(c)
    return labels.select(*columns)


def parse_labels(rows: DataFrame) -> DataFrame:
    """Rows of the label table as labels: the payload's record id before the column's; broken payloads and blank ids dropped.

    ``rows`` keeps its other columns beside ``label``.
    """
    parsed = rows.withColumn("label", F.from_json("payload_json", LABEL_SCHEMA, {"mode": "PERMISSIVE"}))
    # an object, not a text that encodes one
    valid = parsed.where(F.get_json_object("payload_json", "$").isNotNull() & F.col("payload_json").rlike(r"^\s*\{"))
    key = F.coalesce(F.nullif(F.col("label.record_id"), F.lit("")), F.nullif(F.col("record_id"), F.lit("")))
    return valid.withColumn("record_id", key).where("record_id IS NOT NULL").withColumn("label", F.col("label").withField("record_id", F.col("record_id")))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``; ties are open only where all order columns are equal.

    Rank-one windows are cut down before the shuffle, so a key with very many rows sends few to its task.
    """
    last = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(o) for o in order])
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def label_entries(labels: DataFrame) -> DataFrame:
    """Labels as rows of a store: ``record_id, payload_json, label_status``; of several labels of one record the last read."""
    clean = normalize_labels(labels)
    entries = clean.select("record_id", F.to_json(F.struct(*clean.columns)).alias("payload_json"), "label_status", F.monotonically_increasing_id().alias("_n"))
    return latest(entries, "record_id", "_n").drop("_n")


class LabelStore:
    """What all label stores can do; a store has ``rows``, ``count`` and ``_merge``."""

    spark: SparkSession
    backend: str

    def rows(self) -> DataFrame:
        """The current rows: ``record_id, payload_json, label_status, updated_at``."""
        raise NotImplementedError

    def count(self) -> int:
        raise NotImplementedError

    def _merge(self, entries: DataFrame) -> None:
        raise NotImplementedError

    def labels(self) -> DataFrame:
        """The current labels, parsed; broken payloads are left out."""
        return parse_labels(self.rows()).select("label.*")

    def upsert(self, labels: DataFrame) -> DataFrame:
        """Saves labels; ``record_id, updated``: whether the record was there before. Blank record ids are refused.

        A save replaces the whole record. The answer is a written table, so it does not change with the store.
        """
        if labels.where("record_id IS NULL OR trim(record_id) = ''").limit(1).count():
            raise ValueError("record_id is required")
        entries = stored(label_entries(labels))
        before = self.rows().select("record_id").distinct().withColumn("_before", F.lit(True))
        told = stored(entries.select("record_id").join(before, "record_id", "left").select("record_id", F.coalesce("_before", F.lit(False)).alias("updated")))
        self._merge(entries)
        return told

    def export(self, path: str) -> int:
        """Writes the current labels as a folder of JSON Lines files and returns how many there are."""
        found = self.labels()
        found.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return self.spark.read.schema(found.schema).json(path).count()

    def import_if_empty(self, labels: DataFrame) -> int:
        """Fills an empty store; rows without a record id are left out. Returns how many records came in."""
        if self.count():
            return 0
        kept = labels.where("record_id IS NOT NULL AND trim(record_id) <> ''")
        if kept.limit(1).count():
            self.upsert(kept)
        return self.count()


class LabelLog(LabelStore):
    """The label table as an append-only Parquet log: a save replaces the whole record, the last one counts.

    Parquet tables cannot be merged into; appending is atomic per commit, and concurrent saves are ordered by ``seq``, then
    by the save's own id.
    """

    backend = "jsonl"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)
        except AnalysisException:  # nothing was saved yet
            return self.spark.createDataFrame([], LOG_SCHEMA)

    def rows(self) -> DataFrame:
        return latest(self.log(), "record_id", "seq", "save_id").select("record_id", "payload_json", "label_status", "updated_at")

    current = rows

    def count(self) -> int:
        return self.log().select("record_id").distinct().count()

    def _merge(self, entries: DataFrame) -> None:
        seq = (self.log().agg(F.max("seq")).first()[0] or 0) + 1
        entries.select(
            "record_id", "payload_json", F.coalesce("label_status", F.lit("")).alias("label_status"), F.current_timestamp().alias("updated_at"),
            F.lit(seq).cast("bigint").alias("seq"), F.lit(str(uuid.uuid4())).alias("save_id"),
        ).write.mode("append").parquet(self.path)


def is_synthetic(chunks: DataFrame, order: str) -> bool:
    """Whether the first 20 chunks all have made-up ids; empty ids among them don't count, and no rows are not synthetic."""
    first = chunks.select("chunk_id", order).orderBy(order).limit(SYNTHETIC_SAMPLE)
    row = first.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.when(F.coalesce("chunk_id", F.lit("")) != "", F.col("chunk_id").startswith(SYNTHETIC_PREFIX))).alias("made_up")).first()
    return row["n"] > 0 and row["made_up"] is not False


def queue_candidates(clauses: DataFrame, chunks: DataFrame, labeled_ids: DataFrame, manifest_ids: DataFrame | None = None) -> DataFrame:
    """Queue rows for clauses with a chunk, without a label (skipped ones are labels) and, if the manifest has ids, of a listed source.

    ``chunks`` has one row per chunk id. ``labeled_ids`` is one column ``record_id``; ``manifest_ids`` one column ``source_id``.
    """
    open_ = clauses.join(labeled_ids.select("record_id").distinct(), "record_id", "left_anti")
    if manifest_ids is not None:
        open_ = open_.join(manifest_ids.select("source_id").distinct(), "source_id", "left_semi")
    texts = chunks.select(F.col("chunk_id").alias("_chunk"), F.col("text").alias("chunk_text"))
    heuristic = F.struct(*[(F.coalesce(F.col(n), none_of()) if t.startswith("array") else F.col(n)).cast(t).alias(n) for n, t in SCORED_FIELDS])
    joined = open_.join(texts, F.col("chunk_id") == F.col("_chunk"))
    return joined.select(*IDENTITY_FIELDS, "chunk_text", "clause_text", heuristic.alias("heuristic"), F.lit(QUEUE_NOTE).alias("manual_labeling_note"))


def queue_order() -> list[Column]:
    """By source, chunk and record; a null sorts as the text None."""
    return [F.coalesce(F.col(c), F.lit("None")).asc() for c in ("source_id", "chunk_id", "record_id")]


def build_queue(clauses: DataFrame, chunks: DataFrame, chunk_order: str, labeled_ids: DataFrame, manifest_ids: DataFrame | None = None, limit: int = QUEUE_LIMIT) -> tuple[dict, DataFrame | None]:
    """(status, queue). Blocked, with a reason and no queue, where a side is empty or the chunks are made up."""
    if not chunks.limit(1).count() or not clauses.limit(1).count():
        return {"status": "blocked", "reason": "missing_chunks_or_clauses", "queued_records": 0}, None
    if is_synthetic(chunks, chunk_order):
        return {"status": "blocked", "reason": "synthetic_chunks_detected", "queued_records": 0}, None
    if manifest_ids is not None and not manifest_ids.limit(1).count():
        manifest_ids = None
    queue = queue_candidates(clauses, chunks, labeled_ids, manifest_ids).orderBy(*queue_order()).limit(limit)
    return {"status": "ok", "queued_records": queue.count()}, queue


def queue_flags(queue: DataFrame, labels: DataFrame, include_labeled: bool = True) -> DataFrame:
    """Queue rows with ``is_labeled, is_skipped``; rows without a record id are left out. ``labels``: ``record_id, label_status``."""
    known = labels.select(F.col("record_id").alias("_label"), F.lower("label_status").alias("_status"))
    joined = queue.where("record_id IS NOT NULL AND record_id <> ''").join(known, F.col("record_id") == F.col("_label"), "left")
    flagged = joined.withColumns({"is_labeled": F.col("_label").isNotNull(), "is_skipped": F.coalesce(F.col("_status") == "skip", F.lit(False))}).drop("_label", "_status")
    return flagged if include_labeled else flagged.where(~F.col("is_labeled"))


def queue_counts(flagged: DataFrame) -> DataFrame:
    """One row: returned, labeled, skipped and unlabeled records."""
    return flagged.agg(F.count(F.lit(1)).alias("returned_records"), F.count_if("is_labeled").alias("labeled_records"), F.count_if("is_skipped").alias("skipped_records"), F.count_if(~F.col("is_labeled")).alias("unlabeled_records"))


def queue_response(queue: DataFrame, store: LabelStore, include_labeled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(header, rows) of a queue shown to labelers.

    Rows are the queue's with ``is_labeled, is_skipped, manual_label``. The header is one row: ``backend``, ``total_records``
    (all queue rows, also those without an id, or with ``include_labeled`` false the returned ones) and the counts of the
    returned rows.
    """
    labels = parse_labels(store.rows()).select(F.col("record_id").alias("_id"), "label")
    flagged = queue_flags(queue, labels.select(F.col("_id").alias("record_id"), F.col("label.label_status").alias("label_status")), include_labeled)
    rows = flagged.join(labels.withColumnRenamed("label", "manual_label"), F.col("record_id") == F.col("_id"), "left").drop("_id")
    total = queue.agg(F.count(F.lit(1)).alias("_all"))
    counts = queue_counts(flagged).crossJoin(total)  # one row each
    header = counts.select(F.lit(store.backend).alias("backend"), (F.col("_all") if include_labeled else F.col("returned_records")).alias("total_records"), "returned_records", "labeled_records", "skipped_records", "unlabeled_records")
    return header, rows


def save_response(store: LabelStore, labels: DataFrame) -> DataFrame:
    """Saves labels and answers ``record_id, saved, updated, backend, record`` (the label as it is kept)."""
    told = store.upsert(labels)
    kept = label_entries(labels).select(F.col("record_id").alias("_id"), F.from_json("payload_json", LABEL_SCHEMA).alias("record"))
    return told.join(kept, F.col("record_id") == F.col("_id")).select("record_id", F.lit(True).alias("saved"), "updated", F.lit(store.backend).alias("backend"), "record")


def health(store: LabelStore) -> DataFrame:
    """One row: ``status``, ``backend``, ``labels`` (how many there are)."""
    return store.spark.createDataFrame([("ok", store.backend, store.count())], "status string, backend string, labels bigint")
