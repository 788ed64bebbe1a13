"""Folders of JSON Lines files as streams: chunks become clause records, label saves go to the label log.

File sources with checkpoints give every file to one batch; a repeated batch is written under its own number again, so
both feeds survive the loss of executors and a restart without doubling rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from farelode.operators.clauses import extract_records
from farelode.operators.labels import LabelLog
from farelode.schema import CHUNK_SCHEMA, LABEL_SCHEMA


def stream_clauses(spark: SparkSession, chunks: str, records: str, checkpoint: str, mode: str = "heuristic", once: bool = True) -> StreamingQuery:
    """Extracts the clause records of chunk files as they arrive, into a Parquet folder; ``once``: takes what is there, then ends."""
    source = spark.readStream.schema(CHUNK_SCHEMA).option("mode", "DROPMALFORMED").json(chunks)
    writer = extract_records(source, mode).writeStream.format("parquet").option("path", records).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_labels(spark: SparkSession, saves: str, log: LabelLog, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upserts label files as they arrive into the label log. Saves without a record id are left out.

    A batch that is run again appends the same saves again; as the last save of a record counts, its labels stay the same.
    """
    source = spark.readStream.schema(LABEL_SCHEMA).option("mode", "DROPMALFORMED").json(saves)

    def save(batch: DataFrame, _number: int) -> None:
        kept = batch.where("record_id IS NOT NULL AND trim(record_id) <> ''")
        if kept.limit(1).count():
            log.upsert(kept)

    writer = source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
