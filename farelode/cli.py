"""Command line: ``python -m farelode.cli ingest|extract|evaluate|queue|compare``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from farelode.operators import clauses, evaluation, labels
from farelode.schema import CHUNK_SCHEMA, CLAUSE_SCHEMA
from farelode.sources import files
from farelode.sources.label_stores import JdbcLabels, SqliteLabels
from farelode.tables import ship


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="farelode")
    commands = top.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="a folder of PDF and HTML files to chunks")
    ingest.add_argument("--input", required=True)
    ingest.add_argument("--output", required=True)
    ingest.add_argument("--max-tokens", type=int, default=150)
    ingest.add_argument("--overlap", type=int, default=30)
    ingest.add_argument("--manifest")
    extract = commands.add_parser("extract", help="chunks to clause records")
    extract.add_argument("--input", required=True)
    extract.add_argument("--output", required=True)
    extract.add_argument("--mode", choices=("heuristic", "stub"), default="heuristic")
    evaluate = commands.add_parser("evaluate", help="field accuracy of predicted against gold records")
    evaluate.add_argument("--gold", required=True)
    evaluate.add_argument("--pred", required=True)
    evaluate.add_argument("--fields", nargs="*")
    queue = commands.add_parser("queue", help="the next clauses to label")
    queue.add_argument("--manifest", required=True)
    queue.add_argument("--chunks", required=True)
    queue.add_argument("--clauses", required=True)
    queue.add_argument("--output", required=True)
    queue.add_argument("--label-log")
    queue.add_argument("--limit", type=int, default=labels.QUEUE_LIMIT)
    compare = commands.add_parser("compare", help="extracted records against manual labels")
    compare.add_argument("--pred", required=True)
    compare.add_argument("--manual-gold")
    compare.add_argument("--label-log")
    compare.add_argument("--manual-gold-db")
    compare.add_argument("--manual-gold-postgres-dsn")
    compare.add_argument("--fields", nargs="*")
    return top


def run(spark: SparkSession, arguments: list[str]) -> dict:
    """Runs one command and returns its report."""
    a = parser().parse_args(arguments)
    ship(spark)
    if a.command == "ingest":
        manifests = (files.read_manifest(spark, a.manifest),) if a.manifest else ()
        files.write_jsonl(files.ingest_folder(spark, a.input, manifests, a.max_tokens, a.overlap), a.output)
        return {"status": "ok", "chunks": files.read_jsonl(spark, a.output, CHUNK_SCHEMA).count()}
    if a.command == "extract":
        files.write_jsonl(clauses.extract_records(files.read_jsonl(spark, a.input, CHUNK_SCHEMA, strict=True), a.mode), a.output)
        return {"status": "ok", "records": files.read_jsonl(spark, a.output, CLAUSE_SCHEMA).count()}
    fields = tuple(a.fields) if getattr(a, "fields", None) else evaluation.DEFAULT_FIELDS
    if a.command == "evaluate":
        gold, pred = (evaluation.drop_skipped(files.read_label_file(spark, p)) for p in (a.gold, a.pred))
        return evaluation.evaluate(gold, pred, fields)
    if a.command == "queue":
        log = labels.LabelLog(spark, a.label_log).current().select("record_id") if a.label_log else spark.createDataFrame([], "record_id string")
        manifest = files.manifest_source_ids(files.read_manifest(spark, a.manifest))
        # file order is not kept by a distributed read; ids stand in for it
        chunks = files.read_jsonl(spark, a.chunks, CHUNK_SCHEMA, strict=True)
        status, rows = labels.build_queue(files.read_jsonl(spark, a.clauses, CLAUSE_SCHEMA, strict=True), labels.latest(chunks, "chunk_id", "text"), "chunk_id", log, manifest, a.limit)
        files.write_jsonl(rows if rows is not None else spark.createDataFrame([], "record_id string"), a.output)
        return status
    predicted = files.read_label_file(spark, a.pred)
    stores = []
    if a.manual_gold_postgres_dsn:
        stores.append(("postgres", JdbcLabels(spark, a.manual_gold_postgres_dsn).labels()))
    if a.label_log:
        stores.append(("log", labels.LabelLog(spark, a.label_log).labels()))
    if a.manual_gold_db:
        stores.append(("sqlite", SqliteLabels(spark, a.manual_gold_db).labels()))
    return evaluation.compare(predicted, stores, files.read_label_file(spark, a.manual_gold) if a.manual_gold else None, fields)


def main() -> None:
    spark = SparkSession.builder.appName("farelode").getOrCreate()
    print(json.dumps(run(spark, sys.argv[1:]), indent=2, default=str))


if __name__ == "__main__":
    main()
