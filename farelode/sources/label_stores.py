"""Label stores of other systems: a SQLite file and a table of a database server, and the choice and bootstrap of a store.

Every store has the same operations as ``LabelLog``: rows, labels, count, upsert, export, import into an empty one.
"""

from __future__ import annotations

import sqlite3
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelode.operators.labels import LabelLog, LabelStore
from farelode.schema import LABEL_BACKENDS, LABEL_SCHEMA, LABEL_TABLE_SCHEMA
from farelode.sources.files import read_jsonl
from farelode.tables import shared_folder

_TEXT_ROWS = "record_id string, payload_json string, label_status string, updated_at string"
_MERGED = ("record_id", "payload_json", "label_status")


class SqliteLabels(LabelStore):
    """A SQLite file, local to the driver. Rows pass through the driver in batches, never all at once."""

    backend = "sqlite"

    def __init__(self, spark: SparkSession, path: str, batch: int = 10_000) -> None:
        self.spark, self.path, self.batch = spark, path, batch

    def _open(self) -> sqlite3.Connection:
        db = sqlite3.connect(self.path)
        db.execute("CREATE TABLE IF NOT EXISTS manual_labels (record_id TEXT PRIMARY KEY, payload_json TEXT NOT NULL, label_status TEXT, updated_at TEXT NOT NULL DEFAULT CURRENT_TIMESTAMP)")
        return db

    def rows(self) -> DataFrame:
        folder = shared_folder(self.spark, f"tables/{uuid.uuid4().hex}")
        with self._open() as db:
            cursor = db.execute("SELECT record_id, payload_json, label_status, updated_at FROM manual_labels")
            while batch := cursor.fetchmany(self.batch):
                texts = [tuple(None if v is None else str(v) for v in r) for r in batch]
                self.spark.createDataFrame(texts, _TEXT_ROWS).write.mode("append").parquet(folder)
            empty = cursor.execute("SELECT count(*) FROM manual_labels").fetchone()[0] == 0
        rows = self.spark.createDataFrame([], _TEXT_ROWS) if empty else self.spark.read.schema(_TEXT_ROWS).parquet(folder)
        return rows.withColumn("updated_at", F.col("updated_at").try_cast("timestamp"))

    def count(self) -> int:
        with self._open() as db:
            return db.execute("SELECT count(*) FROM manual_labels").fetchone()[0]

    def _merge(self, entries: DataFrame) -> None:
        with self._open() as db:
            for r in entries.select(*_MERGED).toLocalIterator():
                db.execute("INSERT INTO manual_labels (record_id, payload_json, label_status) VALUES (?, ?, ?) ON CONFLICT (record_id) DO UPDATE SET payload_json = excluded.payload_json, label_status = excluded.label_status, updated_at = CURRENT_TIMESTAMP", tuple(r))


class JdbcLabels(LabelStore):
    """A table of a database server, read and written by JDBC in parallel; the server merges.

    Upserts load the entries into a table beside it and merge that with the statement of the SQL standard, which Postgres
    knows from version 15 on. ``json_type`` is the type of the payload column (``jsonb`` in Postgres). The server's driver has
    to be on the class path.
    """

    backend = "postgres"

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None, json_type: str = "jsonb", table: str = "manual_labels", text_type: str = "TEXT", partitions: int = 8) -> None:
        self.spark, self.url, self.properties, self.json_type, self.table, self.text_type, self.partitions = spark, url, properties or {}, json_type, table, text_type, partitions

    def _connection(self):
        jvm = self.spark._jvm
        given = jvm.java.util.Properties()
        for k, v in self.properties.items():
            given.setProperty(k, v)
        if "driver" in self.properties:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.properties["driver"])
        return jvm.java.sql.DriverManager.getConnection(self.url, given)

    def _run(self, *statements: str) -> None:
        connection = self._connection()
        try:
            statement = connection.createStatement()
            for sql in statements:
                statement.execute(sql)
        finally:
            connection.close()

    def _exists(self) -> bool:
        connection = self._connection()
        try:
            found = [connection.getMetaData().getTables(None, None, name, None).next() for name in (self.table, self.table.upper())]
        finally:
            connection.close()
        return any(found)

    def create(self) -> None:
        """Makes the table if there is none."""
        if not self._exists():
            self._run(
                f"CREATE TABLE {self.table} (record_id VARCHAR(512) NOT NULL PRIMARY KEY, payload_json {self.json_type} NOT NULL, label_status VARCHAR(64), updated_at TIMESTAMP NOT NULL)",
                f"CREATE INDEX idx_{self.table}_status ON {self.table} (label_status)",
            )

    def rows(self) -> DataFrame:
        self.create()
        # ranges of the first letter, hexadecimal digits as ids mostly have
        cuts = [f"{i:x}" for i in range(16)][:: max(1, 16 // self.partitions)][1:]
        ranges = [f"record_id < '{cuts[0]}'", *[f"record_id >= '{a}' AND record_id < '{b}'" for a, b in zip(cuts, cuts[1:])], f"record_id >= '{cuts[-1]}'"]
        payload = f"CAST(payload_json AS {self.text_type}) AS payload_json" if self.json_type != self.text_type else "payload_json"
        rows = self.spark.read.jdbc(self.url, f"(SELECT record_id, {payload}, label_status, updated_at FROM {self.table}) labels", predicates=ranges, properties=self.properties)
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LABEL_TABLE_SCHEMA])

    def count(self) -> int:
        self.create()
        return int(self.spark.read.jdbc(self.url, f"(SELECT count(*) AS n FROM {self.table}) c", properties=self.properties).first()[0])

    def _merge(self, entries: DataFrame) -> None:
        self.create()
        staged = f"{self.table}_{uuid.uuid4().hex[:12]}"
        self._run(f"CREATE TABLE {staged} (record_id VARCHAR(512), payload_json {self.text_type}, label_status VARCHAR(64), updated_at TIMESTAMP)")
        try:
            # some drivers set a missing text as another type, so it is written as an empty one
            entries.select("record_id", "payload_json", F.coalesce("label_status", F.lit("")).alias("label_status"), F.current_timestamp().alias("updated_at")).write.jdbc(self.url, staged, mode="append", properties=self.properties)
            payload = "s.payload_json" if self.json_type == self.text_type else f"CAST(s.payload_json AS {self.json_type})"
            self._run(
                f"MERGE INTO {self.table} t USING {staged} s ON t.record_id = s.record_id "
                f"WHEN MATCHED THEN UPDATE SET payload_json = {payload}, label_status = s.label_status, updated_at = s.updated_at "
                f"WHEN NOT MATCHED THEN INSERT (record_id, payload_json, label_status, updated_at) VALUES (s.record_id, {payload}, s.label_status, s.updated_at)"
            )
        finally:
            self._run(f"DROP TABLE {staged}")


def label_backend(name: str | None) -> str:
    """The label store to use; anything unknown means sqlite."""
    value = (name or "").strip().lower()
    return value if value in LABEL_BACKENDS else "sqlite"


def open_store(spark: SparkSession, backend: str | None, log: str | None = None, sqlite: str | None = None, jdbc: LabelStore | str | None = None, gold_file: str | None = None) -> LabelStore:
    """The store of a backend; an empty one is filled from older stores first: a SQLite file from the gold file (JSON Lines), a
    database from the SQLite file and, if that gave nothing, from the gold file. Without a database's address that backend
    is an error."""
    kind = label_backend(backend)
    gold = read_jsonl(spark, gold_file, LABEL_SCHEMA) if gold_file else None
    if kind == "postgres":
        if not jdbc:
            raise ValueError("the postgres backend needs the address of its database")
        store = JdbcLabels(spark, jdbc) if isinstance(jdbc, str) else jdbc
        if sqlite:
            older = SqliteLabels(spark, sqlite)
            if older.count():
                store.import_if_empty(older.labels())
    elif kind == "sqlite":
        if not sqlite:
            raise ValueError("the sqlite backend needs the path of its file")
        store = SqliteLabels(spark, sqlite)
    else:
        if not log:
            raise ValueError("the jsonl backend needs the folder of its log")
        store = LabelLog(spark, log)
    if gold is not None:
        store.import_if_empty(gold)
    return store

