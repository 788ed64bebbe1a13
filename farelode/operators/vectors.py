"""A table of dense vectors: upsert by id and nearest neighbours by cosine."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VECTOR_SCHEMA = "id string, vector array<double>, payload string, save bigint, n bigint"


def cosine(vector: Column, query: list[float]) -> Column:
    """The cosine of a vector column with one query; null where a norm is 0 or the lengths differ."""
    norm = float(np.sqrt(np.sum(np.square(query))))
    q = F.lit([float(x) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.size(vector) == len(query), F.try_divide(dot, own * F.lit(norm)))


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], top_k: int = 10, payload_filter: Column | None = None) -> DataFrame:
    """The ``top_k`` rows nearest to one query: ``key, score``; ties by key. Vectors of another length or norm 0 are left out."""
    rows = vectors if payload_filter is None else vectors.where(payload_filter)
    return rows.select(key, cosine(F.col(vector), query).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), F.asc(key)).limit(top_k)


def nearest_all(vectors: DataFrame, queries: DataFrame, key: str, vector: str, top_k: int = 10, block: int = 4096, part: int = 100_000) -> DataFrame:
    """For every query its ``top_k`` nearest rows: ``query_id, key, score, rank``; exact, ties by key.

    The queries are a stated set. They are spread over blocks of about ``block`` vectors, the rows over parts of about ``part``;
    each pair of a block and a part meets in one task, which scores it by one matrix product and keeps the best of each query.
    So the driver gets two counts and what is shuffled back is ``top_k`` rows per query and part. Vectors of norm 0, null
    vectors and those of another length than a query are left out for it.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector")).where(F.size("_vector") > 0)
    asked = queries.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector")).where(F.size("_vector") > 0)
    blocks = max(1, math.ceil(asked.count() / block))
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / part))

    def one_of(n: int) -> Column:
        return F.pmod(F.xxhash64("_key"), F.lit(n)).cast("int")

    def each_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = asked.withColumn("_block", one_of(blocks)).withColumn("_part", each_of(parts))
    r = rows.withColumn("_part", one_of(parts)).withColumn("_block", each_of(blocks))
    found = q.groupBy("_block", "_part").cogroup(r.groupBy("_block", "_part")).applyInPandas(_meet(key, top_k), f"query_id {kind}, `{key}` {kind}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def _units(frame: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and the vectors, as unit vectors, of the rows of one length whose norm is not 0."""
    same = frame[frame["_vector"].map(len) == size]
    keys = same["_key"].to_numpy(dtype=object)
    x = np.array(same["_vector"].tolist(), dtype=np.float64).reshape(-1, size)
    norms = np.sqrt(np.sum(x * x, axis=1))
    return keys[norms > 0], x[norms > 0] / norms[norms > 0, None]


def _meet(key: str, top_k: int):
    """Scores a block of queries against a part of the rows."""

    def meet(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for size in sorted(set(queries["_vector"].map(len)) & set(rows["_vector"].map(len))):
            ids, q = _units(queries, size)
            names, x = _units(rows, size)
            if not len(ids) or not len(names):
                continue
            step = max(1, 10_000_000 // len(names))  # some 80 MB of scores at a time
            for start in range(0, len(ids), step):
                scores = np.round(q[start : start + step] @ x.T, 12)
                for i, row in zip(ids[start : start + step], scores):
                    if len(row) > top_k:  # all that equal the last one stay, so ties are settled by key
                        floor = np.partition(row, len(row) - top_k)[len(row) - top_k]
                        at = np.flatnonzero(row >= floor)
                    else:
                        at = np.arange(len(row))
                    out += [(i, k, -s) for s, k in sorted((-row[j], names[j]) for j in at)[:top_k]]
        return pd.DataFrame(out, columns=["query_id", key, "score"])

    return meet


class VectorIndex:
    """Vectors in a Parquet folder, as an append-only log of upserts; the last entry of an id counts."""

    def __init__(self, spark: SparkSession, path: str, size: int = 768) -> None:
        self.spark, self.path, self.size = spark, path, size

    def upsert(self, ids: list[str], vectors: list[list[float]], payloads: list[str] | None = None) -> int:
        """Adds or replaces a few vectors; the lists have to be of equal length. Missing payloads are empty objects."""
        if len(ids) != len(vectors) or payloads is not None and len(payloads) != len(ids):
            raise ValueError("ids, vectors and payloads must be of equal length")
        rows = [(i, [float(x) for x in v], p) for i, v, p in zip(ids, vectors, payloads or [None] * len(ids))]
        return self.upsert_rows(self.spark.createDataFrame(rows, "id string, vector array<double>, payload string"))

    def upsert_rows(self, rows: DataFrame) -> int:
        """Adds or replaces the vectors of a table ``id, vector, payload``; of several of one id the last read counts. Returns
        how many rows came in."""
        if rows.where(F.col("vector").isNull() | (F.size("vector") != self.size)).limit(1).count():
            raise ValueError(f"vectors must have {self.size} values")
        entries = rows.select(F.col("id").cast("string"), F.col("vector").cast("array<double>").alias("vector"), F.coalesce("payload", F.lit("{}")).alias("payload"), F.lit(self._next()).cast("bigint").alias("save"), F.monotonically_increasing_id().alias("n"))
        before = self._log().count()
        entries.write.mode("append").parquet(self.path)
        return self._log().count() - before

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(VECTOR_SCHEMA).parquet(self.path)
        except AnalysisException:  # nothing was written yet
            return self.spark.createDataFrame([], VECTOR_SCHEMA)

    def _next(self) -> int:
        return (self._log().agg(F.max("save")).first()[0] or 0) + 1

    def current(self) -> DataFrame:
        latest = Window.partitionBy("id").orderBy(F.desc("save"), F.desc("n"))
        return self._log().withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")

    def search(self, query: list[float], top_k: int = 10, payload_filter: Column | None = None) -> DataFrame:
        return nearest(self.current(), "id", "vector", query, top_k, payload_filter)
