"""Hybrid retrieval over chunks: BM25, TF-IDF cosine and a boost by the chunks' clauses.

The index is a set of tables that are built once and written as Parquet. All scores come from inverted tables, each sorted
by what a query asks for: postings and gram counts of the chunks, postings of the single clauses, chunks by topic or action,
and chunks by filter value. A search therefore reads the row groups of its own terms only, adds up per chunk in one shuffle,
takes the best with TakeOrderedAndProject, and reads the documents of those alone. Corpus statistics always come from all
documents, never from a filtered side.

Texts are tokenized in one pass. Tables are rebalanced by term before they are written: a term that very many chunks have
is split over several tasks and files. Tables cut the lineage between the steps; as one statement the plan would be too
large to optimize.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelode.functions.text import gram_words, grams, search_tokens, with_pairs

# ---------------------------------------------------------------------------------------------------------------------
# Weights and parameters of the scores.
K1, B = 1.5, 0.75
WEIGHT_BM25, WEIGHT_VECTOR = 1.0, 4.0
OVERLAP_STEP, OVERLAP_MOST, TOPIC_BONUS, ACTION_BONUS = 0.3, 1.5, 0.5, 0.2
CLAUSE_TEXT_FIELDS = ("record_id", "policy_topic", "action", "clause_text", "source_id", "document_id", "document_type", "carrier", "supplier", "offer_or_circular_id", "section_title")
FILTER_KEYS = ("document_type", "carrier", "supplier")
# ---------------------------------------------------------------------------------------------------------------------

FORMAT = 2  # of the written tables; indexes of another one are built anew
WORD, GRAM = "word", "gram"
TABLES = {
    "documents": "documents", "postings": f"counts/kind={WORD}", "grams": f"counts/kind={GRAM}", "terms": "terms", "gram_terms": "gram_terms", "statistics": "statistics", "norms": "norms",
    "clause_postings": "clause_postings", "kinds": "kinds", "attributes": "attributes",
}


def last_by_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the content of the last by ``order`` at the place of the first (column ``ord``).

    Rows without a key are dropped. ``order`` has to be unique within a key, or the choice between equals is open.
    """
    content = [c for c in rows.columns if c not in (key, "ord")]
    kept = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max_by(F.struct(*content), order).alias("_last"), F.min(order).alias("ord"))
    return kept.select(key, "_last.*", "ord")


def attach_clauses(chunks: DataFrame, clauses: DataFrame, clause_order: str) -> DataFrame:
    """``chunks`` (one row per ``chunk_id``) with their ``clauses``: an array of structs in the clauses' order, empty where none.

    Clauses without a chunk id belong to no chunk. The clauses of one chunk are gathered in one row.
    """
    kind = f"array<struct<{', '.join(f'{n}: string' for n in CLAUSE_TEXT_FIELDS)}>>"
    parts = F.struct(F.col(clause_order).alias("_ord"), *[F.col(c).cast("string").alias(c) for c in CLAUSE_TEXT_FIELDS])
    gathered = clauses.where("chunk_id IS NOT NULL AND chunk_id <> ''").groupBy(F.col("chunk_id").alias("_chunk")).agg(F.array_sort(F.collect_list(parts)).alias("_all"))
    ordered = F.transform("_all", lambda c: F.struct(*[c[n].alias(n) for n in CLAUSE_TEXT_FIELDS]))
    return chunks.join(gathered, F.col("chunk_id") == F.col("_chunk"), "left").withColumn("clauses", F.coalesce(ordered, F.array().cast(kind))).drop("_chunk", "_all")


def combined_text(text: Column, clauses: Column) -> Column:
    """A chunk's text, its clauses' texts and their topics and actions, joined by spaces."""
    texts = F.array_join(F.transform(clauses, lambda c: F.coalesce(c["clause_text"], F.lit(""))), " ")
    kinds = F.array_join(F.transform(clauses, lambda c: F.regexp_replace(F.concat_ws(" ", F.coalesce(c["policy_topic"], F.lit("")), F.coalesce(c["action"], F.lit(""))), "_", " ")), " ")
    return F.trim(F.array_join(F.filter(F.array(F.coalesce(text, F.lit("")), texts, kinds), lambda p: p != ""), " "))


def term_counts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Postings: ``key, term, tf``; documents without terms have none."""
    return documents.select(key, F.explode(search_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """``term, df``."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def document_lengths(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key, doc_length``: tokens of at least two characters, repeated ones counted each."""
    return documents.select(key, F.size(search_tokens(F.col(text))).cast("bigint").alias("doc_length"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    """One row: ``n_docs``, ``avgdl`` (0 for an empty corpus)."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avgdl"))


def gram_counts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key, gram, tf`` of words and pairs of neighbouring words."""
    return documents.select(key, F.explode(grams(F.col(text))).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))


def smooth_idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def vector_norms(counts: DataFrame, terms: DataFrame, key: str, n_docs: int) -> DataFrame:
    """``key, norm``: the length of each document's vector of raw counts times smoothed idf. ``terms``: ``gram, df``, a table."""
    weight = F.col("tf") * smooth_idf(F.lit(n_docs), F.col("df"))
    return counts.join(terms, "gram").groupBy(key).agg(F.sqrt(F.sum(weight * weight)).alias("norm"))


def _tagged(items: Column, tag: str, value: str, name: str) -> Column:
    """The items of an array as structs with a constant beside each."""
    return F.transform(items, lambda x: F.struct(F.lit(value).alias(tag), x.alias(name)))


def _clause_field(name: str) -> Column:
    return F.transform("clauses", lambda c: c[name])


def token_counts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ord, doc_length, kind, token, tf`` of search words and of grams, from one pass over the texts.

    The texts are shuffled by document, which is less than their tokens are; these are then counted where they lie.
    """
    texts = documents.select(key, "ord", F.col(text).alias("_text")).repartition(key)
    split = texts.select(key, "ord", search_tokens(F.col("_text")).alias("_words"), gram_words(F.col("_text")).alias("_w")).withColumn("_grams", with_pairs(F.col("_w")))
    both = F.concat(*[_tagged(F.col(c), "kind", k, "token") for k, c in ((WORD, "_words"), (GRAM, "_grams"))])
    tokens = split.select(key, "ord", F.size("_words").cast("bigint").alias("doc_length"), F.explode(both).alias("x")).select(key, "ord", "doc_length", "x.kind", "x.token")
    return tokens.groupBy(key, "ord", "doc_length", "kind", "token").agg(F.count(F.lit(1)).alias("tf"))


def clause_tokens(documents: DataFrame) -> DataFrame:
    """``term, chunk_id, ord, clause_no``: each different search word of each clause."""
    each = documents.select("chunk_id", "ord", F.posexplode("clauses").alias("clause_no", "c"))
    return each.select(F.explode(F.array_distinct(search_tokens(F.col("c.clause_text")))).alias("term"), "chunk_id", "ord", "clause_no")


def _plain_kind(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), "_", " "))


def clause_kinds(documents: DataFrame) -> DataFrame:
    """``kind, role, chunk_id, ord, clauses``: how many clauses of a chunk have a topic or an action, as plain words."""
    each = documents.select("chunk_id", "ord", F.explode("clauses").alias("c"))
    roles = F.array(F.struct(F.lit("topic").alias("role"), _plain_kind(F.col("c.policy_topic")).alias("kind")), F.struct(F.lit("action").alias("role"), _plain_kind(F.col("c.action")).alias("kind")))
    named = each.select("chunk_id", "ord", F.explode(roles).alias("r")).where("r.kind <> ''")
    return named.groupBy(F.col("r.kind").alias("kind"), F.col("r.role").alias("role"), "chunk_id", "ord").agg(F.count(F.lit(1)).alias("clauses"))


def filter_values(documents: DataFrame) -> DataFrame:
    """``name, value, chunk_id``: the lower-case values of a chunk and of its clauses that filters compare with."""
    values = {k: F.filter(F.array_append(_clause_field(k), F.col(f"meta_{k}")), lambda x: x.isNotNull()) for k in FILTER_KEYS}
    named = F.concat(*[_tagged(F.array_distinct(F.transform(v, F.lower)), "name", k, "value") for k, v in values.items()])
    return documents.select("chunk_id", F.explode(named).alias("x")).select("x.name", "x.value", "chunk_id")


def _write_sorted(rows: DataFrame, path: str, *by: str, partition: str | None = None) -> None:
    """A table sorted by ``by``, of which a search reads few row groups. Rebalancing splits what is hot and joins what is small."""
    writer = rows.hint("rebalance", *by[:2]).sortWithinPartitions(*by).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


@dataclass(frozen=True)
class HybridIndex:
    """A written index; ``path`` is a folder that all executors share."""

    path: str

    @staticmethod
    def build(chunks: DataFrame, clauses: DataFrame, path: str, chunk_order: str = "row_no", clause_order: str = "row_no", fingerprint: str | None = None) -> HybridIndex:
        """Writes the tables. Repeated chunk ids: the last row counts, at the place of the first.

        ``fingerprint`` is kept beside the tables; ``is_current`` compares it later, so an index is rebuilt when its inputs change.
        """
        spark = chunks.sparkSession
        index = HybridIndex(path)
        _drop(spark, f"{path}/fingerprint")  # until the new tables are complete
        content = chunks.select("chunk_id", "text", *[F.col(f"metadata.{k}").alias(f"meta_{k}") for k in ("source_id", "document_id", "document_type", "carrier", "supplier", "offer_or_circular_id", "section_title")], F.col(chunk_order).alias("ord"))
        unique = last_by_id(content.withColumnRenamed("ord", "_order"), "chunk_id", "_order")
        docs = attach_clauses(unique, clauses, clause_order)
        _write_sorted(docs.withColumn("combined", combined_text(F.col("text"), F.col("clauses"))).drop("_order"), f"{path}/documents", "chunk_id")
        docs = index.table(spark, "documents")
        _write_sorted(token_counts(docs, "chunk_id", "combined"), f"{path}/counts", "kind", "token", partition="kind")

        def vectors() -> None:
            index.table(spark, "grams").groupBy("gram").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/gram_terms")
            n_docs = docs.count()
            vector_norms(index.table(spark, "grams"), index.table(spark, "gram_terms"), "chunk_id", n_docs).write.mode("overwrite").parquet(f"{path}/norms")

        # tables that do not build on each other are written side by side, so that none waits for the last tasks of another
        steps = [
            vectors,
            lambda: document_frequencies(index.table(spark, "postings")).write.mode("overwrite").parquet(f"{path}/terms"),
            lambda: corpus_statistics(document_lengths(docs, "chunk_id", "combined")).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics"),
            lambda: _write_sorted(clause_tokens(docs), f"{path}/clause_postings", "term", "chunk_id"),
            lambda: _write_sorted(clause_kinds(docs), f"{path}/kinds", "kind", "chunk_id"),
            lambda: _write_sorted(filter_values(docs), f"{path}/attributes", "name", "value", "chunk_id"),
        ]
        with ThreadPoolExecutor(len(steps)) as pool:
            for done in [pool.submit(step) for step in steps]:
                done.result()
        _write_fingerprint(spark, path, fingerprint or "")
        return index

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if name in ("postings", "grams"):
            schema = "chunk_id string, ord bigint, doc_length bigint, token string, tf bigint"
            path = f"{self.path}/{TABLES[name]}"
            # a corpus without tokens has no such folder
            rows = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
            return rows.withColumnRenamed("token", "term") if name == "postings" else rows.select("chunk_id", "ord", F.col("token").alias("gram"), "tf")
        return spark.read.parquet(f"{self.path}/{TABLES[name]}")

    def is_current(self, spark: SparkSession, fingerprint: str) -> bool:
        """Whether the index exists and was built from inputs with this fingerprint."""
        if not _exists(spark, f"{self.path}/fingerprint"):
            return False
        rows = spark.read.schema("fingerprint string").json(f"{self.path}/fingerprint").take(1)
        return bool(rows) and rows[0]["fingerprint"] == fingerprint

    def scores(self, spark: SparkSession, query: str, filters: dict[str, str] | None = None) -> DataFrame:
        """``chunk_id, ord, bm25, vector, clause_boost, hybrid`` of all chunks that have any score."""
        zero = F.lit(0.0)
        bm25 = bm25_scores(self.table(spark, "postings"), self.table(spark, "terms"), self.table(spark, "statistics"), spark, query, "ord")
        dots, norm = vector_products(self.table(spark, "grams"), self.table(spark, "statistics"), spark, query, "ord")
        boost = boost_scores(self.table(spark, "clause_postings"), self.table(spark, "kinds"), query)
        parts = (
            bm25.select("chunk_id", "ord", "bm25", zero.alias("dot"), zero.alias("clause_boost"))
            .unionAll(dots.select("chunk_id", "ord", zero, "dot", zero))
            .unionAll(boost.select("chunk_id", "ord", zero, zero, "clause_boost"))
        )
        for name, value in (filters or {}).items():
            if name not in FILTER_KEYS:
                raise ValueError(f"unknown filter: {name}")
            if value:
                allowed = self.table(spark, "attributes").where((F.col("name") == name) & (F.col("value") == value.lower())).select("chunk_id")
                parts = parts.join(allowed, "chunk_id", "left_semi")
        summed = parts.groupBy("chunk_id").agg(F.min("ord").alias("ord"), F.sum("bm25").alias("bm25"), F.sum("dot").alias("dot"), F.sum("clause_boost").alias("clause_boost"))
        normed = summed.join(self.table(spark, "norms"), "chunk_id", "left").crossJoin(F.broadcast(norm))  # one row
        vector = F.coalesce(F.try_divide(F.col("dot") / F.col("norm"), F.col("qnorm")), zero)
        hits = normed.select("chunk_id", "ord", "bm25", vector.alias("vector"), "clause_boost").where("bm25 > 0 OR vector > 0 OR clause_boost > 0")
        # sums in another order must not change the ranking
        return hits.withColumn("hybrid", F.round(WEIGHT_BM25 * F.col("bm25") + WEIGHT_VECTOR * F.col("vector") + F.col("clause_boost"), 9))

    def search(self, spark: SparkSession, query: str, top_k: int | None = 5, filters: dict[str, str] | None = None) -> DataFrame:
        """The best chunks with ``bm25, vector, clause_boost, hybrid`` and ``rank`` from 1; ``top_k`` None gives all.

        A chunk without any score is no hit. Equal scores keep the chunks' order. Filters with empty values are ignored.
        With ``top_k`` the ranking is done at once, and of the documents those ``top_k`` are read, by their ids.
        """
        hits, docs = self.scores(spark, query, filters), self.table(spark, "documents").drop("ord")
        if top_k is None:
            return docs.join(hits, "chunk_id")
        best = hits.orderBy(F.desc("hybrid"), F.asc("ord")).limit(top_k).collect()
        ranked = [(*r, i) for i, r in enumerate(best, 1)]
        scores = spark.createDataFrame(ranked, T.StructType([*hits.schema.fields, T.StructField("rank", T.IntegerType())]))
        return docs.where(F.col("chunk_id").isin([r["chunk_id"] for r in best])).join(F.broadcast(scores), "chunk_id").coalesce(1).sortWithinPartitions("rank")


def query_terms(query: str) -> dict[str, int]:
    """The query's search tokens with their counts; a query is one short text."""
    return dict(Counter(t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) > 1))


def query_grams(query: str) -> dict[str, int]:
    """The query's words and pairs with their counts."""
    w = re.findall(r"\w{2,}", query.lower())
    return dict(Counter([*w, *map(" ".join, zip(w, w[1:]))]))


def _literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, T.StructType.fromDDL(schema))


def bm25_scores(postings: DataFrame, terms: DataFrame, statistics: DataFrame, spark: SparkSession, query: str, *carried: str) -> DataFrame:
    """``chunk_id, bm25`` of the chunks that have a term of the query; a term repeated in the query counts as often.

    ``carried``: further columns of the postings that belong to the chunk.
    """
    counts = query_terms(query)
    wanted = list(counts)
    q = _literal_table(spark, list(counts.items()), "term string, qn bigint")
    known = terms.where(F.col("term").isin(wanted)).join(F.broadcast(q), "term")
    # the query's terms and the one row of statistics are a few dozen rows at most
    parts = postings.where(F.col("term").isin(wanted)).join(F.broadcast(known.crossJoin(statistics)), "term")
    avgdl = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_length") / avgdl))
    return parts.groupBy("chunk_id", *carried).agg(F.sum(F.col("qn") * idf * gain).alias("bm25"))


def vector_products(counts: DataFrame, statistics: DataFrame, spark: SparkSession, query: str, *carried: str) -> tuple[DataFrame, DataFrame]:
    """(``chunk_id, dot``: the product of the query's and the chunk's gram weights, ``qnorm``: one row, the query's length).

    Grams outside the corpus don't count. The frequencies of the query's grams follow from the rows read for them. A corpus
    or query without grams gives no rows.
    """
    asked = query_grams(query)
    q = _literal_table(spark, list(asked.items()), "gram string, qn bigint")
    hits = counts.where(F.col("gram").isin(list(asked)))
    weighed = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(q), "gram").crossJoin(statistics).select("gram", "qn", smooth_idf(F.col("n_docs"), F.col("df")).alias("idf"))
    # at most one row per gram of the query
    norm = weighed.agg(F.sqrt(F.sum((F.col("qn") * F.col("idf")) * (F.col("qn") * F.col("idf")))).alias("qnorm"))
    return hits.join(F.broadcast(weighed), "gram").groupBy("chunk_id", *carried).agg(F.sum(F.col("tf") * F.col("idf") * F.col("qn") * F.col("idf")).alias("dot")), norm


def boost_scores(postings: DataFrame, kinds: DataFrame, query: str) -> DataFrame:
    """``chunk_id, ord, clause_boost``: what a chunk's clauses add: the query's words that each clause has, and topics or
    actions that stand in the query, as any part of it, once for each clause. A query without search words adds nothing."""
    asked, low = list(query_terms(query)), F.lit(query.lower())
    each = postings.where(F.col("term").isin(asked)).groupBy("chunk_id", "ord", "clause_no").agg(F.count(F.lit(1)).alias("shared"))
    overlap = each.select("chunk_id", "ord", F.least(F.lit(OVERLAP_MOST), OVERLAP_STEP * F.col("shared")).alias("part"))
    standing = kinds.where(low.contains(F.col("kind")) if asked else F.lit(False))
    bonus = standing.select("chunk_id", "ord", (F.col("clauses") * F.when(F.col("role") == "topic", TOPIC_BONUS).otherwise(ACTION_BONUS)).alias("part"))
    return overlap.unionAll(bonus).groupBy("chunk_id", "ord").agg(F.sum("part").alias("clause_boost"))


class KeywordIndex:
    """A term index of documents (``id, text`` and a ``metadata`` string) in a folder; searched by BM25 over the text.

    Adding documents appends to a log, in which the last entry of an id counts; the postings are built anew on the next
    search after that, so many documents should be added at once.
    """

    SCHEMA = "id string, text string, metadata string, seq bigint"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        if not _exists(self.spark, f"{self.path}/documents"):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/documents")

    def index(self, documents: DataFrame) -> None:
        """Adds or replaces documents; their ids have to be distinct within one call."""
        seq = (self._log().agg(F.max("seq")).first()[0] or 0) + 1
        documents.select(F.col("id").cast("string"), "text", F.coalesce("metadata", F.lit("{}")).alias("metadata"), F.lit(seq).cast("bigint").alias("seq")).write.mode("append").parquet(f"{self.path}/documents")

    def documents(self, ids: list[str] | None = None) -> DataFrame:
        """The current documents, or those of some ids."""
        log = self._log().where("id IS NOT NULL")
        last = (log if ids is None else log.where(F.col("id").isin(ids))).groupBy("id").agg(F.max_by(F.struct("text", "metadata"), "seq").alias("d"))
        return last.select("id", "d.text", "d.metadata")

    def search(self, query: str, size: int = 10) -> DataFrame:
        """The best documents: ``id, score, text, metadata``; ties by id. The ranking is done at once; of the texts those
        ``size`` are read."""
        mark = input_fingerprint(self.spark, f"{self.path}/documents")
        index = HybridIndex(f"{self.path}/terms")
        if not index.is_current(self.spark, mark):
            docs = self.documents().withColumn("ord", F.lit(0).cast("bigint")).withColumnRenamed("id", "chunk_id")
            words = token_counts(docs, "chunk_id", "text").where(F.col("kind") == WORD)
            _write_sorted(words, f"{index.path}/counts", "kind", "token", partition="kind")
            document_frequencies(index.table(self.spark, "postings")).write.mode("overwrite").parquet(f"{index.path}/terms")
            corpus_statistics(document_lengths(docs, "chunk_id", "text")).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/statistics")
            _write_fingerprint(self.spark, index.path, mark)
        scores = bm25_scores(index.table(self.spark, "postings"), index.table(self.spark, "terms"), index.table(self.spark, "statistics"), self.spark, query)
        ranked = scores.select(F.col("chunk_id").alias("id"), F.round("bm25", 9).alias("score"))
        best = ranked.orderBy(F.desc("score"), "id").limit(size).collect()
        found = self.spark.createDataFrame(best, ranked.schema)
        return self.documents([r["id"] for r in best]).join(F.broadcast(found), "id").select("id", "score", "text", "metadata").orderBy(F.desc("score"), "id")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _write_fingerprint(spark: SparkSession, path: str, fingerprint: str) -> None:
    """The mark of a complete index; it is written last."""
    spark.range(1).select(F.lit(fingerprint).alias("fingerprint")).coalesce(1).write.mode("overwrite").json(f"{path}/fingerprint")


def input_fingerprint(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and change times of all files under the paths, and the index format; absent paths count nothing."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            files = fs.listFiles(p, True)
            while files.hasNext():
                f = files.next()
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return json.dumps([FORMAT, *sorted(found)])


def cached_index(spark: SparkSession, chunks: DataFrame, clauses: DataFrame, path: str, fingerprint: str) -> HybridIndex:
    """The index at ``path``, rebuilt unless it was built from inputs with the same fingerprint."""
    index = HybridIndex(path)
    return index if index.is_current(spark, fingerprint) else HybridIndex.build(chunks, clauses, path, fingerprint=fingerprint)
