"""Scans and sinks: folders of PDF and HTML files, the manifest, JSON Lines, and other label stores."""

from __future__ import annotations

import io
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelode.functions.text import or_null
from farelode.schema import LABEL_SCHEMA, MANIFEST_FIELDS, MANIFEST_SCHEMA, METADATA_FIELDS, OVERLAY_FIELDS, SOURCE_TYPES
from farelode.sources.pdf import read_pdf

# ---------------------------------------------------------------------------------------------------------------------
# Fixed values.
FORMATS = {"pdf": "fare_rule", "html": "terms_page", "htm": "terms_page"}
SILENT_TAGS = ("script", "style", "template", "noscript")
# ---------------------------------------------------------------------------------------------------------------------


# JSON Lines ----------------------------------------------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON Lines under a declared schema. Lenient: blank and broken lines are left out, an absent path is empty. Strict: they are errors."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    if not strict and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return reader.json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A folder of JSON Lines files, replaced as a whole; null fields are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# Manifest ------------------------------------------------------------------------------------------------------------


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's 18 columns and ``ord``; columns that a file lacks are null, an absent file is empty.

    ``ord`` numbers the rows as they are read: files with multi-line values are not split, so within a file, and over several
    files in the order in which they are listed.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([*MANIFEST_SCHEMA.fields, T.StructField("ord", T.LongType())]))
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    return rows.select(*[(F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast("string")).alias(n) for n in MANIFEST_FIELDS], F.monotonically_increasing_id().alias("ord"))


def manifest_by_file(manifest: DataFrame, order: str = "ord") -> DataFrame:
    """One row per file: ``file_key`` (trimmed, lower case) and the overlay columns with blanks as null; of repeated files the last row."""
    keyed = manifest.select(F.lower(or_null(F.col("source_filename"))).alias("file_key"), F.col(order).alias("_ord"), *[or_null(F.col(n)).alias(n) for n in OVERLAY_FIELDS]).where("file_key IS NOT NULL")
    last = Window.partitionBy("file_key").orderBy(F.desc("_ord"))
    return keyed.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_ord")


def manifest_source_ids(manifest: DataFrame) -> DataFrame:
    """The distinct non-blank source ids."""
    return manifest.select(or_null(F.col("source_id")).alias("source_id")).where("source_id IS NOT NULL").distinct()


def overlay_manifest(documents: DataFrame, file_key: Column, by_file: DataFrame) -> DataFrame:
    """``documents`` with their ``metadata`` overlaid: values of the manifest's row before the document's own.

    A document type outside the known ones is not taken over. Documents without a row stay as they are.
    """
    row = by_file.select(F.struct(*[F.col(n) for n in OVERLAY_FIELDS]).alias("_row"), F.col("file_key").alias("_key"))
    joined = documents.join(row, F.lower(file_key) == F.col("_key"), "left")
    meta = F.col("metadata")
    for name in OVERLAY_FIELDS:
        new = F.col(f"_row.{name}")
        if name == "document_type":
            new = F.when(new.isin(*SOURCE_TYPES), new)
        meta = meta.withField(name, F.coalesce(new, F.col(f"metadata.{name}")))
    return joined.withColumn("metadata", meta).drop("_row", "_key")


# Documents -----------------------------------------------------------------------------------------------------------


class _VisibleText(HTMLParser):
    """Collects text nodes outside scripts and styles; comments and declarations are no text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0
        self.open = False  # whether the last node may go on

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in SILENT_TAGS
        self.open = False

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT_TAGS and self.silent:
            self.silent -= 1
        self.open = False

    def handle_comment(self, data: str) -> None:
        self.open = False

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        if self.open:  # the parser hands out one node in pieces
            self.parts[-1] += data
        else:
            self.parts.append(data)
        self.open = True


def html_text(html: str | None) -> str | None:
    """The text nodes of a page, joined by line feeds; null stays null."""
    if html is None:
        return None
    parser = _VisibleText()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.parts)


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: html_text(p) if isinstance(p, str) else None)


def pdf_text(content: bytes) -> str:
    """The texts of a file's pages, joined by line feeds, read by a PDF library or else by ``sources.pdf``. A file that is no
    PDF is an error."""
    try:
        from pypdf import PdfReader
    except ImportError:
        try:
            from PyPDF2 import PdfReader
        except ImportError:
            return "\n".join(read_pdf(content))
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under a folder, at any depth: ``path, content, file_format`` (the last suffix in lower case)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return files.select("path", "content", suffix.alias("file_format"))


def parse_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of scanned files.

    Documents have ``path, text, metadata``: source id is the path, document id the file name, the type follows from the
    format. Files of other formats and pages that are not UTF-8 go to the quarantine with a ``reason``. A broken PDF is an error.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, reasons = [], []
            for content, kind in zip(batch["content"], batch["file_format"]):
                text, reason = None, None
                if kind == "pdf":
                    text = pdf_text(bytes(content))
                elif kind in FORMATS:
                    try:
                        text = html_text(bytes(content).decode("utf-8"))
                    except UnicodeDecodeError:
                        reason = "not UTF-8"
                else:
                    reason = "unsupported format"
                texts.append(text)
                reasons.append(reason)
            yield pd.DataFrame({"path": batch["path"], "file_format": batch["file_format"], "text": texts, "reason": reasons})

    parsed = files.mapInPandas(parse, "path string, file_format string, text string, reason string")
    plain_path = F.regexp_replace("path", "^file:/+", "/")
    kinds = F.create_map(*[x for k, v in FORMATS.items() for x in (F.lit(k), F.lit(v))])
    known = {"source_id": plain_path, "document_id": F.element_at(F.split("path", "/"), -1), "document_type": F.try_element_at(kinds, F.col("file_format"))}
    meta = F.struct(*[(known[n] if n in known else F.lit(None)).cast("string").alias(n) for n in METADATA_FIELDS])
    return parsed.where("reason IS NULL").select("path", "text", meta.alias("metadata")), parsed.where("reason IS NOT NULL").select("path", "reason")


def parse_document(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """One file as a document; an unsupported format is an error."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file format: {suffix or 'none'}")
    documents, _ = parse_documents(scan_files(spark, path))
    return documents if manifest is None else overlay_manifest(documents, F.element_at(F.split("path", "/"), -1), manifest_by_file(manifest))


def ingest_folder(spark: SparkSession, folder: str, manifests: tuple[DataFrame, ...] = (), size: int = 150, overlap: int = 30) -> DataFrame:
    """The chunks of all documents of a folder; each manifest is laid over the metadata in turn."""
    from farelode.operators.clauses import chunk_documents

    documents, _ = parse_documents(scan_files(spark, folder))
    for manifest in manifests:
        documents = overlay_manifest(documents, F.element_at(F.split("path", "/"), -1), manifest_by_file(manifest))
    return chunk_documents(documents.select("text", "metadata"), size, overlap)


def read_label_file(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a JSON Lines file, leniently."""
    return read_jsonl(spark, path, LABEL_SCHEMA)
