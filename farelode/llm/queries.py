"""Queries of the text operators, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farelode.functions.text import SPACE
from farelode.llm.boilerplate import classify_lines, main_content
from farelode.llm.canonical import UNMATCHED, Issuer, NameParser, issuer_candidates, map_issuers, map_names, name_candidates, name_vocabulary
from farelode.llm.mixing import mix_sources, place_rows, reached_shares, source_budgets
from farelode.llm.packing import container_fill, pack
from farelode.llm.pieces import split_oversized
from farelode.llm.sentences import Openings, learn_openings, sentence_units
from farelode.llm.truncation import find_truncated, length_table, truncation_rates
from farelode.tables import clean_id, spread, table

FROM_WEB = "metadata.source_url IS NOT NULL"


def _issuers(spark: SparkSession, folder: str) -> list[Issuer]:
    """The reference list of issuers; it is fixed (240 rows)."""
    rows = table(spark, folder, "issuer_ref").select("kind", "canonical_name", "code", "country").collect()
    return [Issuer(r["kind"], r["canonical_name"], r["code"], r["country"]) for r in rows if r["kind"] and r["canonical_name"] and r["code"]]


def _typed_issuers(spark: SparkSession, folder: str) -> DataFrame:
    manifest = table(spark, folder, "pilot_source_manifest")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("typed")) for k in ("carrier", "supplier")])).alias("v")
    return manifest.select("row_no", kinds).select("row_no", "v.kind", "v.typed").where(clean_id(F.col("typed")).isNotNull())


def p1_issuers(spark: SparkSession, folder: str) -> DataFrame:
    """Carriers and suppliers of the manifest that are not verbatim a name or code, with the code they mean."""
    mapped = map_issuers(_typed_issuers(spark, folder), _issuers(spark, folder)).where("NOT verbatim")
    return mapped.select(F.lit("pilot_source_manifest").alias("table_name"), "row_no", F.col("kind").alias("field"), "typed", "canonical")


def _typed_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, NameParser]:
    """(names, entries, parser): file names of the map that are not verbatim a file of the manifest, and its files."""
    entries = table(spark, folder, "pilot_source_manifest").select(F.col("source_filename").alias("entry")).where("entry IS NOT NULL").distinct()
    rows = table(spark, folder, "canonicalize_map").withColumn("has_new", clean_id(F.col("new_name")).isNotNull())
    typed = rows.select(
        F.col("row_no").alias("name_id"),
        F.when(F.col("has_new"), "new_name").otherwise("old_name").alias("field"),
        F.when(F.col("has_new"), F.col("new_name")).otherwise(F.col("old_name")).alias("typed"),
    ).where("typed IS NOT NULL")
    names = typed.join(entries.withColumnRenamed("entry", "_e").hint("merge"), (F.col("field") == "new_name") & (F.col("typed") == F.col("_e")), "left_anti")
    names = names.withColumn("with_type", (F.col("field") == "new_name") | F.col("typed").rlike(r"^[a-z_]+_[A-Z]+\d_\d{4}-\d\d-\d\d_"))
    words = name_vocabulary(entries)
    return names, entries, NameParser(_issuers(spark, folder), words["doc_type"], words["topic"], words["scope"])


def p1_files(spark: SparkSession, folder: str) -> DataFrame:
    """File names of the map that are not verbatim a file of the manifest, with the file they mean."""
    mapped = map_names(*_typed_files(spark, folder))
    return mapped.select(F.lit("canonicalize_map").alias("table_name"), F.col("name_id").alias("row_no"), "field", "typed", "canonical")


def p1_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """All entries within the distance of every typed value, also those that other parts of it exclude."""
    issuers = issuer_candidates(_typed_issuers(spark, folder), _issuers(spark, folder))
    by_issuer = issuers.select(F.lit("pilot_source_manifest").alias("table_name"), "row_no", F.col("kind").alias("field"), "candidate", "distance", F.lit(True).alias("agrees"))
    names, entries, parser = _typed_files(spark, folder)
    files = name_candidates(names, entries, parser).join(names.select("name_id", "field"), "name_id")
    return by_issuer.unionByName(files.select(F.lit("canonicalize_map").alias("table_name"), F.col("name_id").alias("row_no"), "field", "candidate", "distance", "agrees"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value to be mapped, with what it means."""
    return p1_issuers(spark, folder).unionByName(p1_files(spark, folder)).drop("typed")


def p1_scope(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of each field are to be mapped."""
    return p1_found(spark, folder).groupBy("table_name", "field").agg(F.count(F.lit(1)).alias("values_to_map"))


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values that stand for nothing listed, with how often they come."""
    both = p1_issuers(spark, folder).unionByName(p1_files(spark, folder))
    return both.where(F.col("canonical") == UNMATCHED).groupBy("table_name", "field", "typed").agg(F.count(F.lit(1)).alias("rows"))


def _openings(spark: SparkSession, folder: str) -> Openings:
    """What clause texts and the chunks from files show of sentence openings in scripts without terminators."""
    clauses = table(spark, folder, "policy_clauses").select(F.col("clause_text").alias("text"))
    return learn_openings(clauses.unionAll(table(spark, folder, "chunks").where(f"NOT ({FROM_WEB})").select("text")), "text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of all clause texts and of the chunks that come from files."""
    clauses = table(spark, folder, "policy_clauses").select(F.lit("policy_clauses").alias("table_name"), "row_no", F.col("clause_text").alias("text"))
    chunks = table(spark, folder, "chunks").where(f"NOT ({FROM_WEB})").select(F.lit("chunks").alias("table_name"), "row_no", "text")
    return sentence_units(spread(clauses.unionAll(chunks)), "text", keep=("table_name", "row_no"), openings=_openings(spark, folder)).drop("unit_no")


def p3_units(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence units, with their number in the text, of all documents and of web chunks (each line by itself)."""
    documents = table(spark, folder, "documents").select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_no"), "text", F.lit(False).alias("web"))
    chunks = table(spark, folder, "chunks").where(FROM_WEB).select(F.lit("chunks").alias("table_name"), "row_no", "text", F.lit(True).alias("web"))
    return sentence_units(spread(documents.unionAll(chunks)), "text", "web", keep=("table_name", "row_no"), openings=_openings(spark, folder))


def p3_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many characters other than white space the units of every text hold: all of them, once."""
    documents = table(spark, folder, "documents").select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_no"), "text", F.lit(False).alias("web"))
    chunks = table(spark, folder, "chunks").select(F.lit("chunks").alias("table_name"), "row_no", "text", F.expr(FROM_WEB).alias("web"))
    units = sentence_units(spread(documents.unionAll(chunks)), "text", "web", keep=("table_name", "row_no", "text"))
    unit = F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return units.groupBy("table_name", "row_no").agg(F.sum(F.length(F.regexp_replace(unit, SPACE, ""))).alias("letters"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all chunks with more than 150 tokens, 30 of which are repeated from the piece before."""
    return split_oversized(spread(table(spark, folder, "chunks")), "text", F.expr(FROM_WEB), keep=("row_no",), limit=150, overlap=30, openings=_openings(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that had to be cut, and whether a single unit was too large; each has exactly one first piece."""
    return p5_pieces(spark, folder).where("piece_no = 0").select("row_no", "cut_kind")


def p5_rules(spark: SparkSession, folder: str) -> DataFrame:
    """For every cut chunk its tokens and whether its pieces keep the rules: none too large, each begun with the last 30 tokens
    of the one before (all of it, if it has fewer), first and last token held."""
    before = Window.partitionBy("row_no").orderBy("piece_no")
    pieces = p5_pieces(spark, folder).withColumns({"_start": F.lag("start_token").over(before), "_end": F.lag("end_token").over(before)})
    joined = F.coalesce(F.col("start_token") == F.greatest(F.col("_end") - 30, F.col("_start")), F.col("start_token") == 0)
    return pieces.groupBy("row_no").agg(
        F.max("end_token").cast("bigint").alias("tokens"), F.bool_and(F.col("end_token") - F.col("start_token") <= 150).alias("within_limit"), F.bool_and(joined & (F.col("end_token") > F.coalesce("_end", F.lit(0)))).alias("joined")
    )


def p6_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of all web chunks with their class."""
    web = spread(table(spark, folder, "chunks")).where(FROM_WEB)
    return classify_lines(web, "text", "metadata.source_url", keep=("row_no",))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of web chunks that are not policy text."""
    return p6_lines(spark, folder).where("is_boilerplate").select("row_no", "line_no")


def p6_content(spark: SparkSession, folder: str) -> DataFrame:
    """The policy text of each web chunk."""
    return main_content(p6_lines(spark, folder), ("row_no",))


# Tokens of the byte-level tokenizer: the bytes of the UTF-8 text and one end token.
BYTE_TOKENS = "octet_length(text) + 1"


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, and of every piece of a document that is larger than one."""
    return pack(table(spark, folder, "documents"), "doc_id", F.expr(BYTE_TOKENS), 8192)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that had to be split."""
    return p7_containers(spark, folder).where("pieces > 1 AND piece_no = 0").select("doc_id")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The fill of every container."""
    return container_fill(p7_containers(spark, folder), 8192)


def p7_rules(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the tokens packed, whether any container is too full, the numbers of the containers have gaps, and whether
    there are at most one in a hundred, and one, more than the tokens need."""
    fill = p7_fill(spark, folder)
    least = F.ceil(F.sum("tokens") / 8192)
    n = F.count(F.lit(1))
    return fill.agg(F.sum("tokens").cast("bigint").alias("tokens"), (F.max("tokens") > 8192).alias("too_full"), (F.max("container_id") + 1 != n).alias("gaps"), (n <= least * 1.01 + 1).alias("dense"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mix_sources(table(spark, folder, "documents"), "doc_id", "source", F.expr(BYTE_TOKENS), table(spark, folder, "source_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The reached share of every listed source."""
    documents, tokens = table(spark, folder, "documents"), F.expr(BYTE_TOKENS)
    budgets = source_budgets(documents, "source", tokens, table(spark, folder, "source_targets"))
    return reached_shares(place_rows(documents, "doc_id", "source", tokens, budgets), budgets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sources that the mix could not bring to their share."""
    return p8_shares(spark, folder).where("short").select("source")


def p9_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The lengths of every document as it may have been stored."""
    return length_table(spread(table(spark, folder, "documents")), "doc_id", "text")


def p9_endings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with what its length and its ending show."""
    return find_truncated(spread(table(spark, folder, "documents")), "doc_id", "text", "source")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that were cut."""
    return p9_endings(spark, folder).where("truncated").select("doc_id")


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts its texts."""
    return truncation_rates(p9_endings(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_issuers": p1_issuers,
    "p1_files": p1_files,
    "p1_unmatched": p1_unmatched,
    "p1_candidates": p1_candidates,
    "p1_scope": p1_scope,
    "p3_found": p3_found,
    "p3_units": p3_units,
    "p3_coverage": p3_coverage,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_rules": p5_rules,
    "p6_found": p6_found,
    "p6_lines": p6_lines,
    "p6_content": p6_content,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_rules": p7_rules,
    "p8_found": p8_found,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_endings": p9_endings,
    "p9_rates": p9_rates,
    "p9_lengths": p9_lengths,
}

_BYTES = "(octet_length(encode(text)) + 1)"
_P8 = f"""
WITH t AS (SELECT lower(trim(source)) AS k, min(trim(source)) AS source, sum(target_share) AS target_share, min(max_repeats) AS max_repeats FROM source_targets GROUP BY 1),
     d AS (SELECT doc_id, lower(trim(source, E' \\t\\n\\r')) AS k, {_BYTES} AS tokens FROM documents WHERE text IS NOT NULL),
     n AS (SELECT k, sum(tokens) AS n FROM d GROUP BY k),
     b AS (SELECT t.*, coalesce(n.n, 0) AS n, target_share * (SELECT sum(n.n) FROM n JOIN t USING (k)) AS budget FROM t LEFT JOIN n USING (k))
"""
_P8_PLACED = _P8 + """,
     o AS (SELECT *, CAST('0x' || substr(md5(doc_id || '|42'), 1, 15) AS BIGINT) AS random FROM d),
     p AS (SELECT o.doc_id, b.source, tokens, b.max_repeats, budget, b.n, least(floor(budget / b.n), b.max_repeats) AS whole,
                  coalesce(sum(tokens) OVER (PARTITION BY k ORDER BY random, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o JOIN b USING (k)),
     m AS (SELECT doc_id, source, tokens, max_repeats, CAST(whole + CASE WHEN whole < max_repeats AND before + tokens / 2 <= budget - whole * n THEN 1 ELSE 0 END AS INTEGER) AS repeats FROM p)
"""

_BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_OWN_TOKEN = r"[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
_TOKENS = rf"(length(regexp_replace(text, '[^\x{{0E00}}-\x{{0E7F}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}]', '', 'g')) + len(list_filter(string_split_regex(text, '(?:{_BLANK}|{_OWN_TOKEN})+'), lambda w: w <> '')))"


def _among(characters: str) -> str:
    """How many of some characters (a class) a text has."""
    return f"(length(text) - length(regexp_replace(text, '[{characters}]', '', 'g')))"


_MARKUP, _QUOTES, _ESCAPED = f"(4 * {_among('&')} + 3 * {_among('<>')})", f'5 * {_among(chr(34) + chr(39) * 2)}', _among(r'"\\\n\r\t\x08\f')
_FEEDS = r"(length(text) - length(regexp_replace(text, '\n', '', 'g')) - (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2)"
_WIDE, _OTHER = _among(r"\x{10000}-\x{10FFFF}"), _among(r"\x{80}-\x{FFFF}")
_UTF8 = "octet_length(encode(text))"
_LENGTHS = {
    "characters": "length(text)", "utf8": _UTF8, "utf16": f"length(text) + {_WIDE}", "entities": f"length(text) + {_MARKUP} + {_QUOTES}", "entities_without_quotes": f"length(text) + {_MARKUP}",
    "entities_utf8": f"{_UTF8} + {_MARKUP} + {_QUOTES}", "json": f"length(text) + {_ESCAPED}", "json_utf8": f"{_UTF8} + {_ESCAPED}", "json_ascii": f"length(text) + {_ESCAPED} + 5 * {_OTHER} + 11 * {_WIDE}",
    "crlf": f"length(text) + {_FEEDS}", "crlf_utf8": f"{_UTF8} + {_FEEDS}",
}

ORACLES: dict[str, str] = {
    "p1_scope": """
      WITH v AS (SELECT 'carrier' AS field, carrier AS typed FROM pilot_source_manifest UNION ALL SELECT 'supplier', supplier FROM pilot_source_manifest),
           f AS (SELECT CASE WHEN trim(new_name) <> '' THEN 'new_name' ELSE 'old_name' END AS field, CASE WHEN trim(new_name) <> '' THEN new_name ELSE old_name END AS typed FROM canonicalize_map)
      SELECT 'pilot_source_manifest' AS table_name, field, count(*) AS values_to_map FROM v
      WHERE trim(typed) <> '' AND NOT EXISTS (SELECT 1 FROM issuer_ref r WHERE r.kind = v.field AND v.typed IN (r.canonical_name, r.code)) GROUP BY field
      UNION ALL
      SELECT 'canonicalize_map', field, count(*) FROM f WHERE typed IS NOT NULL AND NOT (field = 'new_name' AND typed IN (SELECT source_filename FROM pilot_source_manifest WHERE source_filename IS NOT NULL)) GROUP BY field""",
    "p3_coverage": f"""SELECT table_name, row_no, CAST(length(regexp_replace(text, '{_BLANK}', '', 'g')) AS BIGINT) AS letters FROM (
        SELECT 'documents' AS table_name, doc_id AS row_no, text FROM documents UNION ALL SELECT 'chunks', row_no, text FROM chunks) WHERE regexp_replace(text, '{_BLANK}', '', 'g') <> ''""",
    "p5_rules": f"SELECT row_no, CAST({_TOKENS} AS BIGINT) AS tokens, true AS within_limit, true AS joined FROM chunks WHERE {_TOKENS} > 150",
    "p7_rules": f"SELECT CAST(sum({_BYTES}) AS BIGINT) AS tokens, false AS too_full, false AS gaps, true AS dense FROM documents WHERE text IS NOT NULL",
    "p9_lengths": f"SELECT doc_id, {', '.join(f'CAST({v} AS BIGINT) AS {k}' for k, v in _LENGTHS.items())} FROM documents WHERE trim(text) <> ''",
    "p7_found": f"SELECT doc_id FROM documents WHERE {_BYTES} > 8192",
    "p8_found": _P8 + "SELECT source FROM b WHERE max_repeats * n < budget",
    "p8_mix": _P8_PLACED + "SELECT doc_id, source, tokens, repeats FROM m WHERE repeats > 0",
    "p8_shares": _P8_PLACED
    + """, u AS (SELECT source, sum(tokens * repeats) AS used_tokens, count(*) FILTER (repeats > 0) AS used_rows, count(*) FILTER (repeats < max_repeats) AS spare_rows FROM m GROUP BY source)
      SELECT source, target_share, max_repeats, CAST(n AS BIGINT) AS available_tokens, budget, coalesce(used_rows, 0) AS used_rows, CAST(coalesce(used_tokens, 0) AS BIGINT) AS used_tokens,
             coalesce(spare_rows, 0) AS spare_rows, coalesce(used_tokens, 0) / (SELECT sum(used_tokens) FROM u) AS reached_share, max_repeats * n < budget AS short FROM b LEFT JOIN u USING (source)""",
}
