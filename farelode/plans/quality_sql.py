"""DuckDB SQL that gives the same results as the queries on label payloads."""

from __future__ import annotations


def _strict(a: str) -> str:
    """Whether a text is JSON; DuckDB's reader also takes NaN, Infinity and trailing commas."""
    return rf"""(json_valid({a}) AND NOT regexp_matches(regexp_replace({a}, '"(\\.|[^"\\])*"', '""', 'g'), '(?i)nan|inf|,\s*[}}\]]'))"""


def _decoded(a: str) -> str:
    """A JSON value; for text that encodes an object or a list, what it encodes, and null where it is broken."""
    return rf"""(CASE WHEN json_type({a}) <> 'VARCHAR' OR NOT regexp_matches({a} ->> '$', '^\s*("\s*)?[\[{{]') THEN {a} WHEN {_strict(f"({a} ->> '$')")} THEN CAST({a} ->> '$' AS JSON) END)"""


def _twice(a: str) -> str:
    return _decoded(_decoded(a))


_NAMED = r"lower(array_to_string(regexp_extract_all(regexp_replace(key, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[\p{L}\p{N}]+'), '_'))"
# what is left of a value without names, nulls and blank texts
_TOLD = r"""regexp_matches(regexp_replace(regexp_replace(CAST(n.v AS VARCHAR), '"(\\.|[^"\\])*"\s*:', '', 'g'), 'null|"(\s|\\[ntrbf]|\\u00(20|a0|09))*"', '', 'g'), '[^\s{}\[\],]')"""
_DOCUMENTS = "SELECT 'manual_labels' AS t, row_no, payload_json AS j FROM manual_labels UNION ALL SELECT 'label_save_requests', request_id, body_json FROM label_save_requests"
_ROOTS = f"docs AS ({_DOCUMENTS}), root AS (SELECT t, row_no, j, CASE WHEN {_strict('j')} THEN {_twice('CAST(j AS JSON)')} END AS v FROM docs)"

ITEMS = f"""
WITH RECURSIVE {_ROOTS},
node AS (
  SELECT t, row_no, 'document' AS name, v, CAST([] AS INTEGER[]) AS path, 0 AS item_no, CAST(NULL AS INTEGER[]) AS save_path FROM root WHERE json_type(v) IN ('OBJECT', 'ARRAY')
  UNION ALL
  SELECT t, row_no, name, v, path, item_no, CASE WHEN name IN ('saves', 'item') THEN path ELSE save_path END FROM (
    SELECT t, row_no, name, save_path, list_concat(path, [CAST(k AS INTEGER), CAST(i AS INTEGER)]) AS path, CAST(i AS INTEGER) AS item_no,
           {_twice("CAST(CASE WHEN many THEN json_extract(v, '$[' || i || ']') ELSE v END AS JSON)")} AS v FROM (
      SELECT *, unnest(range(CAST(CASE WHEN many THEN json_array_length(v) ELSE 1 END AS BIGINT))) AS i FROM (
        SELECT *, json_type(v) = 'ARRAY' AS many FROM (
          SELECT t, row_no, save_path, path, k, {_NAMED} AS name, {_twice("json_extract(v, '$." + '"' + "' || key || '" + '"' + "')")} AS v FROM (
            SELECT n.*, unnest(json_keys(n.v)) AS key, unnest(range(len(json_keys(n.v)))) AS k FROM node n WHERE json_type(n.v) = 'OBJECT'))
        UNION ALL
        SELECT t, row_no, save_path, path, 0, 'item', v, true FROM node WHERE json_type(v) = 'ARRAY')))),
saves AS (SELECT t, row_no, path, row_number() OVER (PARTITION BY t, row_no, name ORDER BY path) - 1 AS save_no FROM node WHERE name IN ('saves', 'item'))
SELECT n.t AS table_name, n.row_no, CAST(CASE WHEN n.t = 'manual_labels' THEN 0 ELSE coalesce(s.save_no, 0) END AS INTEGER) AS save_no, n.name AS child_kind, n.item_no
FROM node n LEFT JOIN saves s ON s.t = n.t AND s.row_no = n.row_no AND s.path = n.save_path
WHERE n.name IN ('penalty_tiers', 'refund_payout_options', 'eligibility_conditions', 'exceptions') AND {_TOLD}
"""

REJECTED = f"""
WITH {_ROOTS}
SELECT t AS table_name, row_no, CASE WHEN trim(j) = 'null' OR v IS NOT NULL THEN 'no_record' ELSE 'not_json' END AS reason FROM root
WHERE trim(j) <> '' AND coalesce(json_type(v), '') NOT IN ('OBJECT', 'ARRAY')
"""

GRAPH = f"""
WITH RECURSIVE {_ROOTS},
node AS (
  SELECT t, row_no, 'document' AS element, v, CAST([] AS VARCHAR[]) AS above FROM root WHERE json_type(v) IN ('OBJECT', 'ARRAY')
  UNION ALL
  SELECT t, row_no, element, v, above FROM (
    SELECT t, row_no, {_NAMED} AS element, {_twice("json_extract(v, '$." + '"' + "' || key || '" + '"' + "')")} AS v, CASE WHEN list_contains(above, {_NAMED}) THEN above ELSE list_append(above, {_NAMED}) END AS above
    FROM (SELECT n.*, unnest(json_keys(n.v)) AS key FROM node n WHERE json_type(n.v) = 'OBJECT')
    UNION ALL
    SELECT t, row_no, element, {_twice("json_extract(v, '$[' || i || ']')")}, above FROM (SELECT n.*, unnest(range(CAST(json_array_length(n.v) AS BIGINT))) AS i FROM node n WHERE json_type(n.v) = 'ARRAY'))
  WHERE json_type(v) IN ('OBJECT', 'ARRAY')),
member AS (SELECT t, row_no, element AS parent, {_NAMED} AS child, above, {_twice("json_extract(v, '$." + '"' + "' || key || '" + '"' + "')")} AS v FROM (SELECT *, unnest(json_keys(v)) AS key FROM node WHERE json_type(v) = 'OBJECT')),
edge AS (SELECT parent, child, bool_or(coalesce(json_type(v) = 'ARRAY', false)) AS repeated, bool_or(coalesce(json_type(v) IN ('OBJECT', 'ARRAY'), false) AND list_contains(above, child)) AS recursive, count(DISTINCT (t, row_no)) AS documents FROM member GROUP BY parent, child),
inner_ AS (SELECT DISTINCT parent AS e FROM edge),
reach AS (SELECT parent AS a, child AS b FROM edge WHERE child IN (SELECT e FROM inner_) UNION SELECT r.a, e.child FROM reach r JOIN edge e ON e.parent = r.b WHERE e.child IN (SELECT e FROM inner_)),
told AS (SELECT child AS e FROM edge WHERE repeated OR recursive UNION SELECT child FROM edge WHERE child IN (SELECT e FROM inner_) GROUP BY child HAVING count(*) > 1 UNION SELECT a FROM reach WHERE a = b),
asked AS (SELECT unnest(['saves', 'penalty_tiers', 'refund_payout_options', 'eligibility_conditions', 'exceptions']) AS e)
SELECT parent, child, repeated, recursive, CAST(documents AS BIGINT) AS documents, child IN (SELECT e FROM told UNION SELECT e FROM asked) AS own_table, child IN (SELECT e FROM asked) AND child NOT IN (SELECT e FROM told) AS only_requested FROM edge
"""

_MEMBER = _twice("json_extract(v, '$." + '"' + "' || key || '" + '"' + "')")
# the rows of all tables, with the tables that the graph gives
KEYS = (
    GRAPH[: GRAPH.rindex("SELECT parent, child, repeated")].rstrip()
    + f""",
tables AS (SELECT e FROM told UNION SELECT e FROM asked),
line AS (
  SELECT t, row_no, 'document' AS own, '' AS row_key, CAST(NULL AS VARCHAR) AS parent_table, CAST(NULL AS VARCHAR) AS parent_key, 0 AS ordinal, v, true AS is_row FROM root WHERE json_type(v) IN ('OBJECT', 'ARRAY')
  UNION ALL SELECT * FROM (
  SELECT t, row_no, name, CASE WHEN length(path) > 200 THEN '#' || md5(path) ELSE path END, own, row_key, CAST(i AS INTEGER), v, true FROM (
    SELECT *, row_key || '/' || name || '.' || i AS path FROM (
      SELECT t, row_no, own, row_key, name, i, {_twice("CAST(CASE WHEN many THEN json_extract(v, '$[' || i || ']') ELSE v END AS JSON)")} AS v FROM (
        SELECT *, unnest(range(CAST(CASE WHEN many THEN json_array_length(v) ELSE 1 END AS BIGINT))) AS i FROM (
          SELECT t, row_no, own, row_key, {_NAMED} AS name, {_MEMBER} AS v, json_type({_MEMBER}) = 'ARRAY' AS many FROM (SELECT *, unnest(json_keys(v)) AS key FROM line WHERE json_type(v) = 'OBJECT')
          UNION ALL
          SELECT t, row_no, own, row_key, 'item', v, true FROM line WHERE json_type(v) = 'ARRAY' AND is_row)
        WHERE (many OR json_type(v) <> 'NULL') AND name IN (SELECT e FROM tables UNION SELECT 'item'))))
  UNION ALL
  SELECT t, row_no, own, row_key, parent_table, parent_key, ordinal, v, false FROM (
    SELECT *  EXCLUDE (v), {_MEMBER} AS v FROM (SELECT *, unnest(json_keys(v)) AS key FROM line WHERE json_type(v) = 'OBJECT')) WHERE {_NAMED} NOT IN (SELECT e FROM tables) AND json_type(v) = 'OBJECT'))
SELECT t AS source_table, row_no AS doc_key, own AS table_name, row_key, parent_table, parent_key, ordinal FROM line WHERE is_row
"""
)
