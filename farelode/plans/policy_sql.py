"""DuckDB SQL that gives the same results as the queries of the policy engine."""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------------------------------
# Fixed values, written out here too, so that a wrong one on the other side shows.
NOT_ALLOWED = ("not permitted", "not allowed", "no refund", "no refunds", "non-refundable", "non refundable", "cannot", "prohibited", "forfeit", "forfeiture")
CONDITIONAL = ("subject to", "provided that", "if ", "when ", "unless ", "before departure", "after departure", "with fee", "fee applies", "penalty applies")
ALLOWED = ("allowed", "permitted", "can be changed", "can be refunded", "may be changed", "may be refunded", "refundable", "changeable")
TIME_WINDOWS = ("before departure", "after departure", "prior to departure", "within 24 hours", "within 24 hrs", "after no-show", "before no-show")
CONDITION_OPENERS = ("subject to", "provided that", "only if", "if", "when")
EXCEPTION_OPENERS = ("except(?: for)?", "excluding", "does not apply to", "not applicable to", "unless")
CONDITION_CUTS = (
    " without fee", " with usd ", " with eur ", " with gbp ", " with aed ", " with sar ", " with inr ", " with pkr ", " with cad ", " with aud ",
    " with fare difference", " and taxes only refundable", " with 20% penalty", " with penalty",
)
CURRENCIES = "USD|EUR|GBP|AED|SAR|INR|PKR|BDT|CAD|AUD"
ONLY_TAXES = ("only taxes", "taxes only", "tax only", "only tax")
NON_REFUNDABLE = "(?:non[- ]refundable|not refundable)"
STUB_NOTE = "Stub extractor output; classify topic/action and parse structured penalties in next iteration."
SOURCE_TYPES = ("fare_rule", "airline_offer", "supplier_offer", "circular", "waiver_notice", "policy_bulletin", "terms_page", "other")
OVERLAY_FIELDS = (
    "source_id", "document_id", "document_type", "carrier", "supplier", "offer_or_circular_id", "source_url", "source_filename", "market", "route_scope",
    "cabin", "fare_family", "effective_from", "effective_to",
)
SYNTHETIC_PREFIX = "pilot_chunk_"
# ---------------------------------------------------------------------------------------------------------------------

_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
_L, _R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(column: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(p)})" for p in phrases) + ")"


def _squeezed(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '{_SPACE}+', ' ', 'g')"


def _lowered(c: str) -> str:
    return f"lower(trim({_squeezed(c)}))"


def _bare(c: str) -> str:
    return rf"regexp_replace({_squeezed(c)}, '^[ \t\r\n\-•]+|[ \t\r\n\-•]+$', '', 'g')"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '{_SPACE}+'), lambda w: w <> '')"


def topic(t: str) -> str:
    return f"""CASE WHEN {_any(t, ('no-show', 'no show'))} THEN 'no_show' WHEN {_any(t, ('go-show', 'go show'))} THEN 'go_show'
      WHEN regexp_matches({t}, '{_L}(reissue|re-?book|changes?){_R}') THEN 'reissue_change' WHEN contains({t}, 'refund') THEN 'refund'
      WHEN contains({t}, 'cancel') THEN 'cancellation' WHEN {_any(t, ('waiver', 'waive'))} THEN 'waiver' ELSE 'other' END"""


def action(t: str) -> str:
    condition = f"({_any(t, CONDITIONAL)} OR regexp_matches({t}, '{_L}fee{_R}'))"
    return f"CASE WHEN {_any(t, NOT_ALLOWED)} THEN 'not_allowed' WHEN {_any(t, ALLOWED)} THEN CASE WHEN {condition} THEN 'conditional' ELSE 'allowed' END WHEN {condition} THEN 'conditional' ELSE 'unknown' END"


def window(t: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({t}, {_q(p)}) THEN {_q(p)}" for p in TIME_WINDOWS) + " END"


def side(t: str) -> str:
    before, after = _any(t, ("before departure", "prior to departure")), _any(t, ("after departure", "after no-show"))
    return f"CASE WHEN {before} AND {after} THEN 'both' WHEN {before} THEN 'before_departure' WHEN {after} THEN 'after_departure' END"


def tax(t: str) -> str:
    near = r"[^.:\n]{0,40}"
    return f"""CASE WHEN NOT contains({t}, 'tax') THEN NULL WHEN {_any(t, ONLY_TAXES)} AND contains({t}, 'refund') THEN 'only taxes refundable'
      WHEN regexp_matches({t}, 'tax(?:es)?{near}{NON_REFUNDABLE}') OR regexp_matches({t}, '{NON_REFUNDABLE}{near}tax(?:es)?') THEN 'taxes non-refundable'
      WHEN regexp_matches({t}, 'tax(?:es)?{near}refundable') OR contains({t}, 'refundable taxes') THEN 'taxes refundable' END"""


_PERCENT = rf"(\d+(?:\.\d+)?){_SPACE}*%"
# RE2 knows no look-around: the character before a code and the one behind an amount belong to the match
_AMOUNT = rf"(?i)(?:(?:^|[^\p{{L}}\p{{N}}_])({CURRENCIES}){_SPACE}*([0-9]+\.[0-9]+|[0-9]+)(?:$|[^\p{{L}}\p{{N}}_])|\$([0-9]+(?:\.[0-9]+)?))"


def penalty_columns(raw: str, t: str) -> str:
    """The five penalty columns. An amount such as 50.5x counts as 50: a shorter number that a boundary follows."""
    text = f"coalesce({raw}, '')"
    share = f"nullif(regexp_extract({text}, '{_PERCENT}', 1), '')"
    code, coded, dollars = (f"nullif(regexp_extract({text}, '{_AMOUNT}', {i}), '')" for i in (1, 2, 3))
    branches = [
        (f"contains({t}, 'forfeit')", "'forfeiture'", "NULL", "NULL", "NULL", "NULL"),
        (_any(t, ("no fee", "without fee", "free of charge")), "'free'", "NULL", "NULL", "NULL", "NULL"),
        (f"contains({t}, 'fare difference only')", "'fare_difference_only'", "NULL", "NULL", "NULL", "true"),
        (f"{share} IS NOT NULL", "'percentage'", "NULL", "NULL", f"CAST({share} AS DOUBLE)", "NULL"),
        (f"{code} IS NOT NULL", "'fixed_amount'", f"CAST({coded} AS DOUBLE)", f"upper({code})", "NULL", "NULL"),
        (f"{dollars} IS NOT NULL", "'fixed_amount'", f"CAST({dollars} AS DOUBLE)", "'USD'", "NULL", "NULL"),
        (f"contains({t}, 'fare difference')", "NULL", "NULL", "NULL", "NULL", "true"),
    ]
    names = ("penalty_type", "penalty_amount", "penalty_currency", "penalty_percent", "fare_difference_required")
    kinds = ("VARCHAR", "DOUBLE", "VARCHAR", "DOUBLE", "BOOLEAN")
    return ", ".join("CAST(CASE " + " ".join(f"WHEN {b[0]} THEN {b[i + 1]}" for b in branches) + f" END AS {kinds[i]}) AS {n}" for i, n in enumerate(names))


def _found(raw: str, openers: tuple[str, ...]) -> str:
    """All snippets, by opener. The character before an opener is marked first, as look-behind is missing."""
    parts = []
    for o in openers:
        marked = rf"regexp_replace(coalesce({raw}, ''), '(?i)(^|[^\p{{L}}\p{{N}}_])({o})([^\p{{L}}\p{{N}}_])', '\1' || chr(1) || '\2\3', 'g')"
        # a snippet runs over later marks, which are no part of it
        parts.append(rf"list_transform(regexp_extract_all({marked}, '(?i)\x01({o}[^.;\n]+)', 1), lambda s: replace(s, chr(1), ''))")
    return "flatten([" + ", ".join(parts) + "])"


def _distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position(list_transform({items}, lambda y: lower(y)), lower(x)) = i)"


def conditions_select(source: str, key: str, raw: str) -> str:
    """``key, eligibility_conditions, exceptions`` of a source, joined by bars; in steps, as lists are used twice."""
    cut = "list_min(list_filter([" + ", ".join(f"instr(lower(b), {_q(m)})" for m in CONDITION_CUTS) + "], lambda p: p > 0))"
    trimmed = f"CASE WHEN {cut} IS NULL THEN b ELSE rtrim(substr(b, 1, {cut} - 1)) END"
    return f"""
      SELECT {key}, array_to_string({_distinct('c2')}, ' | ') AS eligibility_conditions, array_to_string({_distinct('e2')}, ' | ') AS exceptions FROM (
        SELECT {key}, list_filter(list_transform(c1, lambda x: {_bare('x')}), lambda x: x <> '') AS c2, e2 FROM (
          SELECT {key}, list_transform(list_transform({_found(raw, CONDITION_OPENERS)}, lambda x: {_bare('x')}), lambda b: {trimmed}) AS c1,
                 list_filter(list_transform({_found(raw, EXCEPTION_OPENERS)}, lambda x: {_bare('x')}), lambda x: x <> '') AS e2
          FROM {source}))"""


def split_select(source: str, key: str) -> str:
    """``key, clause_index, clause_text``: parts, islands of a part and the short ones behind it, and the two fallbacks."""
    raw = "regexp_replace(coalesce(text, ''), '\\r\\n|\\r', chr(10), 'g')"
    marked = rf"regexp_replace({raw}, '([.!?]){_SPACE}+([A-Z0-9])', '\1' || chr(1) || '\2', 'g')"
    return f"""
      SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY island) - 1 AS INTEGER) AS clause_index, clause_text FROM (
        SELECT {key}, island, string_agg(part, ' ' ORDER BY pos) AS clause_text FROM (
          SELECT {key}, pos, part, sum(CASE WHEN pos = first_pos OR len({_words('part')}) > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos) AS island FROM (
            SELECT {key}, pos, part, min(pos) OVER (PARTITION BY {key}) AS first_pos FROM (
              SELECT {key}, {_bare('x.p')} AS part, x.i AS pos FROM (
                SELECT {key}, unnest(list_transform(string_split_regex({marked}, '[;\\n\\x01]+'), lambda p, i: {{'p': p, 'i': i}})) AS x FROM {source}))
            WHERE part <> ''))
        GROUP BY {key}, island)
      UNION ALL
      SELECT {key}, 0, CASE WHEN {_bare('text')} <> '' THEN {_bare('text')} ELSE text END FROM {source}
      WHERE NOT list_bool_or(list_transform(string_split_regex({marked}, '[;\\n\\x01]+'), lambda p: {_bare('p')} <> ''))"""


def _grams(c: str) -> str:
    w = rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')"
    return f"list_concat({w}, list_transform(list_zip({w}[1:-2], {w}[2:]), lambda z: z[1] || ' ' || z[2]))"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda t: length(t) > 1)"


def hybrid_cte(question: str) -> str:
    """CTEs up to ``scored``: chunk_id, ord, bm25, vector, clause_boost, hybrid and the chunk's columns."""
    q = _q(question)
    meta = ("source_id", "document_id", "document_type", "carrier", "supplier", "offer_or_circular_id", "section_title")
    plain = lambda c: f"lower(replace(coalesce({c}, ''), '_', ' '))"
    return f"""
    WITH docs0 AS (SELECT chunk_id, arg_max({{'t': text, 'm': metadata}}, row_no) AS r, min(row_no) AS ord FROM chunks WHERE chunk_id <> '' GROUP BY chunk_id),
    cl AS (SELECT chunk_id, string_agg(coalesce(clause_text, ''), ' ' ORDER BY row_no) AS texts,
                  string_agg(replace(coalesce(policy_topic, '') || ' ' || coalesce(action, ''), '_', ' '), ' ' ORDER BY row_no) AS kinds
           FROM policy_clauses WHERE chunk_id <> '' GROUP BY chunk_id),
    docs AS (SELECT d.chunk_id, d.ord, d.r.t AS text, {', '.join(f'd.r.m.{m} AS meta_{m}' for m in meta)},
                    trim(array_to_string(list_filter([coalesce(d.r.t, ''), coalesce(texts, ''), coalesce(kinds, '')], lambda p: p <> ''), ' ')) AS combined
             FROM docs0 d LEFT JOIN cl USING (chunk_id)),
    tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_tokens('combined')}) AS term FROM docs) GROUP BY ALL),
    lens AS (SELECT chunk_id, len({_tokens('combined')}) AS dl FROM docs),
    stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT term, count(*) AS qn FROM (SELECT unnest({_tokens(q)}) AS term) GROUP BY term),
    b AS (SELECT chunk_id, sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS bm25
          FROM tf JOIN qt USING (term) JOIN df USING (term) JOIN lens USING (chunk_id) CROSS JOIN stats GROUP BY chunk_id),
    gt AS (SELECT chunk_id, gram, count(*) AS tf FROM (SELECT chunk_id, unnest({_grams('combined')}) AS gram FROM docs) GROUP BY ALL),
    idf AS (SELECT gram, ln((1 + (SELECT n FROM stats)) / (1 + count(*))) + 1 AS idf FROM gt GROUP BY gram),
    norms AS (SELECT chunk_id, sqrt(sum(tf * idf * tf * idf)) AS norm FROM gt JOIN idf USING (gram) GROUP BY chunk_id),
    qg AS (SELECT gram, qn, idf FROM (SELECT gram, count(*) AS qn FROM (SELECT unnest({_grams(q)}) AS gram) GROUP BY gram) JOIN idf USING (gram)),
    v AS (SELECT chunk_id, sum(gt.tf * qg.idf / norm * qg.qn * qg.idf) / (SELECT sqrt(sum(qn * idf * qn * idf)) FROM qg) AS vector
          FROM gt JOIN qg USING (gram) JOIN norms USING (chunk_id) GROUP BY chunk_id),
    boost AS (SELECT chunk_id, sum(CASE WHEN shared > 0 THEN least(1.5, 0.3 * shared) ELSE 0 END
                + CASE WHEN t <> '' AND contains(lower({q}), t) THEN 0.5 ELSE 0 END + CASE WHEN a <> '' AND contains(lower({q}), a) THEN 0.2 ELSE 0 END) AS clause_boost
              FROM (SELECT chunk_id, len(list_intersect({_tokens(q)}, {_tokens('clause_text')})) AS shared, {plain('policy_topic')} AS t, {plain('action')} AS a FROM policy_clauses) GROUP BY chunk_id),
    scored AS (SELECT docs.*, coalesce(bm25, 0) AS bm25, coalesce(vector, 0) AS vector, coalesce(clause_boost, 0) AS clause_boost,
                      round(coalesce(bm25, 0) + 4 * coalesce(vector, 0) + coalesce(clause_boost, 0), 9) AS hybrid
               FROM docs LEFT JOIN b USING (chunk_id) LEFT JOIN v USING (chunk_id) LEFT JOIN boost USING (chunk_id)
               WHERE coalesce(bm25, 0) > 0 OR coalesce(vector, 0) > 0 OR coalesce(clause_boost, 0) > 0)"""


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("bm25", "vector", "clause_boost", "hybrid"))


def oracles(question: str, document_type: str) -> dict[str, str]:
    t = "t"
    kinds = f"SELECT row_no, clause_text, {_lowered('clause_text')} AS t FROM policy_clauses"
    hybrid = hybrid_cte(question)
    ranked = "row_number() OVER (ORDER BY hybrid DESC, ord)"
    carried = ("source_id", "document_id", "document_type", "offer_or_circular_id", "source_url", "source_filename", "carrier", "supplier", "market", "route_scope", "fare_family", "effective_from", "effective_to", "travel_from", "travel_to", "ticketing_from", "ticketing_to", "section_title")
    split = split_select("(SELECT row_no, text FROM chunks)", "row_no")
    records = f"""
      WITH s AS MATERIALIZED (SELECT s.*, {_lowered('s.clause_text')} AS t, c.chunk_id, c.metadata AS m, s.row_no * 1000000 + s.clause_index AS k FROM ({split}) s JOIN chunks c USING (row_no)),
           x AS ({conditions_select('s', 'k', 'clause_text')}),
           y AS (SELECT s.*, x.eligibility_conditions, x.exceptions, {topic(t)} AS policy_topic, {action(t)} AS action FROM s JOIN x USING (k))
      SELECT chunk_id || ':' || clause_index AS record_id, {', '.join(f'm.{c} AS {c}' for c in carried)}, CAST(NULL AS VARCHAR) AS cabin, CAST(NULL AS VARCHAR) AS pax_type,
             policy_topic, action, CAST(NULL AS VARCHAR) AS applies_to, {penalty_columns('clause_text', t)}, {tax(t)} AS tax_refund_rule, {window(t)} AS time_window,
             {side(t)} AS before_after_departure, eligibility_conditions, exceptions, clause_text, chunk_id, CAST(NULL AS VARCHAR) AS citation_span,
             CASE WHEN policy_topic <> 'other' AND action <> 'unknown' THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END AS confidence, NOT (policy_topic <> 'other' AND action <> 'unknown') AS needs_review,
             CAST(NULL AS VARCHAR) AS notes FROM y"""
    overlay_columns = ("source_id", "document_id", "document_type", "carrier", "supplier", "market", "route_scope", "cabin", "effective_from", "source_filename")

    def or_null(c: str) -> str:
        return f"nullif(regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '')"

    types = ", ".join(map(_q, SOURCE_TYPES))
    by_file = f"""(SELECT * FROM (SELECT lower({or_null('source_filename')}) AS k, {', '.join(f'{or_null(c)} AS {c}' for c in OVERLAY_FIELDS)},
                  row_number() OVER (PARTITION BY lower({or_null('source_filename')}) ORDER BY row_no DESC) AS rn FROM pilot_source_manifest) WHERE rn = 1 AND k IS NOT NULL)"""
    overlay = ", ".join(f"coalesce({f'CASE WHEN m.{c} IN ({types}) THEN m.{c} END' if c == 'document_type' else f'm.{c}'}, c.metadata.{c}) AS {c}" for c in overlay_columns)
    last = lambda name, key, order: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {name}) WHERE rn = 1)"
    latest_labels = last("manual_labels", "record_id", "updated_at DESC NULLS LAST, row_no DESC")
    latest_chunks = last("chunks", "chunk_id", "row_no DESC")
    queue = f"""SELECT c.* FROM policy_clauses c JOIN {latest_chunks} k ON k.chunk_id = c.chunk_id
                WHERE c.source_id IN (SELECT {or_null('source_id')} FROM pilot_source_manifest WHERE {or_null('source_id')} IS NOT NULL)"""
    attributes = ("document_id", "document_type", "carrier", "supplier", "offer_or_circular_id", "effective_from", "effective_to")
    gold = last("policy_clauses", "record_id", "row_no DESC")
    number = lambda c: f"CAST(round_even({c}, 6) AS VARCHAR)"
    listed = lambda c: f"array_to_string({c}, ' | ')"
    fields = {
        "policy_topic": ("g.policy_topic", "p.policy_topic"), "action": ("g.action", "p.action"), "penalty_type": ("g.penalty_type", "p.penalty_type"),
        "penalty_amount": (number("g.penalty_amount"), number("p.penalty_amount")), "penalty_currency": ("g.penalty_currency", "p.penalty_currency"),
        "penalty_percent": (number("g.penalty_percent"), number("p.penalty_percent")), "fare_difference_required": ("CAST(g.fare_difference_required AS VARCHAR)", "CAST(p.fare_difference_required AS VARCHAR)"),
        "time_window": ("g.time_window", "p.time_window"), "before_after_departure": ("g.before_after_departure", "p.before_after_departure"), "tax_refund_rule": ("g.tax_refund_rule", "p.tax_refund_rule"),
        "eligibility_conditions": (listed("g.eligibility_conditions"), "p.eligibility_conditions"), "exceptions": (listed("g.exceptions"), "p.exceptions"),
    }
    accuracy = f"""
      WITH g AS MATERIALIZED (SELECT *, {_lowered('clause_text')} AS t FROM {gold}), x AS ({conditions_select('g', 'row_no', 'clause_text')}),
      p AS (SELECT g.row_no, {topic(t)} AS policy_topic, {action(t)} AS action, {window(t)} AS time_window, {side(t)} AS before_after_departure, {tax(t)} AS tax_refund_rule,
                   x.eligibility_conditions, x.exceptions, {penalty_columns('clause_text', t)} FROM g JOIN x USING (row_no)),
      pairs AS ({' UNION ALL '.join(f"SELECT {_q(f)} AS field, {a} AS gv, {b} AS pv FROM g JOIN p USING (row_no) WHERE g.record_id IS NOT NULL" for f, (a, b) in fields.items())})
      SELECT field, count(*) FILTER (gv = pv) AS correct, count(gv) AS total, count(*) FILTER (gv IS NOT NULL AND pv IS NULL) AS missing_pred_value,
             round(CASE WHEN count(gv) > 0 THEN count(*) FILTER (gv = pv) / count(gv) END, 6) AS accuracy FROM pairs GROUP BY field"""
    first = lambda n: f"coalesce(nullif(first_clause.{n}, ''), meta_{n})"
    cited = f"""{hybrid},
      hits AS (SELECT *, {ranked} AS rank FROM scored QUALIFY rank <= 5),
      ordered AS (SELECT c.*, row_number() OVER (PARTITION BY chunk_id ORDER BY row_no) AS n FROM policy_clauses c WHERE chunk_id IN (SELECT chunk_id FROM hits)),
      own AS (SELECT chunk_id, count(*) AS total, string_agg(clause_text, ' | ' ORDER BY n) FILTER (n <= 2 AND clause_text <> '') AS preview,
                     any_value({{'source_id': source_id, 'document_id': document_id, 'document_type': document_type, 'carrier': carrier}}) FILTER (n = 1) AS first_clause FROM ordered GROUP BY chunk_id),
      cites AS (SELECT CAST(rank AS INTEGER) AS rank, chunk_id, coalesce(nullif({first('source_id')}, ''), 'unknown') AS source_id, coalesce(nullif({first('document_id')}, ''), nullif({first('source_id')}, ''), 'unknown') AS document_id,
                       {first('document_type')} AS document_type, {first('carrier')} AS carrier, CAST(least(coalesce(total, 0), 5) AS INTEGER) AS clauses, coalesce(preview, text, '') AS preview
                FROM hits LEFT JOIN own USING (chunk_id))"""
    text_field = lambda f: or_null(f"json_extract_string(j, '$.{f}')")
    number_field = lambda f: f"CASE WHEN json_type(j, '$.{f}') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(json_extract_string(j, '$.{f}') AS DOUBLE) END"
    list_field = lambda f: _distinct(f"list_filter(list_transform(CASE WHEN json_type(j, '$.{f}') = 'ARRAY' THEN json_extract_string(j, '$.{f}[*]') END, lambda x: {or_null('x')}), lambda x: x IS NOT NULL)")
    objects = rf"""(SELECT row_no, record_id, label_status, updated_at, CAST(payload_json AS JSON) AS j FROM manual_labels
                   WHERE json_valid(payload_json) AND payload_json LIKE '{{%' AND NOT regexp_matches(regexp_replace(payload_json, '"(\\.|[^"\\])*"', '""', 'g'), '(?i)nan|inf|,\s*[}}\]]'))"""
    kept_id = "coalesce(nullif(json_extract_string(j, '$.record_id'), ''), nullif(record_id, ''))"
    label_texts = ("source_id", "document_id", "document_type", "carrier", "supplier", "chunk_id", "policy_topic", "action", "penalty_type", "penalty_currency", "time_window", "before_after_departure", "tax_refund_rule", "clause_text", "notes")
    chunk_key = "sha256(concat_ws('|', coalesce(document_id, ''), coalesce(source, ''), k))"
    counted = f"""SELECT count(*) AS returned, count(l.record_id) AS labeled, count(*) FILTER (lower(l.label_status) = 'skip') AS skipped, count(*) FILTER (l.record_id IS NULL) AS open
                  FROM ({queue}) q LEFT JOIN {latest_labels} l ON l.record_id = q.record_id WHERE q.record_id <> ''"""
    return {
        "label_records": f"""SELECT {kept_id} AS record_id, lower({text_field('label_status')}) AS label_status, {', '.join(f'{text_field(f)} AS {f}' for f in label_texts)},
            {', '.join(f'{number_field(f)} AS {f}' for f in ('penalty_amount', 'penalty_percent'))}, {', '.join(f"nullif(array_to_string({list_field(f)}, ' | '), '') AS {f}" for f in ('eligibility_conditions', 'exceptions'))}
            FROM {objects} WHERE {kept_id} IS NOT NULL""",
        "label_upserts": f"""WITH all_saves AS (SELECT {kept_id} AS record_id, lower({text_field('label_status')}) AS status FROM {objects} WHERE trim({kept_id}) <> ''),
            first AS (SELECT DISTINCT record_id FROM all_saves WHERE status = 'done')
            SELECT 1 AS save, record_id, false AS updated FROM first UNION ALL SELECT DISTINCT 2, record_id, record_id IN (SELECT record_id FROM first) FROM all_saves""",
        "unskipped_labels": f"SELECT record_id, row_no FROM {latest_labels} WHERE coalesce(lower(label_status), '') <> 'skip'",
        "synthetic_guard": f"SELECT count(*) > 0 AND coalesce(bool_and(starts_with(chunk_id, '{SYNTHETIC_PREFIX}')) FILTER (chunk_id <> ''), true) AS synthetic FROM (SELECT chunk_id FROM chunks ORDER BY row_no LIMIT 20)",
        "overall_accuracy": f"SELECT CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(total) AS BIGINT) AS total, round(sum(correct) / sum(total), 6) AS overall_field_accuracy FROM ({accuracy})",
        "compare_states": f"""WITH l AS (SELECT record_id, last(status ORDER BY updated_at NULLS FIRST, row_no) AS status FROM (SELECT {kept_id} AS record_id, json_extract_string(j, '$.label_status') AS status, row_no, updated_at FROM {objects}) WHERE trim(record_id) <> '' GROUP BY record_id),
            g AS (SELECT count(*) AS n, count(*) FILTER (record_id IN (SELECT record_id FROM policy_clauses WHERE trim(record_id) <> '')) AS m FROM l WHERE coalesce(lower(status), '') <> 'skip')
            SELECT 'labels' AS state, 'ok' AS status, 'sqlite' AS backend, n AS gold_records, m AS matched_records FROM g
            UNION ALL SELECT 'only skipped', 'blocked', 'sqlite', NULL, NULL UNION ALL SELECT 'nothing', 'blocked', 'jsonl', NULL, NULL""",
        "document_chunks": f"""SELECT {chunk_key} AS chunk_id, CAST(k * 120 AS INTEGER) AS start_token, CAST(least(k * 120 + 150, n) AS INTEGER) AS end_token, array_to_string(w[k * 120 + 1 : k * 120 + 150], ' ') AS text, document_id, '' AS section_title
            FROM (SELECT document_id, source, w, len(w) AS n, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 150) / 120) AS BIGINT)))) AS k FROM (SELECT document_id, source, {_words('text')} AS w FROM documents) WHERE len(w) > 0)""",
        "knn_filtered": """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) AS DOUBLE[])), 6) AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10""",
        "jsonl_round_trip": "SELECT row_no, record_id, clause_text, penalty_amount, array_to_string(exceptions, ' | ') AS exceptions, needs_review FROM policy_clauses",
        "queue_headers": f"""WITH c AS ({counted}), n AS (SELECT count(*) AS n FROM ({queue}))
            SELECT true AS include_labeled, n AS total_records, returned AS returned_records, labeled AS labeled_records, skipped AS skipped_records, open AS unlabeled_records FROM c, n
            UNION ALL SELECT false, open, open, 0, 0, open FROM c""",
        "clause_split": split,
        "clause_kinds": f"SELECT row_no, {topic(t)} AS policy_topic, {action(t)} AS action FROM ({kinds})",
        "topic_action_counts": f"SELECT policy_topic, action, count(*) AS clauses FROM (SELECT {topic(t)} AS policy_topic, {action(t)} AS action FROM ({kinds})) GROUP BY ALL",
        "penalty_terms": f"SELECT row_no, {penalty_columns('clause_text', t)} FROM ({kinds})",
        "time_signals": f"SELECT row_no, {window(t)} AS time_window, {side(t)} AS before_after_departure FROM ({kinds})",
        "tax_rules": f"SELECT row_no, {tax(t)} AS tax_refund_rule FROM ({kinds})",
        "snippets": conditions_select("policy_clauses", "row_no", "clause_text"),
        "clause_records": records,
        "stub_records": f"""SELECT c.chunk_id || ':' || clause_index AS record_id, metadata.source_id AS source_id, metadata.document_type AS document_type, CAST(NULL AS VARCHAR) AS cabin, CAST(NULL AS VARCHAR) AS pax_type,
            'other' AS policy_topic, 'unknown' AS action, clause_text, CAST(NULL AS DOUBLE) AS confidence, true AS needs_review, {_q(STUB_NOTE)} AS notes FROM ({split}) s JOIN chunks c USING (row_no)""",
        "chunk_windows": f"""SELECT doc_id, CAST(k AS INTEGER) AS window_no, CAST(k * 120 AS INTEGER) AS start_token, CAST(least(k * 120 + 150, n) AS INTEGER) AS end_token, array_to_string(w[k * 120 + 1 : k * 120 + 150], ' ') AS window_text
            FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 150) / 120) AS BIGINT)))) AS k FROM (SELECT doc_id, {_words('text')} AS w FROM documents) WHERE len(w) > 0)""",
        "manifest_overlay": f"SELECT c.row_no, {overlay} FROM chunks c LEFT JOIN {by_file} m ON m.k = lower(c.metadata.source_filename)",
        "manifest_sources": f"SELECT DISTINCT {or_null('source_id')} AS source_id FROM pilot_source_manifest WHERE {or_null('source_id')} IS NOT NULL",
        "term_statistics": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
        "document_lengths": f"SELECT doc_id, len({_tokens('text')}) AS doc_length FROM documents",
        "corpus_statistics": f"SELECT count(*) AS n_docs, round(avg(len({_tokens('text')})), 6) AS avgdl FROM documents",
        "hybrid_scores": f"{hybrid} SELECT chunk_id, {_ROUNDED} FROM scored",
        "hybrid_topk": f"{hybrid} SELECT CAST({ranked} AS INTEGER) AS rank, chunk_id, {_ROUNDED} FROM scored QUALIFY rank <= 5",
        "hybrid_filtered": f"""{hybrid} SELECT CAST({ranked} AS INTEGER) AS rank, chunk_id, {_ROUNDED} FROM scored
            WHERE lower(meta_document_type) = lower({_q(document_type)}) OR chunk_id IN (SELECT chunk_id FROM policy_clauses WHERE lower(document_type) = lower({_q(document_type)})) QUALIFY rank <= 20""",
        "keyword_topk": f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL), lens AS (SELECT doc_id, len({_tokens('text')}) AS dl FROM documents),
            stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), qt AS (SELECT term, count(*) AS qn FROM (SELECT unnest({_tokens(_q(question))}) AS term) GROUP BY term)
            SELECT doc_id, round(sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS bm25
            FROM tf JOIN qt USING (term) JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN stats GROUP BY doc_id ORDER BY bm25 DESC, doc_id LIMIT 10""",
        "citation_list": f"{cited} SELECT * FROM cites",
        "answer_text": f"{cited} SELECT {_q(question)} AS query, string_agg(rank || '. ' || preview, chr(10) ORDER BY rank) AS answer, CAST(count(*) AS INTEGER) AS hits, 'retrieval_only' AS mode FROM cites",
        "source_summary": f"""SELECT coalesce(nullif(source_id, ''), 'unknown') AS source_id, {', '.join(f"arg_min({{'v': {a}}}, row_no).v AS {a}" for a in attributes)}, count(*) AS record_count FROM policy_clauses GROUP BY 1""",
        "source_totals": """SELECT count(*) AS total_records, least(50, count(DISTINCT coalesce(nullif(source_id, ''), 'unknown'))) AS total_sources FROM policy_clauses WHERE lower(coalesce(document_type, 'none')) = 'circular'""",
        "latest_labels": f"SELECT record_id, row_no, lower(label_status) AS label_status FROM {latest_labels}",
        "labeling_queue": f"""SELECT record_id, source_id, chunk_id, clause_text, policy_topic FROM ({queue} AND c.record_id NOT IN (SELECT record_id FROM manual_labels WHERE record_id IS NOT NULL))
            ORDER BY coalesce(source_id, 'None'), coalesce(chunk_id, 'None'), coalesce(record_id, 'None'), clause_text LIMIT 50""",
        "queue_flag_counts": f"""SELECT count(*) AS returned_records, count(l.record_id) AS labeled_records, count(*) FILTER (lower(l.label_status) = 'skip') AS skipped_records, count(*) FILTER (l.record_id IS NULL) AS unlabeled_records
            FROM ({queue}) q LEFT JOIN {latest_labels} l ON l.record_id = q.record_id WHERE q.record_id <> ''""",
        "field_accuracy": accuracy,
        "record_overlap": """WITH g AS (SELECT DISTINCT record_id FROM manual_labels WHERE record_id IS NOT NULL), p AS (SELECT DISTINCT record_id FROM policy_clauses WHERE record_id IS NOT NULL),
            b AS (SELECT g.record_id AS a, p.record_id AS b FROM g FULL OUTER JOIN p ON g.record_id = p.record_id)
            SELECT count(a) AS gold_records, count(b) AS pred_records, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched_records, count(*) FILTER (b IS NULL) AS missing_predictions_for_gold_records, count(*) FILTER (a IS NULL) AS extra_prediction_records FROM b""",
        "knn_cosine": """SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0
            QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) DESC, e.vec_id) <= 10""",
        "html_text": "SELECT row_no, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) AS page_text FROM chunks WHERE text IS NOT NULL",
    }
