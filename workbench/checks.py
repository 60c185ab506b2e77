"""Check SQL for the registered queries, run by another engine on the same tables."""

from __future__ import annotations

from fieldloom.functions.text import RESERVED_WORDS
from workbench.roles import TABLES, role_sql

CHECKS: dict[str, str] = {}

PAGE = 1000
# The platform list of the test tables: NATION_0 to NATION_24.
PLATFORM_NAMES = [(i, f"NATION_{i}") for i in range(25)]

# The blanks of the header rules, in this engine's notation.
BLANKS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def tokens(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '[{BLANKS}_\\-./,;:]+'), lambda x: x <> '')"


def tidy(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '_+', '_', 'g'), '_')"


def standardized(src: str, id_col: str, header: str, out: str, rules: bool = True) -> str:
    """WITH entries ending in `out`(id, header, std)."""
    lookup = "coalesce(dict[t], t)" if rules else "t"
    dictionary = ", (SELECT map(list(pattern), list(replacement)) AS dict FROM active_rules)" if rules else ""
    reserved = ", ".join(f"'{w}'" for w in RESERVED_WORDS)
    stem = tidy(
        f"regexp_replace(regexp_replace(lower(regexp_replace(m, '\\([^)]+\\)', '', 'g')), '[{BLANKS}\\-./,;:]+', '_', 'g'), '[^a-z0-9_]', '', 'g')"
        " || '_' || regexp_replace(lower(array_to_string(regexp_extract_all(m, '\\(([^)]+)\\)', 1), '_')), '[^a-z0-9]', '_', 'g')"
    )
    return f"""
{out}_m AS (SELECT {id_col} AS id, {header} AS header,
   replace(regexp_replace(coalesce({header}, ''), '(?i)#[{BLANKS}]*of\\b', 'count_of', 'g'), '%', '_pct') AS m FROM {src}),
{out}_s AS (SELECT id, header, {stem} AS s FROM {out}_m),
{out}_e AS (SELECT id, header, {tidy(f"array_to_string(list_transform(string_split(s, '_'), lambda t: {lookup}), '_')")} AS s FROM {out}_s{dictionary}),
{out}_n AS (SELECT id, header, rtrim(substr(CASE WHEN regexp_matches(s, '^[0-9]') THEN 'n_' || s ELSE s END, 1, 30), '_') AS s FROM {out}_e),
{out} AS (SELECT id, header, CASE WHEN s IN ({reserved}) THEN s || '_field' WHEN s = '' THEN substr(replace(lower(header), ' ', '_'), 1, 30)
   ELSE s END AS std FROM {out}_n)"""


ACTIVE_RULES = """active_rules AS (SELECT pattern, max_by(replacement, rule_id) AS replacement FROM rules
  WHERE rule_type = 'abbreviation' AND lower(CAST(is_active AS VARCHAR)) = 'true' GROUP BY pattern)"""


def bm25(docs: str, queries: str, p: str, k: int = 5) -> str:
    """WITH entries from `docs`(doc_id, txt) and `queries`(qid, txt) ending in {p}hits(qid, doc_id, score, rank)."""
    return f"""
{p}tok AS (SELECT doc_id, {tokens('txt')} AS ts FROM ({docs})),
{p}st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM {p}tok),
{p}tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, any_value(dl)::DOUBLE AS dl
          FROM (SELECT doc_id, unnest(ts) AS term, len(ts) AS dl FROM {p}tok) GROUP BY doc_id, term),
{p}df AS (SELECT term, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM {p}tf, {p}st GROUP BY term),
{p}idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM {p}df) ELSE raw END AS idf FROM {p}df),
{p}ask AS (SELECT qid, txt FROM ({queries})),
{p}one AS (SELECT txt, row_number() OVER () AS q FROM (SELECT DISTINCT txt FROM {p}ask)),
{p}qt AS (SELECT q, term, count(*)::DOUBLE AS qtf FROM (SELECT q, unnest({tokens('txt')}) AS term FROM {p}one) GROUP BY q, term),
{p}sc AS (SELECT q, doc_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS raw
          FROM {p}qt JOIN {p}idf USING (term) JOIN {p}tf USING (term), {p}st GROUP BY q, doc_id),
{p}top AS (SELECT q, doc_id, round(raw, 4) AS score, row_number() OVER (PARTITION BY q ORDER BY round(raw, 9) DESC, doc_id) AS rank
           FROM {p}sc WHERE round(raw, 9) > 0 QUALIFY rank <= {k}),
{p}hits AS (SELECT qid, doc_id, score, rank FROM {p}ask JOIN {p}one USING (txt) JOIN {p}top USING (q))"""


def stable_id(*exprs: str) -> str:
    """The id of a row by its key columns; null counts as a character of its own."""
    parts = ", ".join(f"coalesce(CAST({e} AS VARCHAR), chr(0))" for e in exprs)
    return f"substr(sha256(concat_ws(chr(1), {parts})), 1, 32)"


def cells(expr: str) -> str:
    return ", ".join(f"coalesce(max({expr}) FILTER (platform_id = {i}), '') AS \"{n}\"" for i, n in PLATFORM_NAMES)


def check(name: str, sql: str) -> None:
    CHECKS[name] = sql.strip()


# ---- text ----

check("standardize_headers", role_sql("headers", "rules") + f""",
{ACTIVE_RULES}, {standardized('headers', 'header_id', 'header', 'named')}
SELECT id AS header_id, std AS standardized FROM named""")

check("active_abbreviations", role_sql("rules") + f", {ACTIVE_RULES} SELECT pattern, replacement FROM active_rules")

check("tokenize_terms", f"""
WITH t AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents)
SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM t GROUP BY term""")

# ---- intake and name match ----

BY_NAME = """by_name AS (SELECT canonical_name, max(canonical_id) AS canonical_id, min(canonical_id) AS place
  FROM canonical_fields GROUP BY canonical_name),
near AS (SELECT replace(canonical_name, '_', '') AS squashed, min_by(canonical_name, place) AS canonical_name,
  min_by(canonical_id, place) AS canonical_id FROM by_name GROUP BY 1)"""

check("fast_match", role_sql("intake_columns", "canonical_fields", "rules") + f""",
{ACTIVE_RULES}, {standardized('intake_columns', 'column_id', 'column_name', 'named')}, {BY_NAME},
m AS (SELECT id, header, std, CASE WHEN e.canonical_id IS NOT NULL THEN 'exact' WHEN n.canonical_id IS NOT NULL THEN 'near' END AS kind,
        coalesce(e.canonical_id, n.canonical_id) AS cid, coalesce(e.canonical_name, n.canonical_name) AS cname
      FROM named LEFT JOIN by_name e ON e.canonical_name = std LEFT JOIN near n ON n.squashed = replace(std, '_', ''))
SELECT id AS column_id, header AS column_name, std AS standardized, kind AS match_kind, cid AS canonical_id, cname AS canonical_name,
  CAST(CASE kind WHEN 'exact' THEN 95 WHEN 'near' THEN 90 END AS BIGINT) AS confidence,
  CASE kind WHEN 'exact' THEN 'Deterministic match: ''' || header || ''' standardizes to ''' || std || ''' which exactly matches canonical field.'
            WHEN 'near' THEN 'Near-exact match: ''' || header || ''' standardizes to ''' || std || ''', matches ''' || cname || ''' after normalization.'
  END AS rationale,
  CASE WHEN kind IS NOT NULL THEN 'high' END AS band
FROM m""")

_PLAIN = role_sql("intake_columns", "canonical_fields") + f", {standardized('intake_columns', 'column_id', 'column_name', 'named', rules=False)}, {BY_NAME}"
check("exact_matches", _PLAIN + """
SELECT id AS column_id, canonical_id, canonical_name FROM named JOIN by_name ON canonical_name = std""")
check("near_matches", _PLAIN + """
SELECT id AS column_id, canonical_id, canonical_name FROM named JOIN near ON squashed = replace(std, '_', '')""")

# Fixed: how the two engines name the types of the given tables.
_TYPE_NAMES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "FLOAT": "float", "DATE": "date",
               "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "FLOAT[]": "array<float>", "DOUBLE[]": "array<double>"}
_TYPE_CASE = "CASE column_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPE_NAMES.items()) + " ELSE column_type END"
check("discover_columns", " UNION ALL ".join(
    f"""SELECT 'given' AS platform_id, '{t}' AS source_table, column_name, {_TYPE_CASE} AS data_type, rows, nulls, distinct_values
FROM (DESCRIBE {t}) JOIN (SELECT column_name, count(*) AS rows, count(*) - count(v) AS nulls, count(DISTINCT v) AS distinct_values
  FROM (SELECT COLUMNS(*)::VARCHAR FROM {t}) UNPIVOT INCLUDE NULLS (v FOR column_name IN (COLUMNS(*))) GROUP BY column_name) USING (column_name)"""
    for t in TABLES))

check("discover_new_columns", role_sql("intake_columns", "source_columns", "intake_approved") + """
SELECT DISTINCT platform_id, source_table, column_name, data_type
FROM (SELECT * EXCLUDE (column_id) FROM intake_columns UNION ALL SELECT * EXCLUDE (column_id) FROM source_columns) d
WHERE NOT EXISTS (SELECT 1 FROM intake_columns c JOIN intake_approved a USING (column_id)
  WHERE c.platform_id = d.platform_id AND c.source_table = d.source_table AND c.column_name = d.column_name)""")

check("new_columns_filtered", role_sql("intake_columns", "source_columns", "repeated_columns") + """,
known AS (SELECT platform_id, source_table, column_name FROM source_columns UNION ALL SELECT platform_id, source_table, column_name FROM intake_columns WHERE source_table LIKE '%SMALL')
SELECT DISTINCT platform_id, source_table, column_name, data_type
FROM (SELECT * EXCLUDE (column_id) FROM intake_columns UNION ALL SELECT * EXCLUDE (column_id) FROM repeated_columns) d
WHERE NOT EXISTS (SELECT 1 FROM known c WHERE c.platform_id = d.platform_id AND c.source_table = d.source_table AND c.column_name = d.column_name)""")

UNMAPPED = """pending AS (SELECT * FROM intake_columns c
  WHERE NOT EXISTS (SELECT 1 FROM intake_approved a WHERE a.column_id = c.column_id)
    AND NOT EXISTS (SELECT 1 FROM intake_proposals p WHERE p.column_id = c.column_id AND p.status IN ('pending_review', 'approved')))"""
INTAKE = role_sql("intake_columns", "intake_approved", "intake_proposals", "canonical_fields", "rules", "platforms", "responses")

check("unmapped_columns", INTAKE + f", {UNMAPPED} SELECT column_id, platform_id, column_name FROM pending")
check("mapped_columns", INTAKE + """
SELECT column_id, column_name FROM intake_columns WHERE column_id IN (SELECT column_id FROM intake_approved)""")

# ---- retrieval ----

check("bm25_documents", "WITH " + bm25(
    "SELECT doc_id, text AS txt FROM documents", "SELECT item_id AS qid, text AS txt FROM benchmark", "b_"
) + " SELECT qid AS item_id, doc_id, score, rank FROM b_hits")

CHECKS["bm25_segments"] = CHECKS["bm25_documents"]

FIELD_DOCS = "SELECT canonical_id AS doc_id, concat_ws(' ', canonical_name, business_definition, domain_category) AS txt FROM canonical_fields"

check("bm25_fields", INTAKE + f""",
{ACTIVE_RULES}, {standardized('intake_columns', 'column_id', 'column_name', 'named')},
{bm25(FIELD_DOCS, "SELECT id AS qid, header || ' ' || std AS txt FROM named", "f_")}
SELECT qid AS column_id, doc_id AS canonical_id, canonical_name, score, rank FROM f_hits JOIN canonical_fields ON canonical_id = doc_id""")

check("bm25_approved", role_sql("source_columns", "approved_mappings", "canonical_fields", "rules") + f""",
{ACTIVE_RULES}, {standardized('source_columns', 'column_id', 'column_name', 'named')},
docs AS (SELECT mapping_id, column_name, platform_id, canonical_name, concat_ws(' ', column_name, canonical_name, business_definition) AS txt
         FROM approved_mappings JOIN source_columns USING (column_id) LEFT JOIN canonical_fields USING (canonical_id)),
{bm25("SELECT mapping_id AS doc_id, txt FROM docs", "SELECT id AS qid, header || ' ' || std AS txt FROM named", "a_")}
SELECT qid AS asked_id, mapping_id, column_name, CAST(platform_id AS VARCHAR) AS platform_id, canonical_name, score, rank
FROM a_hits JOIN docs ON mapping_id = doc_id""")

LINKS = role_sql(
    "source_columns", "approved_mappings", "canonical_fields", "mapping_proposals", "platforms", "decisions"
) + """, links AS (SELECT a.*, s.platform_id, s.column_name, s.source_table FROM approved_mappings a JOIN source_columns s USING (column_id)),
fields AS (SELECT * FROM canonical_fields WHERE coalesce(is_active, true))"""

# The last row in the column table's order stands for a repeated id.
_LAST = """(SELECT * FROM repeated_columns
  QUALIFY row_number() OVER (PARTITION BY column_id ORDER BY platform_id DESC, source_table DESC, column_name DESC) = 1)"""
BUSY = role_sql("repeated_columns", "busy_mappings", "approved_mappings", "canonical_fields", "platforms") + f""",
links AS (SELECT a.*, s.platform_id, s.column_name, s.source_table FROM busy_mappings a JOIN {_LAST} s USING (column_id)),
fields AS (SELECT * FROM canonical_fields WHERE coalesce(is_active, true))"""

check("repeated_documents", BUSY + f"""
SELECT mapping_id AS doc_id, column_id, CAST(platform_id AS VARCHAR) AS platform_id, column_name, source_table, canonical_id,
  coalesce(canonical_name, '') AS canonical_name
FROM approved_mappings JOIN {_LAST} s USING (column_id) LEFT JOIN canonical_fields USING (canonical_id)""")
check("busy_context", BUSY + f""",
r AS (SELECT canonical_id, concat_ws('|', platform_id, column_name, source_table) AS line,
        row_number() OVER (PARTITION BY canonical_id ORDER BY mapping_id) AS n
      FROM links WHERE canonical_id IN (SELECT canonical_id FROM canonical_fields))
SELECT canonical_id, (n - 1) // {PAGE} AS page, string_agg(line, '; ' ORDER BY n) AS context FROM r GROUP BY 1, 2""")

check("cross_platform_context", LINKS + f""",
r AS (SELECT canonical_id, concat_ws('|', platform_id, column_name, source_table) AS line,
        row_number() OVER (PARTITION BY canonical_id ORDER BY mapping_id) AS n
      FROM links WHERE canonical_id IN (SELECT suggested_canonical_id FROM mapping_proposals))
SELECT canonical_id, (n - 1) // {PAGE} AS page, string_agg(line, '; ' ORDER BY n) AS context FROM r GROUP BY 1, 2""")

RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY canonical_id, platform_id ORDER BY approved_at DESC, mapping_id) AS n FROM links)"""
LISTS = f"""{RANKED},
lists AS (SELECT canonical_id, platform_id, (n - 1) // {PAGE} AS page, string_agg(column_name, ', ' ORDER BY n) AS names FROM ranked GROUP BY 1, 2, 3)"""

check("cross_platform_names", LINKS + f""", {LISTS}
SELECT canonical_id, page, CAST(platform_id AS VARCHAR) AS platform, names FROM lists""")

def retrieved(columns: str, mappings: str, source: str, rules: bool = True) -> str:
    """WITH entries up to `shown`: the distinct headers of `columns`, both searches, and the fields whose context is shown."""
    return f""",
heads AS (SELECT DISTINCT column_name AS header FROM {columns}),
{standardized('heads', 'header', 'header', 'named', rules)},
docs AS (SELECT mapping_id, column_name, platform_id, canonical_id, canonical_name, concat_ws(' ', column_name, canonical_name, business_definition) AS txt
         FROM {mappings} JOIN {source} USING (column_id) LEFT JOIN canonical_fields USING (canonical_id)),
{bm25("SELECT mapping_id AS doc_id, txt FROM docs", "SELECT id AS qid, header || ' ' || std AS txt FROM named", "a_")},
{bm25(FIELD_DOCS, "SELECT id AS qid, header || ' ' || std AS txt FROM named", "f_")},
both_lists AS (SELECT qid, canonical_id, canonical_name, 1 AS lst, rank FROM a_hits JOIN docs ON mapping_id = doc_id WHERE rank <= 3
          UNION ALL SELECT qid, canonical_id, canonical_name, 2, rank FROM f_hits JOIN canonical_fields ON canonical_id = doc_id WHERE rank <= 3),
firsts AS (SELECT qid, canonical_id, min_by(canonical_name, lst * 10 + rank) AS canonical_name, min(lst * 10 + rank) AS spot FROM both_lists GROUP BY 1, 2),
merged AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY spot) AS place FROM firsts),
ctx AS (SELECT canonical_id, platform_id, column_name, row_number() OVER (PARTITION BY canonical_id ORDER BY mapping_id) AS n FROM docs),
sizes AS (SELECT canonical_id, count(*) AS columns, CAST(sum(length(platform_id || column_name) + 11) AS BIGINT) AS chars FROM ctx GROUP BY 1),
shown AS (SELECT qid AS header, canonical_name, max_by(canonical_id, place) AS canonical_id, min(place) AS place
          FROM merged JOIN sizes USING (canonical_id) GROUP BY 1, 2)"""


RETRIEVED = f", {ACTIVE_RULES}" + retrieved("intake_columns", "intake_approved", "intake_columns")

check("retrieval_context", INTAKE + RETRIEVED + """
SELECT header, canonical_id, canonical_name, place, columns, chars FROM shown JOIN sizes USING (canonical_id)""")

_HEAD = """'You are a data standardization expert at a financial services firm.' || chr(10) || chr(10) ||
 'TASK: Given a source column, recommend the best canonical field.' || chr(10) || 'Use all the context below to make your decision.' || chr(10) || chr(10) ||
 'PLATFORM: ' || platform_name || chr(10) || 'SOURCE COLUMN: "' || column_name || '"' || chr(10) || 'RULE-STANDARDIZED: "' || std || '"'"""


def _tail() -> str:
    from fieldloom.functions.prompt import INSTRUCTIONS

    return "'" + INSTRUCTIONS.replace("'", "''") + "'"


_HITS = """sim AS (SELECT qid, chr(10) || chr(10) || 'SIMILAR APPROVED MAPPINGS (from other platforms):' || string_agg(chr(10) || '  ' || rank || '. "' || column_name ||
          '" (' || platform_id || ') -> canonical: ' || canonical_name || ' [score: ' || printf('%.1f', score) || ']', '' ORDER BY rank) AS t
        FROM a_hits JOIN docs ON mapping_id = doc_id GROUP BY qid),
cand AS (SELECT qid, chr(10) || chr(10) || 'CANDIDATE CANONICAL FIELDS:' || string_agg(chr(10) || '  ' || rank || '. ' || canonical_name || ' (' || data_type || ', ' ||
          domain_category || ') - "' || business_definition || '" [score: ' || printf('%.1f', score) || ']', '' ORDER BY rank) AS t
        FROM f_hits JOIN canonical_fields ON canonical_id = doc_id GROUP BY qid),"""
INTAKE_PROMPTS = INTAKE + RETRIEVED + f""", {UNMAPPED},
rule_text AS (SELECT chr(10) || chr(10) || 'ACTIVE ABBREVIATION RULES:' || string_agg(chr(10) || '  ' || pattern || ' -> ' || replacement, '' ORDER BY pattern) AS t FROM active_rules),
{_HITS}
block AS (SELECT canonical_id, string_agg(chr(10) || '    - ' || platform_id || ': "' || column_name || '"', '' ORDER BY n) AS t FROM ctx GROUP BY 1),
con AS (SELECT header AS qid, chr(10) || chr(10) || 'CROSS-PLATFORM CONTEXT FOR TOP CANDIDATES:' || string_agg(chr(10) || '  ' || canonical_name || ':' || t, '' ORDER BY place) AS t
        FROM shown JOIN block USING (canonical_id) GROUP BY 1),
rows_ AS (SELECT p.column_id, p.column_name, coalesce(pl.name, CAST(p.platform_id AS VARCHAR)) AS platform_name, n.std
          FROM pending p JOIN named n ON n.header = p.column_name LEFT JOIN platforms pl ON pl.platform_id = p.platform_id),
prompts AS (SELECT column_id, platform_name, std AS standardized, 0 AS part,
  {_HEAD} || coalesce((SELECT t FROM rule_text), '') || coalesce(sim.t, '') || coalesce(cand.t, '') || coalesce(con.t, '') || chr(10) || {_tail()} AS prompt
FROM rows_ LEFT JOIN sim ON sim.qid = column_name LEFT JOIN cand ON cand.qid = column_name LEFT JOIN con ON con.qid = column_name)"""
check("build_prompts", INTAKE_PROMPTS + " SELECT * FROM prompts")

# Lines start in pieces of 256 characters of their field, and pieces in parts of 4,096 characters of their prompt.
check("busy_prompts", BUSY + ", " + role_sql("class_columns")[5:] + retrieved("class_columns", "busy_mappings", _LAST, False) + f""",
{_HITS}
lines AS (SELECT canonical_id, n, chr(10) || '    - ' || platform_id || ': "' || column_name || '"' AS line,
            CAST(sum(length(platform_id || column_name) + 11) OVER (PARTITION BY canonical_id ORDER BY n) AS BIGINT) - length(platform_id || column_name) - 11 AS start FROM ctx),
pieced AS (SELECT *, min(start) OVER (PARTITION BY canonical_id, start // 256) AS piece FROM lines),
fields_ AS (SELECT *, coalesce(CAST(sum(length(canonical_name) + 4 + chars) OVER (PARTITION BY header ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS begins
            FROM shown JOIN sizes USING (canonical_id)),
bits AS (SELECT header, begins AS start, 0 AS n, chr(10) || '  ' || canonical_name || ':' AS t FROM fields_
   UNION ALL SELECT header, begins + length(canonical_name) + 4 + piece, n, line FROM fields_ JOIN pieced USING (canonical_id)
   UNION ALL SELECT header, 0, -1, CASE WHEN EXISTS (SELECT 1 FROM shown s WHERE s.header = h.header) THEN chr(10) || chr(10) || 'CROSS-PLATFORM CONTEXT FOR TOP CANDIDATES:' ELSE '' END FROM heads h
   UNION ALL SELECT header, coalesce((SELECT sum(length(canonical_name) + 4 + chars) FROM fields_ f WHERE f.header = h.header), 0), 0, chr(10) || {_tail()} FROM heads h),
parts AS (SELECT header, CAST(start // 4096 AS BIGINT) AS part, string_agg(t, '' ORDER BY start, n) AS body FROM bits GROUP BY 1, 2),
rows_ AS (SELECT p.column_id, p.column_name, coalesce(pl.name, CAST(p.platform_id AS VARCHAR)) AS platform_name, n.std
          FROM class_columns p JOIN named n ON n.header = p.column_name LEFT JOIN platforms pl ON pl.platform_id = p.platform_id),
pages AS (SELECT qid, CAST(ceil(max(columns) / {PAGE}.0) AS BIGINT) AS n FROM merged JOIN sizes USING (canonical_id) GROUP BY 1)
SELECT column_id, platform_name, std AS standardized, coalesce(pages.n, 0) AS context_pages, part,
  CASE WHEN part = 0 THEN {_HEAD} || coalesce(sim.t, '') || coalesce(cand.t, '') ELSE '' END || body AS prompt
FROM rows_ JOIN parts ON header = column_name LEFT JOIN sim ON sim.qid = column_name LEFT JOIN cand ON cand.qid = column_name LEFT JOIN pages ON pages.qid = column_name""")

# ---- answers and proposals ----

PARSED = """
spans AS (SELECT column_id, raw_text, regexp_extract(raw_text, '(?s)\\{.*\\}') AS j FROM responses),
docs_ AS (SELECT column_id, raw_text, CASE WHEN j <> '' AND json_valid(j) THEN j::JSON END AS d FROM spans),
parsed AS (SELECT column_id, d IS NULL AS failed, d ->> '$.recommended_canonical_id' AS rid, d ->> '$.recommended_canonical_name' AS rname,
  CASE WHEN d IS NULL THEN 0 ELSE coalesce(CAST(d ->> '$.confidence' AS BIGINT), 0) END AS conf,
  coalesce(d ->> '$.rationale', '') AS rationale, coalesce(d ->> '$.data_type', '') AS data_type,
  CASE WHEN json_type(d, '$.alternatives') = 'ARRAY' THEN json_array_length(d, '$.alternatives') ELSE 0 END AS alts,
  d ->> '$.alternatives[0].reason' AS reason FROM docs_)"""

check("parse_answers", role_sql("responses") + f""", {PARSED}
SELECT column_id, rid AS recommended_canonical_id, rname AS recommended_canonical_name, conf AS confidence, rationale, data_type,
  CAST(alts AS BIGINT) AS alternatives, reason AS first_reason, failed FROM parsed""")

MATCHED = f""", {ACTIVE_RULES}, {UNMAPPED}, {standardized('pending', 'column_id', 'column_name', 'named')}, {BY_NAME}, {PARSED},
fast AS (SELECT id AS column_id, header, std, CASE WHEN e.canonical_id IS NOT NULL THEN 95 WHEN n.canonical_id IS NOT NULL THEN 90 END AS conf,
    coalesce(e.canonical_id, n.canonical_id) AS cid, coalesce(e.canonical_name, n.canonical_name) AS cname
  FROM named LEFT JOIN by_name e ON e.canonical_name = std LEFT JOIN near n ON n.squashed = replace(std, '_', '')),
by_model AS (SELECT p.column_id, q.column_name AS header, CAST(rid AS BIGINT) AS cid, rname AS cname, conf, rationale, failed
  FROM parsed p JOIN pending q USING (column_id)),
by_fast AS (SELECT column_id, header, cid, cname, CAST(conf AS BIGINT) AS conf,
    CASE conf WHEN 95 THEN 'Deterministic match: ''' || header || ''' standardizes to ''' || std || ''' which exactly matches canonical field.'
      ELSE 'Near-exact match: ''' || header || ''' standardizes to ''' || std || ''', matches ''' || cname || ''' after normalization.' END AS rationale
  FROM fast WHERE conf IS NOT NULL),
run_rows AS (SELECT column_id, header, cid, cname, conf, rationale, 'deterministic' AS model FROM by_fast
  UNION ALL SELECT column_id, header, cid, cname, conf, rationale, 'model' FROM by_model
  WHERE NOT failed AND column_id NOT IN (SELECT column_id FROM by_fast))"""
_PROPOSAL = f"""{stable_id("'b1'", 'column_id')} AS proposal_id, column_id, cid AS suggested_canonical_id, cname AS suggested_canonical_name, CAST(conf AS DOUBLE) AS confidence,
  CASE WHEN conf >= 85 THEN 'high' WHEN conf >= 60 THEN 'medium' ELSE 'low' END AS confidence_level,
  substr(coalesce(rationale, ''), 1, 500) AS reasoning"""

check("batch_proposals", INTAKE + MATCHED + f"""
SELECT {_PROPOSAL}, model AS agent_model, 'b1' AS batch_id, 'pending_review' AS status FROM run_rows""")
check("batch_proposals_with_errors", INTAKE + MATCHED + f"""
SELECT {_PROPOSAL}, 'model' AS agent_model, 'b1' AS batch_id, 'pending_review' AS status FROM by_model""")
check("model_proposals", INTAKE_PROMPTS + """
SELECT column_id, CAST(length(prompt) % 101 AS DOUBLE) AS confidence,
  CASE WHEN length(prompt) % 101 >= 85 THEN 'high' WHEN length(prompt) % 101 >= 60 THEN 'medium' ELSE 'low' END AS confidence_level,
  substr(replace(column_name, '"', chr(39)), 1, 500) AS reasoning, 'model' AS agent_model, 'pending_review' AS status
FROM prompts JOIN intake_columns USING (column_id)""")
check("batch_audit", INTAKE + MATCHED + """
SELECT 'proposal' AS entity_type, 'created' AS action, 'agent_batch' AS actor,
  '{"column":' || to_json(header) || ',"confidence":' || conf || '}' AS details FROM run_rows""")

# ---- similar names ----

NEW_NAMES = """new_fields AS (SELECT canonical_name || '_' || lower(domain_category) AS name, data_type, business_definition, domain_category FROM canonical_fields)"""

check("name_overlap", role_sql("canonical_fields") + f""", {NEW_NAMES},
a AS (SELECT DISTINCT name, list_distinct(string_split(lower(name), '_')) AS ts FROM new_fields),
b AS (SELECT DISTINCT canonical_name, list_distinct(string_split(lower(canonical_name), '_')) AS ts FROM canonical_fields),
p AS (SELECT name, canonical_name, len(list_intersect(a.ts, b.ts))::DOUBLE / greatest(len(a.ts), len(b.ts)) AS o,
  least(length(name), length(canonical_name))::DOUBLE / (length(name) + length(canonical_name)) AS l FROM a, b)
SELECT name, canonical_name, round(o, 6) AS overlap FROM p WHERE o > 0 AND o * 0.5::DOUBLE + l >= 0.6::DOUBLE - 1e-9""")

# The longest block that two texts share, earliest in the first, then in the second; what lies before and after it in both is
# searched again. Names are shorter than 200 characters, from which on the ratio would leave out frequent ones.
_BLOCK = """list_filter(flatten(list_transform(range(length({x}), 0, -1), lambda k: list_transform(range(1, length({x}) - k + 2),
  lambda i: {{'k': k, 'i': i, 'j': strpos({y}, substr({x}, i, k))}}))), lambda m: m.j > 0)[1]"""
SIMILAR = role_sql("canonical_fields").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {NEW_NAMES},
a AS (SELECT DISTINCT name, lower(name) AS low, list_distinct(string_split(lower(name), '_')) AS ts FROM new_fields WHERE name <> ''),
b AS (SELECT canonical_name, lower(canonical_name) AS low, list_distinct(string_split(lower(canonical_name), '_')) AS ts, count(*) AS fields
  FROM canonical_fields WHERE canonical_name <> '' GROUP BY canonical_name),
pairs AS (SELECT name, canonical_name, fields, a.low AS x, b.low AS y, len(list_intersect(a.ts, b.ts))::DOUBLE / greatest(len(a.ts), len(b.ts)) AS o
  FROM a, b WHERE len(list_intersect(a.ts, b.ts)) > 0),
blocks AS (
  SELECT name, canonical_name, x, y, {_BLOCK.format(x='x', y='y')} AS m FROM pairs
  UNION ALL
  SELECT name, canonical_name, x, y, {_BLOCK.format(x='x', y='y')}
  FROM (SELECT name, canonical_name, unnest([substr(x, 1, m.i - 1), substr(x, m.i + m.k)]) AS x, unnest([substr(y, 1, m.j - 1), substr(y, m.j + m.k)]) AS y
        FROM blocks WHERE m IS NOT NULL)
  WHERE x <> '' AND y <> ''),
ratios AS (SELECT name, canonical_name, coalesce(sum(m.k), 0) AS k FROM blocks GROUP BY 1, 2),
scores AS (SELECT name, canonical_name, fields, o * 0.5::DOUBLE + 2.0::DOUBLE * k / (length(x) + length(y)) * 0.5::DOUBLE AS s FROM pairs JOIN ratios USING (name, canonical_name)),
similar_ AS (SELECT name, canonical_name, CAST(printf('%.2f', s) AS DOUBLE) AS score, fields FROM scores WHERE s >= 0.6::DOUBLE)"""

check("similar_names", SIMILAR + " SELECT * FROM similar_")
check("register_fields_warnings", SIMILAR + """
SELECT name AS new_name, canonical_name, score, fields, row_number() OVER (PARTITION BY name ORDER BY score DESC, canonical_name) AS rank
FROM similar_ QUALIFY rank <= 5""")

check("register_fields", role_sql("canonical_fields") + f""", {NEW_NAMES}
SELECT {stable_id('name', 'data_type', 'business_definition', 'domain_category', 'row_number() OVER (PARTITION BY name, data_type, business_definition, domain_category)')} AS canonical_id,
  name AS canonical_name, data_type, business_definition, domain_category, true AS is_active, 'steward' AS created_by FROM new_fields""")

check("register_rules", """
WITH n AS (SELECT lower(p_brand) AS pattern, lower(p_type) AS replacement, p_name AS description FROM part),
c AS (SELECT pattern, replacement, count(*) AS k FROM n GROUP BY 1, 2)
SELECT """ + stable_id("'abbreviation'", "pattern", "replacement", "description", "row_number() OVER (PARTITION BY pattern, replacement, description)") + """ AS rule_id,
  'abbreviation' AS rule_type, pattern, replacement, description, true AS is_active,
  '{"pattern":"' || pattern || '","replacement":"' || replacement || '"}' AS details, k AS audit_rows
FROM n JOIN c USING (pattern, replacement)""")

# ---- review ----

_PIVOT = LISTS + f""", cells AS (SELECT canonical_id, page, {cells('names')} FROM lists GROUP BY 1, 2)"""
_CELL_COLUMNS = ", ".join(f"coalesce(c.\"{n}\", '') AS \"{n}\"" for _, n in PLATFORM_NAMES)
_WORKLIST = LINKS + f""", {_PIVOT},
w AS (SELECT p.*, s.platform_id, s.column_name, s.source_table, f.canonical_name
      FROM mapping_proposals p LEFT JOIN source_columns s USING (column_id) LEFT JOIN fields f ON f.canonical_id = p.suggested_canonical_id)
SELECT proposal_id, coalesce(w.canonical_name, suggested_canonical_name, '') AS suggested_match,
  upper(confidence_level[1]) || confidence_level[2:] AS confidence, coalesce(column_name, '') AS header,
  coalesce(pl.name, CAST(w.platform_id AS VARCHAR), '') AS platform, coalesce(string_split(source_table, '.')[-1], '') AS source_table,
  CASE status WHEN 'pending_review' THEN 'Pending Review' ELSE upper(status[1]) || status[2:] END AS status,
  {_CELL_COLUMNS}, coalesce(c.page, 0) AS page
FROM w LEFT JOIN platforms pl USING (platform_id) LEFT JOIN cells c ON c.canonical_id = suggested_canonical_id"""

check("worklist_all", _WORKLIST)
check("worklist_filtered", _WORKLIST + """
WHERE w.status = 'pending_review' AND w.platform_id = 3 AND (contains(lower(coalesce(column_name, '')), 'ring')
  OR contains(lower(coalesce(source_table, '')), 'ring') OR contains(lower(coalesce(w.canonical_name, '')), 'ring')
  OR contains(lower(coalesce(reasoning, '')), 'ring'))""")

_DECIDED = role_sql("mapping_proposals", "decisions") + """,
usable AS (SELECT d.*, p.column_id, p.suggested_canonical_id AS suggested FROM decisions d JOIN mapping_proposals p USING (proposal_id)
  WHERE action IN ('flag', 'reject') OR (action = 'reassign' AND d.canonical_id IS NOT NULL)
     OR (action = 'approve' AND p.suggested_canonical_id IS NOT NULL)),
chosen AS (SELECT *, CASE action WHEN 'approve' THEN suggested WHEN 'reassign' THEN canonical_id END AS cid FROM usable
  QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY decided_at DESC, decision_id DESC) = 1)"""

check("apply_decisions", _DECIDED + """
SELECT p.proposal_id, CASE WHEN c.action IN ('approve', 'reassign') THEN 'approved' WHEN c.action = 'flag' THEN 'flagged'
    WHEN c.action = 'reject' THEN 'rejected' ELSE p.status END AS status,
  CASE WHEN c.action IN ('approve', 'reassign', 'reject') THEN c.decided_at ELSE p.reviewed_at END AS reviewed_at,
  CASE WHEN c.action IN ('approve', 'reassign', 'reject') THEN c.actor ELSE p.reviewed_by END AS reviewed_by
FROM mapping_proposals p LEFT JOIN chosen c USING (proposal_id)""")
check("decided_mappings", _DECIDED + """
SELECT """ + stable_id("proposal_id", "decision_id") + """ AS mapping_id, column_id, cid AS canonical_id, proposal_id, actor AS approved_by, decided_at AS approved_at
FROM chosen WHERE cid IS NOT NULL""")
check("decision_audit", _DECIDED + """
SELECT CASE WHEN cid IS NOT NULL THEN 'mapping' ELSE 'proposal' END AS entity_type,
  CASE WHEN cid IS NOT NULL THEN """ + stable_id("proposal_id", "decision_id") + """ ELSE CAST(proposal_id AS VARCHAR) END AS entity_id,
  CASE WHEN cid IS NOT NULL THEN 'approved' WHEN action = 'flag' THEN 'flagged' ELSE 'rejected' END AS action, actor,
  CASE action WHEN 'approve' THEN '{"canonical_id":' || cid || ',"column_id":' || column_id || '}'
    WHEN 'reassign' THEN '{"canonical_id":' || cid || ',"reassigned":' || CASE WHEN cid IS DISTINCT FROM suggested THEN 'true' ELSE 'false' END || '}' END AS details,
  decided_at AS created_at FROM chosen""")

# ---- coverage ----

check("run_kpis", role_sql("source_columns", "mapping_proposals") + """
SELECT (SELECT count(*) FROM source_columns) AS source_columns,
  (SELECT count(*) FROM source_columns WHERE column_id NOT IN (SELECT column_id FROM mapping_proposals)) AS unmapped,
  (SELECT count(*) FROM mapping_proposals WHERE status = 'pending_review') AS pending_review,
  (SELECT count(*) FROM mapping_proposals WHERE status = 'approved') AS approved""")

check("platform_profile", LINKS + """,
t AS (SELECT platform_id, string_agg(DISTINCT string_split(source_table, '.')[-1], ', ' ORDER BY string_split(source_table, '.')[-1]) AS tables,
        count(*) AS n FROM source_columns GROUP BY 1),
p AS (SELECT platform_id, count(*) AS n FROM mapping_proposals JOIN source_columns USING (column_id) GROUP BY 1),
a AS (SELECT platform_id, count(*) AS n FROM links GROUP BY 1)
SELECT platform_id, name AS platform, description, location, CAST(0 AS BIGINT) AS page, coalesce(tables, '--') AS tables, coalesce(t.n, 0) AS columns,
  coalesce(p.n, 0) AS proposals, coalesce(a.n, 0) AS approved
FROM platforms LEFT JOIN t USING (platform_id) LEFT JOIN p USING (platform_id) LEFT JOIN a USING (platform_id)""")

check("batch_summary", LINKS + """
SELECT s.platform_id, count(DISTINCT s.column_id) AS total_columns, count(DISTINCT a.column_id) AS mapped_columns,
  count(DISTINCT p.column_id) AS pending_proposals
FROM source_columns s LEFT JOIN (SELECT DISTINCT column_id FROM approved_mappings) a USING (column_id)
  LEFT JOIN (SELECT DISTINCT column_id FROM mapping_proposals WHERE status = 'pending_review') p USING (column_id) GROUP BY 1""")

_CELLS = f""", {_PIVOT}, cov AS (SELECT canonical_id, count(DISTINCT platform_id) AS k FROM links GROUP BY 1),
m AS (SELECT canonical_id, coalesce(f.canonical_name, CAST(canonical_id AS VARCHAR)) AS canonical_field, coalesce(f.domain_category, '') AS domain,
  coalesce(f.data_type, '') AS type, page, c.* EXCLUDE (canonical_id, page), CASE WHEN page = 0 THEN k || '/25' ELSE '' END AS coverage
  FROM cells c JOIN cov USING (canonical_id) LEFT JOIN fields f USING (canonical_id))"""
_MATRIX = LINKS + _CELLS
check("coverage_matrix", _MATRIX + " SELECT * FROM m")
check("busy_matrix", BUSY + _CELLS + " SELECT * FROM m")
check("matrix_filtered", _MATRIX + " SELECT * FROM m WHERE (contains(lower(canonical_field), 'bolt') OR "
      + " OR ".join(f"contains(lower(\"{n}\"), 'bolt')" for _, n in PLATFORM_NAMES) + ") AND \"NATION_3\" <> ''")

_ENTRIES = """numbered AS (SELECT *, row_number() OVER (PARTITION BY canonical_id, platform_id ORDER BY approved_at DESC, mapping_id) AS entry FROM links),
entries AS (SELECT canonical_id, platform_id, coalesce(name, CAST(platform_id AS VARCHAR)) AS platform, entry, coalesce(column_name, '') AS column_name
            FROM numbered LEFT JOIN platforms USING (platform_id))"""
_HEADERS = """headers AS (SELECT canonical_id, coalesce(any_value(f.canonical_name), CAST(canonical_id AS VARCHAR)) AS canonical_field, coalesce(any_value(f.domain_category), '') AS domain,
    coalesce(any_value(f.data_type), '') AS type, count(DISTINCT platform_id) AS covered, count(*) AS links, count(DISTINCT platform_id) || '/25' AS coverage
  FROM links l LEFT JOIN fields f USING (canonical_id) GROUP BY canonical_id)"""
check("matrix_headers", BUSY + f", {_HEADERS} SELECT * FROM headers")
check("matrix_entries", BUSY + f", {_ENTRIES} SELECT * FROM entries")
check("matrix_cells", BUSY + f", {_ENTRIES} SELECT canonical_id, platform_id, (entry - 1) // 100 AS page, count(*) AS names, string_agg(column_name, ', ' ORDER BY entry) AS cell FROM entries GROUP BY 1, 2, 3")
check("matrix_report_filtered", LINKS + f""", {_ENTRIES}, {_HEADERS}
SELECT * FROM headers h WHERE (contains(lower(canonical_field), 'bolt') OR EXISTS (SELECT 1 FROM entries e WHERE e.canonical_id = h.canonical_id AND contains(lower(column_name), '#000000012')))
  AND EXISTS (SELECT 1 FROM entries e WHERE e.canonical_id = h.canonical_id AND platform_id = 3 AND column_name <> '')""")
_SUGGESTED = "suggested AS (SELECT DISTINCT suggested_canonical_id AS canonical_id FROM mapping_proposals WHERE status = 'pending_review')"
check("worklist_headers", LINKS + f""", {_SUGGESTED}, names AS (SELECT canonical_id, count(*) AS n FROM links GROUP BY 1)
SELECT proposal_id, suggested_canonical_id, coalesce(f.canonical_name, suggested_canonical_name, '') AS suggested_match, upper(confidence_level[1]) || confidence_level[2:] AS confidence,
  coalesce(s.column_name, '') AS header, coalesce(pl.name, CAST(s.platform_id AS VARCHAR), '') AS platform, coalesce(string_split(s.source_table, '.')[-1], '') AS source_table,
  'Pending Review' AS status, coalesce(n, 0) AS names
FROM mapping_proposals p LEFT JOIN source_columns s USING (column_id) LEFT JOIN fields f ON f.canonical_id = p.suggested_canonical_id
  LEFT JOIN platforms pl ON pl.platform_id = s.platform_id LEFT JOIN names ON names.canonical_id = p.suggested_canonical_id
WHERE status = 'pending_review'""")
check("worklist_entries", LINKS + f", {_SUGGESTED}, {_ENTRIES} SELECT * FROM entries WHERE canonical_id IN (SELECT canonical_id FROM suggested)")
check("profile_headers", LINKS + """,
t AS (SELECT platform_id, count(DISTINCT string_split(source_table, '.')[-1]) AS tables, count(*) AS n FROM source_columns GROUP BY 1),
p AS (SELECT platform_id, count(*) AS n FROM mapping_proposals JOIN source_columns USING (column_id) GROUP BY 1), a AS (SELECT platform_id, count(*) AS n FROM links GROUP BY 1)
SELECT platform_id, name AS platform, description, location, coalesce(tables, 0) AS tables, coalesce(t.n, 0) AS columns, coalesce(p.n, 0) AS proposals, coalesce(a.n, 0) AS approved
FROM platforms LEFT JOIN t USING (platform_id) LEFT JOIN p USING (platform_id) LEFT JOIN a USING (platform_id)""")
check("profile_entries", LINKS + """
SELECT platform_id, row_number() OVER (PARTITION BY platform_id ORDER BY string_split(source_table, '.')[-1]) AS entry, string_split(source_table, '.')[-1] AS "table", count(*) AS columns
FROM source_columns WHERE platform_id IN (SELECT platform_id FROM platforms) GROUP BY platform_id, string_split(source_table, '.')[-1]""")

check("matrix_totals", LINKS + """,
pc AS (SELECT p.name, p.ord, count(DISTINCT l.canonical_id) AS k FROM platforms p LEFT JOIN links l USING (platform_id) GROUP BY 1, 2),
best AS (SELECT name, k FROM pc ORDER BY k DESC, ord LIMIT 1)
SELECT (SELECT count(DISTINCT canonical_id) FROM links) AS mapped_fields, (SELECT count(*) FROM links) AS total_links,
  (SELECT count(*) FROM platforms) AS platforms, name AS best_platform, k AS best_covered FROM best""")

check("platform_coverage", LINKS + """,
a AS (SELECT platform_id, count(DISTINCT canonical_id) AS f, count(*) AS n FROM links GROUP BY 1),
s AS (SELECT platform_id, count(*) AS n FROM source_columns GROUP BY 1)
SELECT platform_id, name AS platform, coalesce(f, 0) AS fields_covered, coalesce(s.n, 0) AS source_columns, coalesce(a.n, 0) AS approved_columns,
  CASE WHEN coalesce(s.n, 0) = 0 THEN '0%' ELSE printf('%.0f', a.n / s.n::DOUBLE * 100) || '%' END AS column_coverage
FROM platforms LEFT JOIN a USING (platform_id) LEFT JOIN s USING (platform_id)""")

INTAKE_FIELDS = INTAKE + ", fields AS (SELECT * FROM canonical_fields WHERE coalesce(is_active, true))"
check("registry_kpis", INTAKE_FIELDS + """,
m AS (SELECT count(*) AS n FROM intake_columns WHERE column_id IN (SELECT column_id FROM intake_approved)), t AS (SELECT count(*) AS n FROM intake_columns)
SELECT (SELECT count(*) FROM fields) AS fields, (SELECT count(*) FROM intake_approved) AS mappings, t.n - m.n AS unmapped,
  printf('%.1f', m.n / t.n::DOUBLE * 100) || '%' AS coverage FROM m, t""")

check("field_coverage", LINKS + """,
per AS (SELECT canonical_id, platform_id, count(*) AS n FROM links GROUP BY 1, 2),
tot AS (SELECT canonical_id, CAST(sum(n) AS BIGINT) AS mapped, coalesce(string_agg(name || '(' || n || ')', ', ' ORDER BY ord), '') AS t
        FROM per LEFT JOIN platforms USING (platform_id) GROUP BY 1)
SELECT canonical_id, canonical_name AS name, substr(business_definition, 1, 100) AS definition, coalesce(t, '--') AS platform_coverage,
  coalesce(mapped, 0) AS mapped_headers, domain_category AS domain, data_type AS type FROM fields LEFT JOIN tot USING (canonical_id)""")

check("registry_report", INTAKE_FIELDS + """,
tot AS (SELECT canonical_id, count(DISTINCT platform_id) AS p, count(*) AS n FROM intake_approved JOIN intake_columns USING (column_id) GROUP BY 1)
SELECT canonical_id, canonical_name, data_type, domain_category AS domain, business_definition AS definition, coalesce(p, 0) AS platforms_covered,
  coalesce(n, 0) AS total_mappings FROM fields LEFT JOIN tot USING (canonical_id)""")

check("registry_filtered", INTAKE_FIELDS + """
SELECT * FROM fields WHERE domain_category = 'ECONOMY' AND (contains(lower(canonical_name), 'gear') OR contains(lower(business_definition), 'gear'))""")

check("field_detail", LINKS + """,
rows_ AS (SELECT canonical_id, platform_id, column_name, source_table, 'Linked' AS kind, mapping_id AS row_id, approved_by, CAST(NULL AS VARCHAR) AS match_confidence FROM links
  UNION ALL SELECT suggested_canonical_id, s.platform_id, s.column_name, s.source_table, 'Pending', CAST(p.proposal_id AS VARCHAR), NULL,
    upper(confidence_level[1]) || confidence_level[2:]
  FROM mapping_proposals p JOIN source_columns s USING (column_id) WHERE status = 'pending_review'
    AND EXISTS (SELECT 1 FROM links l WHERE l.canonical_id = p.suggested_canonical_id AND l.platform_id = s.platform_id))
SELECT canonical_id, platform_id, column_name, string_split(source_table, '.')[-1] AS source_table, kind, row_id, approved_by, match_confidence,
  coalesce(name, CAST(platform_id AS VARCHAR)) AS platform FROM rows_ LEFT JOIN platforms USING (platform_id)""")

check("field_status", LINKS + """,
c AS (SELECT canonical_id, count(DISTINCT platform_id) AS k, count(*) AS n FROM links GROUP BY 1),
l AS (SELECT canonical_id, count(*) AS n FROM approved_mappings GROUP BY 1),
p AS (SELECT suggested_canonical_id AS canonical_id, count(*) AS n FROM mapping_proposals WHERE status = 'pending_review' GROUP BY 1)
SELECT canonical_id, canonical_name, coalesce(c.k, 0) || '/25' AS platform_coverage, coalesce(c.n, 0) AS total_mappings, coalesce(l.n, 0) AS linked,
  coalesce(p.n, 0) AS pending,
  CASE WHEN l.n > 0 AND p.n > 0 THEN l.n || ' Linked, ' || p.n || ' Pending' WHEN l.n > 0 THEN l.n || ' Linked' WHEN p.n > 0 THEN p.n || ' Pending'
    ELSE 'No mappings' END AS status
FROM canonical_fields LEFT JOIN c USING (canonical_id) LEFT JOIN l USING (canonical_id) LEFT JOIN p USING (canonical_id)""")

# ---- conform ----

check("conform_plan", LINKS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY source_table ORDER BY approved_at DESC, mapping_id) AS n FROM links),
c AS (SELECT source_table, count(*) AS k, min_by(platform_id, n) AS platform_id FROM o GROUP BY 1),
t AS (SELECT source_table, string_agg(column_name || ' -> ' || coalesce(canonical_name, '?'), ', ' ORDER BY n) AS t
      FROM o LEFT JOIN fields USING (canonical_id) WHERE n <= 3 GROUP BY 1)
SELECT source_table, string_split(source_table, '.')[-1] AS "table", coalesce(name, CAST(platform_id AS VARCHAR)) AS platform, k AS mapped_columns,
  t || CASE WHEN k > 3 THEN '...' ELSE '' END AS column_renames FROM c JOIN t USING (source_table) LEFT JOIN platforms USING (platform_id)""")

check("rename_text", LINKS + f""",
o AS (SELECT source_table, '    `' || column_name || '` AS `' || canonical_name || '`' AS item,
        row_number() OVER (PARTITION BY source_table ORDER BY approved_at DESC, mapping_id) AS n FROM links JOIN canonical_fields USING (canonical_id)),
g AS (SELECT source_table, (n - 1) // {PAGE} AS page, string_agg(item, ',' || chr(10) ORDER BY n) AS body FROM o GROUP BY 1, 2),
e AS (SELECT source_table, max(page) AS last FROM g GROUP BY 1), w AS (SELECT DISTINCT source_table, first_value(platform_id) OVER (PARTITION BY source_table ORDER BY approved_at DESC NULLS LAST, mapping_id) AS pid FROM links)
SELECT source_table, page, CASE WHEN page = 0 THEN 'CREATE OR REPLACE VIEW gold.' || pid || '__' || string_split(source_table, '.')[-1] || ' AS' || chr(10) || 'SELECT' || chr(10)
    ELSE '' END || body || CASE WHEN page = last THEN chr(10) || 'FROM ' || source_table ELSE ',' || chr(10) END AS text
FROM g JOIN e USING (source_table) JOIN w USING (source_table)""")

# Of a repeated field id the last name counts.
_REPEATED = role_sql("source_columns", "approved_mappings", "repeated_fields", "platforms") + """,
fields AS (SELECT canonical_id, max(canonical_name) AS canonical_name FROM repeated_fields GROUP BY 1),
links AS (SELECT a.*, s.platform_id, s.column_name, s.source_table FROM approved_mappings a JOIN source_columns s USING (column_id))"""
check("rename_plan", _REPEATED + """,
r AS (SELECT source_table, column_name, canonical_name, count(*) AS mappings FROM links JOIN fields USING (canonical_id) GROUP BY 1, 2, 3)
SELECT *, count(*) OVER w AS columns, min(column_name) OVER w AS first_column FROM r WINDOW w AS (PARTITION BY source_table, canonical_name)""")
check("repeated_conform_plan", _REPEATED + CHECKS["conform_plan"].split("WHERE coalesce(is_active, true))", 1)[1])
check("repeated_rename_text", _REPEATED + CHECKS["rename_text"].split("WHERE coalesce(is_active, true))", 1)[1].replace("canonical_fields", "fields"))

check("conform_table", """
SELECT c_custkey AS party_id, c_name AS party_name, c_acctbal AS balance, 'cat.crm.customer' AS source_table FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'cat.buy.supplier' FROM supplier""")

# ---- audit ----

check("audit_latest", role_sql("audit_log") + """
SELECT event_id, action, actor, created_at FROM audit_log ORDER BY created_at DESC, event_id LIMIT 500""")
check("audit_metrics", role_sql("audit_log") + """
SELECT count(*) AS events, count(DISTINCT actor) AS actors, count(DISTINCT entity_type) AS entity_types FROM audit_log""")
check("audit_filtered", role_sql("audit_log") + """
SELECT event_id, details, created_at FROM audit_log WHERE entity_type = 'mapping' AND action = 'click' AND actor = 'user 7'""")
check("audit_facets", role_sql("audit_log") + """
SELECT DISTINCT facet, value FROM (SELECT unnest([{'facet': 'entity_type', 'value': entity_type}, {'facet': 'action', 'value': action},
  {'facet': 'actor', 'value': actor}], recursive := true) FROM audit_log) WHERE coalesce(value, '') <> ''""")

# ---- stored tables ----

_REGISTRY = LINKS + """,
report AS (SELECT canonical_id, canonical_name, data_type, domain_category AS domain, business_definition AS definition,
    (SELECT count(DISTINCT platform_id) FROM links l WHERE l.canonical_id = c.canonical_id) AS platforms_covered, (SELECT count(*) FROM links l WHERE l.canonical_id = c.canonical_id) AS total_mappings
  FROM canonical_fields c)"""
check("ordered_registry", _REGISTRY + """
SELECT canonical_id, canonical_name, total_mappings, row_number() OVER (ORDER BY canonical_name, canonical_id) - 1 AS ordinal FROM report""")
check("exported_registry", _REGISTRY + " SELECT * FROM report")
check("ordered_audit_page", role_sql("audit_log") + """
SELECT event_id, action, actor, created_at, row_number() OVER (ORDER BY created_at DESC, event_id) - 1 AS ordinal FROM audit_log QUALIFY ordinal >= 200 AND ordinal < 300""")
check("seeded_fields", role_sql("canonical_fields") + """
SELECT CAST(canonical_id AS VARCHAR) AS canonical_id, canonical_name, data_type, business_definition, domain_category, is_active, 'seed' AS created_by
FROM canonical_fields WHERE coalesce(is_active, true)""")
check("seeded_platforms", " UNION ALL ".join(
    CHECKS["discover_columns"].split(" UNION ALL ")[TABLES.index(t)].replace("'given' AS platform_id", f"'{p}' AS platform_id").replace(f"'{t}' AS source_table", f"'harmonised.{p}.{t}' AS source_table")
    for p, t in (("crm", "customer"), ("buy", "supplier"))))
check("stored_proposals", role_sql("mapping_proposals") + """
SELECT CAST(proposal_id AS VARCHAR) AS proposal_id, CAST(column_id AS VARCHAR) AS column_id, CAST(suggested_canonical_id AS VARCHAR) AS suggested_canonical_id, round(confidence, 6) AS confidence,
  confidence_level, status, CAST(NULL AS VARCHAR) AS assigned_to FROM mapping_proposals""")
check("published_views", """
SELECT c_custkey AS party_id, c_name AS party_name, 'crm' AS view FROM customer UNION ALL SELECT s_suppkey, s_name, 'buy' FROM supplier
UNION ALL SELECT 1, '{"count":2}', 'event'""")
