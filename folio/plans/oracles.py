"""Independent DuckDB oracles for the named queries.

The oracles do not repeat the Spark expressions: scores come from the integer rules on the
order key that produced the test answers (FIXTURES section 2), so a wrong parser or a wrong
verdict order in the Spark code shows up as a mismatch. Only the input views are shared.
"""

from __future__ import annotations

NL = "chr(10)"

# Orders with their ground truth, and every rule-derived score (k = o_orderkey, ck = o_custkey).
BASE = f"""
base AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_orderdate, o.o_totalprice,
         c.c_name, c.c_mktsegment, n.n_name
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
),
tr AS (
  SELECT *,
    'K' || lpad(CAST(ck AS VARCHAR), 6, '0') AS t_id,
    strftime(DATE '1950-01-01' + CAST(ck * 37 % 18000 AS INTEGER), '%d.%m.%Y') AS t_dn,
    CASE WHEN ck % 3 = 0 THEN '' ELSE substr(c_mktsegment, 1, 2) END AS t_ini,
    CASE WHEN ck % 5 = 0 THEN '' ELSE strftime(DATE '2025-01-01' + CAST(ck * 11 % 3650 AS INTEGER), '%d.%m.%Y') END AS t_de
  FROM base
),
v AS (
  SELECT *,
    k AS id, 'cin' AS doc,
    'm' || CAST(k % 3 AS VARCHAR) AS model,
    'v' || CAST(k % 2 + 1 AS VARCHAR) AS prompt_version,
    CASE WHEN k % 19 = 0 THEN NULL WHEN k % 3 = 0 THEN '["background","tilt"]'
         WHEN k % 3 = 1 THEN '["background"]' ELSE '[]' END AS tags,
    o_orderdate + to_seconds(k % 86400) AS ts,
    CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.0001, 3) AS DOUBLE) AS execution_time,
    CASE WHEN k % 29 = 0 THEN 'missing' ELSE 'correct' END AS v_prenom,
    CASE WHEN k % 29 = 0 OR k % 17 = 0 THEN 'missing' ELSE 'correct' END AS v_nom,
    CASE WHEN k % 29 = 0 THEN 'missing' ELSE 'correct' END AS v_id_document_recto,
    CASE WHEN k % 29 = 0 THEN 'missing' WHEN k % 11 = 0 THEN 'mismatch' ELSE 'correct' END AS v_date_naissance,
    CASE WHEN k % 29 = 0 THEN 'missing' WHEN k % 13 = 0 THEN 'mismatch' ELSE 'correct' END AS v_lieu_naissance,
    CASE WHEN k % 29 = 0 THEN 'missing'
         WHEN k % 7 = 0 THEN (CASE WHEN ck % 3 = 0 THEN 'hallucinated' ELSE 'mismatch' END)
         ELSE 'correct' END AS v_initiales,
    CASE WHEN k % 29 = 0 THEN 'missing' ELSE 'correct' END AS v_date_expiration,
    CASE WHEN k % 29 = 0 THEN 'missing' ELSE 'correct' END AS v_nationalite,
    CASE WHEN k % 29 = 0 THEN 0.0
         ELSE 8.0 - (k % 17 = 0)::INT - (k % 11 = 0)::INT - (k % 13 = 0)::INT - (k % 7 = 0)::INT END::DOUBLE AS cf,
    CASE WHEN k % 29 = 0 OR k % 17 = 0 THEN 'incorrect' ELSE 'correct' END AS fc
  FROM tr
),
s AS (
  SELECT *,
    CASE WHEN k % 43 = 0 THEN 'NaN'::DOUBLE WHEN k % 41 = 0 THEN 9.0::DOUBLE ELSE cf END AS judge_fields,
    CASE WHEN k % 31 = 0 THEN NULL WHEN k % 37 = 0 THEN 'maybe' WHEN k % 11 = 0 THEN 'incorrect' ELSE fc END AS judge_format,
    CASE WHEN k % 47 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS timestamp_text,
    CASE WHEN k % 53 = 0 THEN NULL ELSE model END AS model_or_null
  FROM v
)"""

FIELDS = [
    "prenom",
    "nom",
    "id_document_recto",
    "date_naissance",
    "lieu_naissance",
    "initiales",
    "date_expiration",
    "nationalite",
]

FIELD_VALUES = ", ".join(f"({i + 1}, '{f}')" for i, f in enumerate(FIELDS))
VERDICT_CASE = "CASE f.field " + " ".join(f"WHEN '{x}' THEN v_{x}" for x in FIELDS) + " END"
VERDICTS = f"""
fv AS (
  SELECT s.id, s.model, s.prompt_version, f.field_pos, f.field, {VERDICT_CASE} AS verdict
  FROM s CROSS JOIN (VALUES {FIELD_VALUES}) AS f(field_pos, field)
)"""

# Generated values per field, from the mutation rules (NULL = key absent or no object).
GEN_CASE = f"""CASE WHEN k % 29 = 0 THEN NULL ELSE CASE f.field
    WHEN 'prenom' THEN c_name
    WHEN 'nom' THEN CASE WHEN k % 17 = 0 THEN NULL ELSE c_mktsegment END
    WHEN 'id_document_recto' THEN t_id
    WHEN 'date_naissance' THEN CASE WHEN k % 11 = 0 THEN replace(t_dn, '.', '/') ELSE t_dn END
    WHEN 'lieu_naissance' THEN CASE WHEN k % 13 = 0 THEN 'CASABLANCA' ELSE n_name END
    WHEN 'initiales' THEN CASE WHEN k % 7 = 0 THEN 'XX' ELSE t_ini END
    WHEN 'date_expiration' THEN t_de
    WHEN 'nationalite' THEN 'Marocaine' END END"""

RULES_SQL = """(VALUES
  ('prenom', '^[^0-9]+$', true), ('nom', '^[^0-9]+$', true),
  ('id_document_recto', '^[A-Z]{1,2}[0-9]{5,8}$', true), ('date_naissance', '^[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}$', true),
  ('lieu_naissance', '^.+$', true), ('initiales', '^[A-Z]{1,3}$', true),
  ('date_expiration', '^[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}$', true), ('nationalite', '^Marocaine$', false)
) AS r(field, pattern, empty_ok)"""


def _json_text(gen: bool) -> str:
    """The JSON text of the expected / generated object, written out by concatenation."""
    q = "'\"'"
    parts = []
    for f, val in [
        ("prenom", "c_name"),
        ("nom", "c_mktsegment"),
        ("id_document_recto", "t_id"),
        ("date_naissance", "CASE WHEN k % 11 = 0 THEN replace(t_dn, '.', '/') ELSE t_dn END" if gen else "t_dn"),
        ("lieu_naissance", "CASE WHEN k % 13 = 0 THEN 'CASABLANCA' ELSE n_name END" if gen else "n_name"),
        ("initiales", "CASE WHEN k % 7 = 0 THEN 'XX' ELSE t_ini END" if gen else "t_ini"),
        ("date_expiration", "t_de"),
        ("nationalite", "'Marocaine'"),
    ]:
        item = f"'\"{f}\":' || {q} || {val} || {q}"
        if gen and f == "nom":
            item = f"CASE WHEN k % 17 = 0 THEN NULL ELSE {item} END"
        parts.append(item)
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


EXPECTED_TEXT = _json_text(False)
GENERATED_TEXT = (
    f"CASE WHEN k % 29 = 0 THEN 'I cannot read this image.' ELSE "
    f"(CASE WHEN k % 2 = 0 THEN '```json' || {NL} ELSE '' END) || {_json_text(True)} || "
    f"(CASE WHEN k % 2 = 0 THEN {NL} || '```' ELSE '' END) END"
)

MANIFEST = """
m AS (
  SELECT o_orderkey AS id, o_custkey,
    CASE WHEN o_orderkey % 37 = 0 THEN '/abs/' || CAST(o_orderkey AS VARCHAR) || '.png'
         ELSE 'ins/' || CAST(o_orderkey AS VARCHAR) || '.' ||
              (['png','jpg','jpeg','pdf','gif','webp','bmp','TIFF'])[o_orderkey % 8 + 1] END AS "in",
    'outs/' || CAST(o_custkey AS VARCHAR) || '.json' AS "out"
  FROM orders
)"""

ASSETS = """
a AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL
         ELSE (['JPEG','PNG','BMP','TIFF','GIF','WEBP','jpg'])[o_orderkey % 7 + 1] END AS format,
    CAST(256 * (1 + o_orderkey % 16) AS INTEGER) AS width,
    CAST(256 * (1 + o_orderkey % 11) AS INTEGER) AS height,
    CAST((['1','3','4'])[o_orderkey % 3 + 1] AS INTEGER) AS channels,
    o_orderkey % 31 = 0 AS missing
  FROM orders
)"""

REQUESTS = """
rq AS (
  SELECT conv_id * 1000 + turn AS req_id,
    CASE WHEN (conv_id + turn) % 13 = 0 THEN '' WHEN (conv_id + turn) % 17 = 0 THEN '  ' ELSE text END AS prompt,
    CASE WHEN turn % 3 = 0 THEN CAST(100 + conv_id % 50 AS INTEGER) END AS max_tokens,
    CASE WHEN conv_id % 4 IN (0, 1) THEN 'p/' || CAST(conv_id AS VARCHAR) || '.png' ELSE '' END AS path,
    CASE WHEN conv_id % 4 IN (1, 2) THEN 'http://h' || CAST(conv_id % 5 AS VARCHAR) || '/x.png' END AS url
  FROM conversations WHERE role = 'user'
)"""

EXCHANGES = """
x AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""

PAGES = f"""
lines AS (SELECT doc_id, string_split(text, {NL}) AS l FROM documents),
pg AS (
  SELECT doc_id, p, list_slice(l, p * 20 + 1, p * 20 + 20) AS pl
  FROM lines, generate_series(0, (len(l) - 1) // 20) AS g(p)
)"""

STRIP = "regexp_replace({x}, '^[\\s\\v]+|[\\s\\v]+$', '', 'g')"


def _w(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n"


ORACLES: dict[str, str] = {}

ORACLES["leaderboard"] = _w(BASE) + """
SELECT model, prompt_version, count(*) AS n_rows,
  round(avg(cf), 6) AS avg_correct_fields,
  round(avg(CASE WHEN fc = 'incorrect' THEN 100.0 ELSE 0.0 END)::DOUBLE, 6) AS pct_format_incorrect,
  round(avg(execution_time), 6) AS avg_execution_time,
  round(min(execution_time), 6) AS min_execution_time
FROM s WHERE doc = 'cin' GROUP BY model, prompt_version"""

ORACLES["score_fields"] = _w(BASE) + "SELECT id, cf AS correct_fields FROM s"
ORACLES["score_format"] = _w(BASE) + "SELECT id, fc AS format_compliance FROM s"
ORACLES["score_errors"] = _w(BASE) + """
SELECT id, CASE WHEN e IS NULL THEN cf END AS correct_fields, CASE WHEN e IS NULL THEN fc END AS format_compliance,
  e AS score_error
FROM (SELECT *, CASE WHEN k % 37 = 0 THEN 'failed_call' WHEN k % 31 = 0 THEN 'missing_truth' END AS e FROM s)"""
ORACLES["score_strict"] = _w(BASE) + """
SELECT id, CASE WHEN k % 10 = 1 THEN 0.0 ELSE cf END AS correct_fields,
  CASE WHEN k % 10 = 1 THEN 'incorrect' ELSE fc END AS format_compliance,
  CASE WHEN k % 10 = 1 OR k % 29 = 0 THEN 'not a JSON object' WHEN k % 17 = 0 THEN 'missing: nom; extra: ' ELSE '' END
    AS format_compliance_reason
FROM s"""
ORACLES["fence_strip"] = _w(BASE) + """
SELECT id, (k % 2 = 0 AND k % 29 <> 0) AS fenced, (k % 2 = 1 AND k % 29 <> 0) AS raw_valid_json,
  (k % 29 <> 0) AS stripped_valid_json FROM s"""
ORACLES["score_domain"] = _w(BASE) + """
SELECT id,
  CASE WHEN k % 43 = 0 OR k % 41 = 0 THEN NULL ELSE cf END AS fields_score,
  CASE WHEN k % 43 = 0 THEN 'not_a_number' WHEN k % 41 = 0 THEN 'out_of_range' END AS fields_error,
  CASE WHEN judge_format IN ('correct', 'incorrect') THEN judge_format END AS format_score,
  CASE WHEN judge_format IS NULL THEN 'missing' WHEN judge_format NOT IN ('correct', 'incorrect') THEN 'not_allowed' END
    AS format_error
FROM s"""
ORACLES["score_reason"] = _w(BASE) + (
    "SELECT id, "
    + " || ', ' || ".join(f"'{f}=' || v_{f}" for f in FIELDS)
    + """ AS correct_fields_reason,
  CASE WHEN k % 29 = 0 THEN 'not a JSON object' WHEN k % 17 = 0 THEN 'missing: nom; extra: ' ELSE '' END
    AS format_compliance_reason
FROM s"""
)
ORACLES["field_verdicts"] = _w(BASE, VERDICTS) + "SELECT id, model, prompt_version, field_pos, field, verdict FROM fv"
ORACLES["field_accuracy"] = _w(BASE, VERDICTS) + """
SELECT field, count(*) AS n, CAST(sum(CASE WHEN verdict = 'correct' THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
  round(avg(CASE WHEN verdict = 'correct' THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy
FROM fv GROUP BY field"""
ORACLES["field_rules"] = _w(BASE) + f"""
SELECT field, rule_ok, count(*) AS n FROM (
  SELECT f.field,
    CASE WHEN g IS NULL THEN NULL WHEN g = '' THEN r.empty_ok ELSE regexp_matches(g, r.pattern) END AS rule_ok
  FROM (SELECT f.field, {GEN_CASE} AS g FROM s CROSS JOIN (VALUES {FIELD_VALUES}) AS f(field_pos, field)) f
  JOIN {RULES_SQL} ON r.field = f.field
) GROUP BY field, rule_ok"""
ORACLES["judge_prompt"] = _w(BASE) + f"""
SELECT id, md5(p) AS prompt_md5, CAST(length(p) AS BIGINT) AS prompt_length FROM (
  SELECT id, 'Check if the format of this generated reponse: ' || ({GENERATED_TEXT}) ||
    ' is same as the expected format ' || ({EXPECTED_TEXT}) || '. Return ''correct'' or ''incorrect''.' AS p
  FROM s)"""
ORACLES["judge_agreement"] = _w(BASE) + "SELECT judge_format AS judge, fc AS computed, count(*) AS n FROM s GROUP BY 1, 2"

ORACLES["avg_correct_fields"] = _w(BASE) + """
SELECT model_or_null AS model, prompt_version,
  round(avg(CASE WHEN isnan(judge_fields) THEN NULL ELSE judge_fields END), 6) AS avg_correct_fields
FROM s WHERE model_or_null IS NOT NULL AND doc = 'cin' GROUP BY 1, 2"""
ORACLES["pct_format_incorrect"] = _w(BASE) + """
SELECT model, prompt_version,
  round(avg(CASE WHEN judge_format = 'incorrect' THEN 100.0 ELSE 0.0 END)::DOUBLE, 6) AS pct_format_incorrect
FROM s WHERE doc = 'cin' GROUP BY 1, 2"""
ORACLES["avg_execution_time"] = _w(BASE) + """
SELECT model, prompt_version, round(avg(execution_time), 6) AS avg_execution_time FROM s WHERE doc = 'cin' GROUP BY 1, 2"""
ORACLES["filter_isin"] = _w(BASE) + """
SELECT id, model, prompt_version, fc AS format_compliance FROM s
WHERE model IN ('m0', 'm2') AND doc = 'cin' AND prompt_version = 'v2' AND fc = 'incorrect'"""
ORACLES["filter_tags_any"] = _w(BASE) + "SELECT id, tags FROM s WHERE k % 19 <> 0 AND k % 3 = 0"
ORACLES["filter_dates"] = _w(BASE) + """
SELECT id, timestamp_text FROM s
WHERE k % 47 <> 0 AND ts >= TIMESTAMP '1996-01-01 00:00:00' AND ts <= TIMESTAMP '1998-01-01 00:00:00'"""
ORACLES["filter_score_range"] = _w(BASE) + """
SELECT id, judge_fields FROM s WHERE NOT isnan(judge_fields) AND judge_fields >= 7 AND judge_fields <= 8"""
ORACLES["filter_all"] = _w(BASE) + """
SELECT id FROM s
WHERE model IN ('m0', 'm1') AND doc = 'cin' AND prompt_version = 'v1'
  AND k % 19 <> 0 AND k % 3 IN (0, 1)
  AND k % 47 <> 0 AND ts >= TIMESTAMP '1995-06-01 00:00:00' AND ts <= TIMESTAMP '2001-01-01 00:00:00'
  AND NOT isnan(judge_fields) AND judge_fields >= 6
  AND judge_format = 'correct'"""
ORACLES["filter_reset"] = _w(BASE) + "SELECT id FROM s"
ORACLES["facet_values"] = _w(BASE) + """
SELECT DISTINCT facet, value FROM (
  SELECT 'model' AS facet, model AS value FROM s UNION ALL
  SELECT 'doc', doc FROM s UNION ALL
  SELECT 'prompt_version', prompt_version FROM s UNION ALL
  SELECT 'judge_format', judge_format FROM s
) WHERE value IS NOT NULL"""
ORACLES["facet_tags"] = _w(BASE) + """
SELECT DISTINCT tag FROM (
  SELECT 'background' AS tag FROM s WHERE k % 19 <> 0 AND k % 3 IN (0, 1) UNION ALL
  SELECT 'tilt' FROM s WHERE k % 19 <> 0 AND k % 3 = 0)"""
# The dashboard's rule: split the cell text on ',' and strip each piece (no JSON).
ORACLES["facet_tags_split"] = _w(BASE) + """
SELECT DISTINCT tag FROM (
  SELECT regexp_replace(unnest(string_split(tags, ',')), '^[\\s\\v]+|[\\s\\v]+$', '', 'g') AS tag FROM s
  WHERE tags IS NOT NULL)
WHERE tag <> ''"""
ORACLES["filter_tags_split"] = _w(BASE) + """
SELECT id, tags FROM s WHERE id IN (
  SELECT id FROM (
    SELECT id, regexp_replace(unnest(string_split(tags, ',')), '^[\\s\\v]+|[\\s\\v]+$', '', 'g') AS t FROM s)
  WHERE t IN ('["background"]', '"tilt"]'))"""
ORACLES["score_bounds"] = _w(BASE) + """
SELECT CAST(coalesce(floor(min(j)), 0) AS INTEGER) AS n_min, CAST(coalesce(floor(max(j)), 15) AS INTEGER) AS n_max
FROM (SELECT CASE WHEN isnan(judge_fields) THEN NULL ELSE judge_fields END AS j FROM s)"""
ORACLES["table_sort"] = _w(BASE) + """
SELECT id, doc, model, prompt_version, tags, CAST(NULL AS VARCHAR) AS notes, CAST(ts AS VARCHAR) AS "timestamp",
  execution_time, cf AS correct_fields, fc AS format_compliance
FROM s ORDER BY execution_time DESC NULLS LAST, id"""
ORACLES["table_filter"] = _w(BASE) + """
SELECT id, model, execution_time, tags FROM s
WHERE model = 'm0' AND execution_time >= 30.0 AND coalesce(tags LIKE '%tilt%', false)"""
ORACLES["table_page"] = _w(BASE) + """
SELECT id, CAST(ts AS VARCHAR) AS "timestamp", model FROM s ORDER BY ts DESC NULLS LAST, id LIMIT 25 OFFSET 50"""
ORACLES["reason_bullets"] = _w(BASE) + (
    "SELECT 'correct_fields' AS metric, id, '- ' || "
    + " || ', ' || ".join(f"'{f}=' || v_{f}" for f in FIELDS)
    + """ AS line FROM s
UNION ALL
SELECT 'format_compliance', id,
  '- ' || CASE WHEN k % 29 = 0 THEN 'not a JSON object' ELSE 'missing: nom; extra: ' END
FROM s WHERE k % 29 = 0 OR k % 17 = 0"""
)
ORACLES["top_mistakes"] = _w(BASE, VERDICTS) + """
SELECT model, field, verdict, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT model, field, verdict, n,
    row_number() OVER (PARTITION BY model ORDER BY n DESC, field, verdict) AS rank
  FROM (SELECT model, field, verdict, count(*) AS n FROM fv WHERE verdict <> 'correct' GROUP BY 1, 2, 3)
) WHERE rank <= 3"""
ORACLES["results_union"] = _w(BASE) + (
    """
SELECT id, doc, model, prompt_version, tags, CAST(NULL AS VARCHAR) AS notes, CAST(ts AS VARCHAR) AS "timestamp",
  execution_time, cf AS correct_fields, fc AS format_compliance, """
    + " || ', ' || ".join(f"'{f}=' || v_{f}" for f in FIELDS)
    + """ AS correct_fields_reason,
  CASE WHEN k % 29 = 0 THEN 'not a JSON object' WHEN k % 17 = 0 THEN 'missing: nom; extra: ' ELSE '' END
    AS format_compliance_reason
FROM s"""
)
ORACLES["run_files"] = _w(BASE) + (
    """
SELECT id, doc, model, prompt_version, tags, CAST(NULL AS VARCHAR) AS notes,
  CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END
    AS "timestamp",
  execution_time, cf AS correct_fields, fc AS format_compliance, """
    + " || ', ' || ".join(f"'{f}=' || v_{f}" for f in FIELDS)
    + """ AS correct_fields_reason,
  CASE WHEN k % 29 = 0 THEN 'not a JSON object' WHEN k % 17 = 0 THEN 'missing: nom; extra: ' ELSE '' END
    AS format_compliance_reason,
  md5("""
    + EXPECTED_TEXT
    + """) AS expected_md5,
  md5("""
    + GENERATED_TEXT
    + """) AS generated_md5
FROM s"""
)
ORACLES["run_identity"] = _w(BASE) + """
SELECT id,
  CASE WHEN k % 10 = 0 THEN 'cin_' || model || '_' || strftime(ts, '%Y%m%d_%H%M%S')
       ELSE 'cin_prompt_' || prompt_version || (CASE WHEN k % 10 = 1 THEN '_beta' ELSE '' END) || '_' || model || '_'
            || strftime(ts, '%Y%m%d_%H%M%S') END || '.csv' AS file_name,
  CASE WHEN k % 10 = 0 THEN '' ELSE prompt_version END AS prompt_version
FROM s"""

ORACLES["manifest_resolve"] = _w(MANIFEST) + """
SELECT id, CASE WHEN "in" LIKE '/%' THEN "in" ELSE '/data/cin/' || "in" END AS in_path,
  CASE WHEN "out" LIKE '/%' THEN "out" ELSE '/data/cin/' || "out" END AS out_path FROM m"""
ORACLES["attach_truth"] = _w(MANIFEST) + """
SELECT m.id, m."out", t.c_custkey IS NOT NULL AS has_truth, t.c_name AS truth_prenom
FROM m LEFT JOIN (SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey) t
  ON m.o_custkey = t.c_custkey"""
ORACLES["url_triage"] = """
SELECT page_id, nullif(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), '') AS scheme,
  nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '') AS host,
  coalesce(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) IN ('http', 'https')
    AND regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) <> '' AND length(url) <= 2083, false) AS valid
FROM pages"""
ORACLES["media_type_dispatch"] = _w(MANIFEST) + """
SELECT id, sfx AS suffix, mt AS media_type,
  CASE WHEN mt IS NULL THEN NULL WHEN sfx = '.pdf' THEN 'document' ELSE 'image' END AS block_type,
  CASE WHEN mt IS NULL THEN 'Unsupported file type ''' || sfx || '''' END AS error
FROM (SELECT id, sfx, CASE sfx WHEN '.pdf' THEN 'application/pdf' WHEN '.jpg' THEN 'image/jpeg'
    WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif'
    WHEN '.webp' THEN 'image/webp' END AS mt
  FROM (SELECT id, lower(regexp_extract("in", '[^/](\\.[^./]+)$', 1)) AS sfx FROM m))"""
ORACLES["content_block"] = """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'document' ELSE 'image' END AS block_type,
  CASE WHEN doc_id % 3 = 0 THEN 'application/pdf' ELSE 'image/png' END AS media_type,
  md5(to_base64(encode(text))) AS data_md5, CAST(length(to_base64(encode(text))) AS BIGINT) AS data_length
FROM documents"""
ORACLES["format_validate"] = _w(ASSETS) + """
SELECT id, format,
  format IS NULL OR lower(format) IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff') AS ok_validation,
  format IS NULL OR lower(format) IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'pdf') AS ok_api
FROM a"""
ORACLES["size_validate"] = _w(ASSETS) + """
SELECT id, round(width * height * channels / 1048576.0, 6)::DOUBLE AS size_mb,
  NOT (width * height * channels / 1048576.0 > 10) AS size_ok FROM a"""
TRIAGE = """
SELECT id,
  CASE WHEN missing THEN 404
       WHEN NOT (format IS NULL OR lower(format) IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff'))
         OR width * height * channels / 1048576.0 > 10 THEN 400 ELSE 200 END AS status,
  CASE WHEN missing THEN 'not_found'
       WHEN NOT (format IS NULL OR lower(format) IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff')) THEN 'unsupported_format'
       WHEN width * height * channels / 1048576.0 > 10 THEN 'too_large' END AS error_class
FROM a"""
ORACLES["triage_status"] = _w(ASSETS) + TRIAGE
ORACLES["triage_summary"] = _w(ASSETS) + f"SELECT status, error_class, count(*) AS n FROM ({TRIAGE}) GROUP BY 1, 2"
ORACLES["prompt_validate"] = _w(REQUESTS) + "SELECT req_id, coalesce(length(prompt) >= 1, false) AS prompt_ok FROM rq"
ORACLES["source_xor"] = _w(REQUESTS) + """
SELECT req_id, (nullif(path, '') IS NULL) <> (nullif(url, '') IS NULL) AS source_ok FROM rq"""

ORACLES["layout_to_text"] = "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM documents"
ORACLES["items_to_text"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents"
ORACLES["page_explode"] = _w(PAGES) + f"""
SELECT doc_id, CAST(p + 1 AS BIGINT) AS page_no, CAST(len(pl) AS BIGINT) AS n_lines,
  md5(array_to_string(pl, {NL})) AS page_md5 FROM pg"""
ORACLES["preview"] = """
SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END AS preview_long,
  substr(text, 1, 100) || '...' AS preview_short FROM documents"""
ORACLES["demote_headings"] = """
SELECT doc_id, md5(CASE WHEN doc_id % 8 > 0 THEN repeat('#', CAST(doc_id % 8 + 1 AS INTEGER)) ELSE '' END || text)
  AS text_md5 FROM documents"""
ORACLES["strip_echo"] = _w(EXCHANGES) + f"""
SELECT conv_id, turn,
  CASE (conv_id + turn) % 3 WHEN 0 THEN {STRIP.format(x="answer")}
       WHEN 1 THEN '  ' || answer || ' ' ELSE answer END AS cleaned
FROM x"""
ORACLES["first_text_block"] = _w(EXCHANGES) + """
SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 IN (1, 2) THEN coalesce(answer, '') ELSE '' END AS first_text FROM x"""
ORACLES["result_envelope"] = _w(EXCHANGES) + """
SELECT conv_id, turn, 'text-model' AS model_id,
  CAST(CASE WHEN (conv_id + turn) % 7 = 0 THEN 0 ELSE coalesce(length(answer), 0) END AS BIGINT) AS n_chars,
  (conv_id + turn) % 7 <> 0 AND answer IS NOT NULL AS success,
  CASE WHEN answer IS NULL THEN 'no answer' WHEN (conv_id + turn) % 7 = 0 THEN 'timeout' END AS error
FROM x"""
ORACLES["result_json"] = _w(EXCHANGES) + """
SELECT conv_id, turn, md5(
  '{"text":' || to_json(CASE WHEN (conv_id + turn) % 7 = 0 THEN '' ELSE coalesce(answer, '') END)::VARCHAR
  || ',"model_id":"text-model","inference_time_seconds":' || CAST(round(coalesce(length(answer), 0) / 1000.0, 3)::DOUBLE AS VARCHAR)
  || ',"timestamp":"' || strftime(TIMESTAMP '2026-03-08 00:00:00' + to_seconds(conv_id), '%Y-%m-%dT%H:%M:%S') || '+00:00"'
  || ',"device":"cpu","error":'
  || CASE WHEN answer IS NULL THEN '"no answer"' WHEN (conv_id + turn) % 7 = 0 THEN '"timeout"' ELSE 'null' END
  || ',"success":' || CASE WHEN (conv_id + turn) % 7 = 0 OR answer IS NULL THEN 'false' ELSE 'true' END || '}') AS json_md5
FROM x"""

ORACLES["prompt_catalog"] = """
SELECT 'v' || CAST(item_id AS VARCHAR) AS version, substr(text, 1, 40) AS description,
  CASE WHEN item_id % 3 = 0 THEN 'ignore_noise' ELSE 'ignore_noise,fr' END AS tags,
  CASE item_id % 4 WHEN 0 THEN 'case' WHEN 1 THEN 'case,place' ELSE '' END AS template_vars
FROM benchmark WHERE item_id % 3 IN (0, 1)"""
ORACLES["prompt_render"] = """
SELECT 'v' || CAST(item_id AS VARCHAR) AS version,
  md5(CASE
    WHEN item_id % 4 = 0 THEN text || ' Case: {place}' || CAST(item_id AS VARCHAR) || '. Keep {braces} as they are.'
    WHEN item_id % 4 = 1 AND item_id % 5 = 0 THEN NULL
    WHEN item_id % 4 = 1 THEN '{case}: ' || text || ' Case: {place}' || CAST(item_id AS VARCHAR) || '.'
    ELSE text || ' Output {"a": ""}.' END) AS rendered_md5,
  CASE WHEN item_id % 4 = 1 AND item_id % 5 = 0 THEN 'place' ELSE '' END AS missing_vars
FROM benchmark"""
ORACLES["settings_overlay"] = _w(REQUESTS) + "SELECT req_id, coalesce(max_tokens, 4096) AS max_new_tokens FROM rq"
ORACLES["build_request"] = _w(MANIFEST) + """
SELECT id, CASE WHEN ok THEN CAST(2 AS BIGINT) END AS n_blocks,
  CASE WHEN ok THEN CASE WHEN sfx = '.pdf' THEN 'document' ELSE 'image' END END AS file_block_type,
  CASE sfx WHEN '.pdf' THEN 'application/pdf' WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg'
    WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' END AS media_type,
  CASE WHEN ok THEN 'text' END AS prompt_block_type, CASE WHEN ok THEN 1024 END AS max_tokens,
  CASE WHEN NOT ok THEN 'Unsupported file type ''' || sfx || '''' END AS error
FROM (SELECT *, sfx IN ('.pdf', '.jpg', '.jpeg', '.png', '.gif', '.webp') AS ok
  FROM (SELECT id, lower(regexp_extract("in", '[^/](\\.[^./]+)$', 1)) AS sfx FROM m))"""
ORACLES["experiment_grid"] = _w(MANIFEST) + """
SELECT m.id, g.model, g.prompt_version, 'cin_prompt_' || g.prompt_version || '_' || g.model || '_19700101_000000' AS run_name
FROM m CROSS JOIN (VALUES ('m0', 'v1'), ('m0', 'v2'), ('m1', 'v1'), ('m1', 'v2'), ('m2', 'v1'), ('m2', 'v2'))
  AS g(model, prompt_version)"""
ORACLES["model_pivot"] = _w(BASE) + (
    "SELECT ck AS case_key, "
    + ", ".join(
        f"round(avg(CASE WHEN model = '{m}' THEN execution_time END), 6) AS {m}_avg_time, "
        f"round(avg(CASE WHEN model = '{m}' THEN cf END), 6) AS {m}_avg_fields"
        for m in ("m0", "m1", "m2")
    )
    + " FROM s GROUP BY ck"
)

ORACLES["asset_facts"] = _w(ASSETS) + """
SELECT id, fmt AS format, CASE WHEN fmt IS NULL THEN NULL ELSE width END AS width,
  CASE WHEN fmt IS NULL THEN NULL ELSE height END AS height,
  CASE WHEN fmt IS NULL THEN NULL WHEN fmt = 'GIF' THEN 1
       WHEN fmt = 'WEBP' THEN CASE WHEN channels = 4 THEN 4 ELSE 3 END
       WHEN fmt = 'BMP' THEN CASE WHEN channels = 1 THEN 1 ELSE 3 END ELSE channels END AS bands
FROM (SELECT *, CASE upper(format) WHEN 'JPG' THEN 'JPEG' ELSE upper(format) END AS fmt FROM a)"""

# Files by their rule: 3 x 2 PNG, junk, PNG cut in its header, PNG of 2**32 - 1 columns, JPEG with fill
# bytes, GIF, 16-bit BMP of 11.4 MiB; headers after 70 kB decode to 231.7 MiB; the rest is missing.
ORACLES["upload_triage"] = """
SELECT id, status, error_class, status = 200 AS kept FROM (
  SELECT id, CASE c WHEN 'ok' THEN 200 WHEN 'not_found' THEN 404 ELSE 400 END AS status,
    CASE WHEN c <> 'ok' THEN c END AS error_class
  FROM (SELECT o_orderkey AS id, CASE
      WHEN o_orderkey % 64 IN (7, 15) THEN 'too_large'
      WHEN o_orderkey % 8 IN (0, 4) THEN 'ok' WHEN o_orderkey % 8 IN (1, 2) THEN 'invalid_image'
      WHEN o_orderkey % 8 IN (3, 6) THEN 'too_large' WHEN o_orderkey % 8 = 5 THEN 'unsupported_format'
      ELSE 'not_found' END AS c FROM orders))"""

# The literal files of the uploads: kind, header facts and length by the rule on the key. Facts are NULL where the
# header is cut.
ORACLES["asset_scan"] = """
WITH f AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 64 = 7 THEN 10 WHEN o_orderkey % 64 = 15 THEN 11 ELSE o_orderkey % 8 END AS c
  FROM orders
)
SELECT id,
  CASE WHEN c IN (0, 4) THEN 200 WHEN c = 7 THEN 404 ELSE 400 END AS status,
  CASE WHEN c IN (10, 11, 3, 6) THEN 'too_large' WHEN c IN (1, 2) THEN 'invalid_image' WHEN c = 5 THEN 'unsupported_format'
    WHEN c = 7 THEN 'not_found' END AS error_class,
  CASE WHEN c IN (0, 3) THEN 'PNG' WHEN c IN (4, 10) THEN 'JPEG' WHEN c = 11 THEN 'TIFF' WHEN c = 5 THEN 'GIF'
    WHEN c = 6 THEN 'BMP' END AS format,
  CAST(CASE c WHEN 0 THEN 3 WHEN 3 THEN 4294967295 WHEN 4 THEN 10 WHEN 10 THEN 9000 WHEN 11 THEN 9000 WHEN 5 THEN 10
    WHEN 6 THEN 2000 END AS BIGINT) AS width,
  CAST(CASE c WHEN 0 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 10 WHEN 10 THEN 9000 WHEN 11 THEN 9000 WHEN 5 THEN 10
    WHEN 6 THEN 2000 END AS BIGINT) AS height,
  CAST(CASE c WHEN 0 THEN 33 WHEN 1 THEN 27 WHEN 2 THEN 18 WHEN 3 THEN 33 WHEN 4 THEN 44 WHEN 5 THEN 18 WHEN 6 THEN 54
    WHEN 10 THEN 70563 WHEN 11 THEN 70050 END AS BIGINT) AS length,
  CASE WHEN c <> 7 THEN true END AS read_little
FROM f"""

ORACLES["missing_inputs"] = """
SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 8 = 7 AND o_orderkey % 64 NOT IN (7, 15)"""

ORACLES["judge_run"] = _w(BASE) + """
SELECT id, true AS success,
  CASE WHEN k % 29 = 0 THEN 'incorrect' WHEN k % 2 = 0 THEN 'correct' WHEN k % 13 = 0 THEN NULL ELSE 'correct' END
    AS judge_format,
  (k % 29 <> 0 AND k % 2 <> 0 AND k % 13 = 0) AS out_of_domain
FROM s"""
ORACLES["judge_fields_run"] = _w(BASE) + """
SELECT id, CASE WHEN k % 29 = 0 THEN 0.0 WHEN k % 13 = 0 THEN NULL WHEN k % 2 = 0 THEN 8.0 END AS fields_score,
  CASE WHEN k % 29 = 0 THEN NULL WHEN k % 13 = 0 THEN 'missing' WHEN k % 2 = 0 THEN NULL ELSE 'out_of_range' END AS fields_error
FROM s"""
ORACLES["fetch_assets"] = """
SELECT page_id, CASE WHEN length(url) % 7 = 0 THEN NULL WHEN length(url) % 5 = 0 THEN strlen(url) ELSE 33 END AS n_bytes,
  CASE WHEN length(url) % 7 = 0 THEN 'OSError: HTTP 404' END AS error
FROM pages"""
ORACLES["ocr_url"] = """
SELECT page_id, CASE c WHEN 'download_failed' THEN 422 WHEN 'invalid_image' THEN 400 WHEN 'processing_failed' THEN 500
    ELSE 200 END AS status,
  c AS error_class, CASE WHEN c IS NULL THEN 'image ' || CAST(n AS VARCHAR) || 'x3' ELSE '' END AS text
FROM (SELECT page_id, length(url) AS n, CASE WHEN length(url) % 7 = 0 THEN 'download_failed'
    WHEN length(url) % 5 = 0 THEN 'invalid_image' WHEN length(url) % 4 = 0 THEN 'processing_failed' END AS c FROM pages)"""
ORACLES["ocr_url_stream"] = ORACLES["ocr_url"]
# A file per page whose fetch gives anything: a PNG as wide as its URL is long, or no image.
ORACLES["ocr_upload_stream"] = """
SELECT page_id, CASE WHEN n % 5 = 0 THEN 400 ELSE 200 END AS status, CASE WHEN n % 5 <> 0 THEN 'PNG' END AS format,
  n % 5 <> 0 AS success, CASE WHEN n % 5 = 0 THEN 'invalid_image' END AS error,
  CASE WHEN n % 5 <> 0 THEN 'image ' || CAST(n AS VARCHAR) || 'x3' ELSE '' END AS text
FROM (SELECT page_id, length(url) AS n FROM pages) WHERE n % 7 <> 0"""
_OUTLINE = (
    f"'## Summary' || {NL} || string_agg('### ' || field || ': ' || verdict || ' (' || CAST(n AS VARCHAR) || ')', {NL} "
    "ORDER BY n DESC, field, verdict)"
)
ORACLES["mistake_summary"] = _w(BASE, VERDICTS) + f"""
SELECT model, 'correct_fields' AS metric, true AS success, {_OUTLINE} AS summary
FROM (SELECT model, field, verdict, count(*) AS n FROM fv WHERE verdict <> 'correct' GROUP BY 1, 2, 3) GROUP BY model
UNION ALL
SELECT model, 'format_compliance', true, {_OUTLINE}
FROM (SELECT model, CASE WHEN k % 29 = 0 THEN 'format' ELSE 'nom' END AS field,
    CASE WHEN k % 29 = 0 THEN 'not a JSON object' ELSE 'missing' END AS verdict, count(*) AS n
  FROM s WHERE k % 29 = 0 OR k % 17 = 0 GROUP BY 1, 2, 3) GROUP BY model"""
# Per row one mistake, or three: nom is missing, two keys are extra. Above a hundred different lines there are parts.
_KEPT = "model IN ('m0', 'm1') AND k % 19 <> 0 AND k % 3 IN (0, 1) AND k % 47 <> 0 AND ts >= TIMESTAMP '1995-06-01' AND ts <= TIMESTAMP '1999-01-01'"
ORACLES["mistake_summary_filtered"] = _w(BASE, VERDICTS) + f"""
SELECT 'correct_fields' AS metric, true AS success, {_OUTLINE} AS summary
FROM (SELECT field, verdict, count(*) AS n FROM fv WHERE verdict <> 'correct' AND id IN (SELECT id FROM s WHERE {_KEPT}) GROUP BY 1, 2)
UNION ALL
SELECT 'format_compliance', true, {_OUTLINE}
FROM (SELECT CASE WHEN k % 29 = 0 THEN 'format' ELSE 'nom' END AS field,
    CASE WHEN k % 29 = 0 THEN 'not a JSON object' ELSE 'missing' END AS verdict, count(*) AS n
  FROM s WHERE (k % 29 = 0 OR k % 17 = 0) AND {_KEPT} GROUP BY 1, 2)"""
ORACLES["mistake_summary_levels"] = _w(BASE) + """
SELECT model, 'format_compliance' AS metric, true AS success,
  '- all: counted (' || CAST(sum(CASE WHEN k % 29 = 0 THEN 1 ELSE 3 END) AS VARCHAR) || ')' AS summary,
  count(DISTINCT CASE WHEN k % 29 <> 0 THEN k % 3001 END) + 3 > 100 AS in_parts
FROM s GROUP BY model"""
ORACLES["summary_status"] = _w(BASE) + """
SELECT 'correct_fields' AS metric, count(*) AS n_reasons, CAST(NULL AS VARCHAR) AS message FROM s
UNION ALL SELECT 'format_compliance', count(*) FILTER (k % 29 = 0 OR k % 17 = 0),
  CASE WHEN count(*) FILTER (k % 29 = 0 OR k % 17 = 0) = 0 THEN 'No reasons available to summarize.' END FROM s"""
ORACLES["table_page_at"] = _w(BASE) + """
SELECT page, id, CAST(ts AS VARCHAR) AS "timestamp", model FROM (
  SELECT (row_number() OVER (ORDER BY ts DESC NULLS LAST, id) - 1) // 25 AS page, (count(*) OVER () + 24) // 25 - 1 AS last, id, ts, model
  FROM s) WHERE page IN (0, last // 2, last)"""
ORACLES["table_page_after"] = _w(BASE) + """
SELECT id, CAST(ts AS VARCHAR) AS "timestamp", model FROM s
WHERE ts IS NULL OR ts < TIMESTAMP '1996-01-01' OR (ts = TIMESTAMP '1996-01-01' AND id > 0)
ORDER BY ts DESC NULLS LAST, id LIMIT 25"""


# Python stages whose output columns are deterministic (no wall-clock column): the test
# backends' answers written out as SQL.
# LayoutReaderBackend reads a page's words back: the page text is its 20 source lines.
ORACLES["infer_ocr"] = _w(PAGES) + f"""
SELECT doc_id, CAST(p + 1 AS BIGINT) AS page_no, 'layout-reader' AS model_id, true AS success,
  md5(array_to_string(pl, {NL})) AS text_md5 FROM pg"""
# EchoTextBackend: an empty prompt is an error row; otherwise the prompt, then
# "\n  answer: <words> words (max <limit>)  " with Python's whitespace word count.
WORDS = ("CASE WHEN regexp_matches(prompt, '^[\\s\\v]*$') THEN 0 ELSE len(string_split_regex("
         "regexp_replace(prompt, '^[\\s\\v]+|[\\s\\v]+$', '', 'g'), '[\\s\\v]+')) END")
ORACLES["infer_device"] = _w(REQUESTS) + """
SELECT req_id, CASE WHEN req_id % 1000 % 3 = 0 THEN 'cuda:' || CAST(req_id % 1000 % 2 AS VARCHAR) ELSE 'cpu' END AS device,
  coalesce(prompt <> '', false) AS success
FROM rq"""
ORACLES["text_sink"] = """
SELECT doc_id, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, '')) AS n_chars FROM documents"""
ORACLES["infer_stream"] = _w(REQUESTS) + f"""
SELECT req_id, 'echo-text' AS model_id,
  coalesce(prompt <> '', false) AS success,
  CASE WHEN prompt IS NULL OR prompt = '' THEN 'ValueError: empty prompt' END AS error,
  CAST(CASE WHEN prompt IS NULL OR prompt = '' THEN 0
       ELSE length(prompt || {NL} || '  answer: ' || CAST({WORDS} AS VARCHAR) || ' words (max '
                   || CAST(coalesce(max_tokens, 4096) AS VARCHAR) || ')  ') END AS BIGINT) AS n_chars
FROM rq"""

ORACLES["infer_text"] = _w(REQUESTS) + f"""
SELECT req_id, 'echo-text' AS model_id, coalesce(prompt <> '', false) AS success,
  CASE WHEN prompt IS NULL OR prompt = '' THEN 'ValueError: empty prompt' END AS error,
  CASE WHEN prompt IS NULL OR prompt = '' THEN ''
       ELSE 'answer: ' || CAST({WORDS} AS VARCHAR) || ' words (max ' || CAST(coalesce(max_tokens, 4096) AS VARCHAR) || ')' END
    AS answer,
  true AS timed
FROM rq"""

# The evaluation job with the card-reading test client: "reader-exact" copies every printed
# field; "reader-sloppy" skips initiales and writes dates with '/'. Blank scans (k % 29 = 0)
# get a refusal; prompt v1 answers are fenced.
SLOPPY = {
    "initiales": "'missing'",
    "date_naissance": "'mismatch'",
    "date_expiration": "CASE WHEN t_de = '' THEN 'correct' ELSE 'mismatch' END",
}
EVAL_REASON = " || ', ' || ".join(
    f"'{f}=' || CASE WHEN k % 29 = 0 THEN 'missing' WHEN r.model = 'reader-sloppy' THEN {SLOPPY.get(f, repr('correct'))} "
    "ELSE 'correct' END"
    for f in FIELDS
)
ORACLES["evaluation_run"] = _w(BASE) + f"""
SELECT k AS id, r.model, r.prompt_version, tags,
  CASE WHEN k % 29 = 0 THEN 0.0 WHEN r.model = 'reader-exact' THEN 8.0
       ELSE 6.0 - CASE WHEN t_de = '' THEN 0 ELSE 1 END END::DOUBLE AS correct_fields,
  CASE WHEN k % 29 <> 0 AND r.model = 'reader-exact' THEN 'correct' ELSE 'incorrect' END AS format_compliance,
  {EVAL_REASON} AS correct_fields_reason,
  CASE WHEN k % 29 = 0 THEN 'not a JSON object' WHEN r.model = 'reader-sloppy' THEN 'missing: initiales; extra: '
       ELSE '' END AS format_compliance_reason,
  true AS success,
  k % 29 <> 0 AND r.prompt_version = 'v1' AS fenced
FROM s CROSS JOIN (VALUES ('reader-exact', 'v1'), ('reader-exact', 'v2'), ('reader-sloppy', 'v1'),
                          ('reader-sloppy', 'v2')) AS r(model, prompt_version)"""

ORACLES["evaluation_resume"] = _w(BASE) + f"""
SELECT k AS id, r.model, r.prompt_version,
  CASE WHEN k % 29 <> 0 AND t_ini = '' THEN 2 ELSE 1 END AS attempt,
  CASE WHEN k % 29 = 0 THEN 0.0 WHEN r.model = 'reader-exact' THEN 8.0
       ELSE 6.0 - CASE WHEN t_de = '' THEN 0 ELSE 1 END END::DOUBLE AS correct_fields,
  true AS success,
  CAST(CASE WHEN k % 29 <> 0 AND t_ini = '' THEN 2 ELSE 1 END AS BIGINT) AS n_calls
FROM s CROSS JOIN (VALUES ('reader-exact', 'v1'), ('reader-exact', 'v2'), ('reader-sloppy', 'v1'),
                          ('reader-sloppy', 'v2')) AS r(model, prompt_version)"""

# Python's json.dumps(indent=2, ensure_ascii=False) of an unfenced answer, written out: "{",
# one '  "key": "value"' line per key in document order, "}". Fenced answers do not parse and
# come back as they are, and so does the refusal text.
_PRETTY_ITEMS = [
    ("prenom", "c_name"),
    ("nom", "CASE WHEN k % 17 = 0 THEN NULL ELSE c_mktsegment END"),
    ("id_document_recto", "t_id"),
    ("date_naissance", "CASE WHEN k % 11 = 0 THEN replace(t_dn, '.', '/') ELSE t_dn END"),
    ("lieu_naissance", "CASE WHEN k % 13 = 0 THEN 'CASABLANCA' ELSE n_name END"),
    ("initiales", "CASE WHEN k % 7 = 0 THEN 'XX' ELSE t_ini END"),
    ("date_expiration", "t_de"),
    ("nationalite", "'Marocaine'"),
]
PRETTY_TEXT = (
    f"'{{' || {NL} || concat_ws(',' || {NL}, "
    + ", ".join(f"'  \"{f}\": \"' || ({v}) || '\"'" for f, v in _PRETTY_ITEMS)
    + f") || {NL} || '}}'"
)
ORACLES["pretty_json"] = _w(BASE) + f"""
SELECT id, CASE WHEN k % 29 = 0 THEN 'I cannot read this image.' WHEN k % 2 = 0 THEN ({GENERATED_TEXT})
  ELSE {PRETTY_TEXT} END AS generated_pretty
FROM s"""

_TRUTH_ITEMS = [
    ("prenom", "c_name"),
    ("nom", "c_mktsegment"),
    ("id_document_recto", "t_id"),
    ("date_naissance", "t_dn"),
    ("lieu_naissance", "n_name"),
    ("initiales", "t_ini"),
    ("date_expiration", "t_de"),
    ("nationalite", "'Marocaine'"),
]
PRETTY_EXPECTED = (
    f"'{{' || {NL} || concat_ws(',' || {NL}, "
    + ", ".join(f"'  \"{f}\": \"' || ({v}) || '\"'" for f, v in _TRUTH_ITEMS)
    + f") || {NL} || '}}'"
)
# The first results page (newest first, ties by id), each row with its header line, reason and
# both JSON texts pretty-printed.
ORACLES["row_detail"] = _w(BASE) + f"""
SELECT id,
  'id: ' || CAST(id AS VARCHAR) || '  |  doc: ' || doc || '  |  model: ' || model || '  |  correct_fields: '
    || CAST(cf AS VARCHAR) AS header,
  """ + " || ', ' || ".join(f"'{f}=' || v_{f}" for f in FIELDS) + f""" AS correct_fields_reason,
  CASE WHEN k % 29 = 0 THEN 'not a JSON object' WHEN k % 17 = 0 THEN 'missing: nom; extra: ' ELSE '' END
    AS format_compliance_reason,
  {PRETTY_EXPECTED} AS expected_pretty,
  CASE WHEN k % 29 = 0 THEN 'I cannot read this image.' WHEN k % 2 = 0 THEN ({GENERATED_TEXT})
    ELSE {PRETTY_TEXT} END AS generated_pretty
FROM s ORDER BY ts DESC NULLS LAST, id LIMIT 25"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
