"""Queries over the corpus build, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import caseref, dates, textops
from ..operators import corpus
from ..sources import tables as T
from ..sources.stages import scratch
from .adapters import JUDGMENTS_SQL, MIN_CHARS, TODAY, judgments, table

BUILD = corpus.Build(today=TODAY, min_chars=MIN_CHARS)
S = r"\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '{CTRL}', ' ', 'g'), '[{S}]+', ' ', 'g'))"


def sql_count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def sql_date(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({sql_strip(x)}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') "
        f"THEN TRY_CAST(substring({sql_strip(x)}, 1, 10) AS DATE) END"
    )


def sql_status(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR {sql_strip(x)} = '' THEN 'missing' WHEN {sql_date(x)} IS NULL THEN 'unparseable' "
        f"WHEN year({sql_date(x)}) < 1862 OR {sql_date(x)} > DATE '{TODAY}' THEN 'implausible' ELSE 'ok' END"
    )


_CNR_DATE = "CASE WHEN len(string_split(cnr, '_')) >= 3 THEN string_split(cnr, '_')[3] END"
#: Stages of the build as common table expressions; ``b`` has every record with its outcome.
BUILD_SQL = f"""
WITH {JUDGMENTS_SQL},
s AS (SELECT * REPLACE (nullif({sql_strip('cnr')}, '') AS cnr),
        coalesce(source_config <> 'high_courts' OR court_code = '27_1', false) AS selected FROM j),
c AS (SELECT *, selected AND cnr IS NOT NULL AND d = min(d) FILTER (selected) OVER (PARTITION BY cnr) AS first_cnr FROM s),
t AS (SELECT *, {sql_clean('full_text')} AS text,
        selected AND cnr IS NOT NULL AND first_cnr AND coalesce({sql_strip('full_text')}, '') <> '' AS has_text,
        coalesce({sql_count('full_text', CTRL)} / greatest(length(full_text), 1) > 0.01 OR length(full_text) = 0, true) AS bad,
        {_CNR_DATE} AS cnr_date FROM c),
u AS (SELECT *, length(text) >= {MIN_CHARS} AS in_search_index,
        {sql_status('decision_date')} AS decision_date_status, {sql_status('cnr_date')} AS cnr_date_status,
        {sql_date('decision_date')} AS dd, {sql_date('cnr_date')} AS cd,
        sha1(substring(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '', 'g')), 1, 2000)) AS print FROM t),
v AS (SELECT *, CASE WHEN decision_date_status = 'ok' THEN dd END AS a, CASE WHEN cnr_date_status = 'ok' THEN cd END AS z,
        has_text AND NOT bad AND in_search_index AS candidate FROM u),
w AS (SELECT *, candidate AND d <> min(d) FILTER (candidate) OVER (PARTITION BY print) AS near,
        CAST(coalesce(a, z) AS VARCHAR) AS judgment_date,
        CASE WHEN a IS NOT NULL THEN 'decision_date' WHEN z IS NOT NULL THEN 'cnr' END AS date_source,
        coalesce(a <> z, false) AS date_conflict, coalesce(year(a) <> year(z), false) AS year_conflict,
        arg_min(cnr, d) FILTER (candidate) OVER (PARTITION BY print) AS winner FROM v),
b AS (SELECT *, CASE WHEN NOT selected THEN 'court_not_selected' WHEN cnr IS NULL THEN 'missing_cnr'
        WHEN NOT first_cnr THEN 'duplicate_cnr' WHEN NOT has_text THEN 'empty_text' WHEN bad THEN 'corrupted_text'
        WHEN near THEN 'near_duplicate' WHEN in_search_index THEN 'kept_search' ELSE 'kept_lookup_only' END AS outcome_label FROM w)
"""
_BENCHES = ", ".join(f"('{a}', '{b}', '{c}', {str(x).lower()})" for a, b, c, x in caseref.BENCHES)
_NUM = r"\s*/\s*(\d{1,7})\s*/\s*((?:18|19|20)\d{2})(?:\D|$)"
_LEAD = r"^\s*([A-Z][A-Z.&\-]*(?:\s+[A-Z][A-Z.&\-]*){0,2}(?:\s*\([A-Za-z]{1,6}\))?)" + _NUM
_ANY = r"(?:^|[^A-Za-z0-9])([A-Za-z][A-Za-z.&\-]*(?:\s*\([A-Za-z]{1,6}\))?)" + _NUM


def _ref(group: int) -> str:
    t = "coalesce(title, '')"
    return (
        f"CASE WHEN regexp_matches({t}, '{_LEAD}') THEN regexp_extract({t}, '{_LEAD}', {group}) "
        f"ELSE regexp_extract({t}, '{_ANY}', {group}) END"
    )


_TYPES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in caseref.CASE_TYPES.items()) + "}"
#: ``r`` has the output fields of the kept records.
ROWS_SQL = BUILD_SQL + f""",
bn AS (SELECT * FROM (VALUES {_BENCHES}) AS t(code, name, prefix, inferred)),
k AS (SELECT b.* EXCLUDE (bench, title), nullif({sql_strip('bench')}, '') AS bench, nullif({sql_strip('title')}, '') AS title,
        source_config = 'supreme_court' AS sc FROM b WHERE outcome_label LIKE 'kept%'),
k2 AS (SELECT *, regexp_replace(upper({_ref(1)}), '[^A-Z()]', '', 'g') AS code0, {_ref(2)} AS num0, {_ref(3)} AS yr0 FROM k),
k3 AS (SELECT *, nullif(code0, '') AS case_type_code FROM k2),
r AS (SELECT k3.cnr, source_config, coalesce(nullif({sql_strip('court_code')}, ''), CASE WHEN sc THEN 'SC' END) AS court_code,
  CASE WHEN sc THEN 'Supreme Court of India' ELSE 'Bombay High Court' END AS court_name, bench,
  CASE WHEN x.code IS NOT NULL THEN x.name WHEN sc THEN 'Supreme Court of India'
    ELSE coalesce(p.name, CASE WHEN bench IS NULL THEN 'Unknown' ELSE 'Unknown (' || bench || ')' END) END AS bench_name,
  CASE WHEN x.code IS NOT NULL THEN x.inferred WHEN sc THEN false ELSE p.name IS NOT NULL END AS bench_name_inferred,
  title, nullif(petitioner, '') AS petitioner, nullif(respondent, '') AS respondent, nullif(judge, '') AS judge,
  judgment_date, coalesce(TRY_CAST(substring(judgment_date, 1, 4) AS INTEGER), year) AS judgment_year, date_source,
  nullif({sql_strip('decision_date')}, '') AS decision_date_raw, cnr_date AS cnr_date_raw, decision_date_status, cnr_date_status,
  date_conflict, year_conflict, coalesce(nullif({sql_strip('case_type')}, ''), case_type_code) AS case_type,
  CASE WHEN nullif({sql_strip('case_type')}, '') IS NOT NULL THEN 'dataset' WHEN case_type_code IS NOT NULL THEN 'title' ELSE 'none' END AS case_type_source,
  case_type_code, CASE WHEN NOT sc THEN {_TYPES}[regexp_replace(case_type_code, '\\(.*\\)$', '')] END AS case_type_name,
  CASE WHEN case_type_code IS NOT NULL THEN num0 END AS case_number, CASE WHEN case_type_code IS NOT NULL THEN yr0 END AS case_year,
  nullif(disposal_nature_normalized, '') AS outcome, length(full_text) AS raw_chars, length(text) AS clean_chars,
  CAST(0 AS BIGINT) AS repeat_chars_removed, in_search_index, text,
  x.code IS NOT NULL AS bench_known, x.code IS NOT NULL AND NOT starts_with(k3.cnr, x.prefix) AS mismatch, sc, d
  FROM k3 LEFT JOIN bn x ON x.code = k3.bench LEFT JOIN bn p ON p.prefix = substring(k3.cnr, 1, 6))
"""


def labelled(spark, sf_dir):
    return corpus.label_records(judgments(spark, sf_dir), BUILD)


def rows(spark, sf_dir):
    return corpus.build_rows(labelled(spark, sf_dir), BUILD)


def links(spark, sf_dir):
    return corpus.build_corpus(judgments(spark, sf_dir), BUILD)[1]


def read_back(spark, sf_dir):
    """Records in two folders, read by a folder and a glob of files; one wanted column is in none of them."""
    folder = scratch(spark)
    for k in range(2):
        judgments(spark, sf_dir).where(F.col("d") % 2 == k).write.parquet(f"{folder}/{k}")
    return T.read_judgments(spark, f"{folder}/0", f"{folder}/1/*.parquet", schema=f"d long, outcome string, {T.RECORD}")


QUERIES = {
    "src1_read_judgments": lambda s, d: read_back(s, d).select("d", "cnr", "bench", "title", "decision_date", "outcome", F.sha1("full_text").alias("text_sha1")),
    "src2_select_court": lambda s, d: judgments(s, d)
    .withColumn("kept", corpus.selected(BUILD))
    .groupBy("source_config")
    .agg(F.count(F.lit(1)).alias("scanned"), F.count_if(~F.col("kept")).alias("court_not_selected")),
    "src4_cap_rows": lambda s, d: T.cap_rows(judgments(s, d).where("court_code = '27_1'"), 100, "d").select("d", "cnr"),
    "flt1_drop_missing_cnr": lambda s, d: judgments(s, d).where(textops.blank_to_null("cnr").isNotNull()).select("d", "cnr"),
    "flt2_drop_empty_text": lambda s, d: judgments(s, d).where(F.coalesce(textops.strip("full_text"), F.lit("")) != "").select("d"),
    "flt3_drop_corrupted": lambda s, d: judgments(s, d).where(~textops.is_corrupted("full_text")).select("d", textops.control_count("full_text").cast("long").alias("controls")),
    "flt4_route_by_length": lambda s, d: judgments(s, d).select("d", F.when(F.char_length(textops.clean_text("full_text")) >= MIN_CHARS, "search").otherwise("lookup_only").alias("route")),
    "flt5_require_date": lambda s, d: corpus.label_records(judgments(s, d), corpus.Build(today=TODAY, min_chars=MIN_CHARS, require_date=True, date_rule="agree_only")).where("outcome_label = 'no_valid_date'").select("d"),
    "flt6_drop_reason": lambda s, d: labelled(s, d).select("d", F.col("outcome_label").alias("outcome"), "duplicate_of"),
    "prj1_build_row": lambda s, d: rows(s, d).select(*[c for c in corpus.OUTPUT if c != "text"], F.sha1("text").alias("text_sha1")),
    "prj2_date_disagreement_rows": lambda s, d: rows(s, d).where("date_conflict").select("cnr", "decision_date_raw", "cnr_date_raw", "judgment_date", textops.snippet("text", 400).alias("text_start")),
    "jon11_bench_names": lambda s, d: rows(s, d).select("cnr", "bench", "bench_name", "bench_name_inferred", "bench_known", F.col("bench_prefix_mismatch").alias("mismatch")),
    "jon12_case_type_names": lambda s, d: rows(s, d).select("cnr", "case_type_code", "case_type_name"),
    "jon14_resolve_cnr": lambda s, d: corpus.resolve_cnr(labelled(s, d).where("cnr IS NOT NULL AND outcome_label IN ('near_duplicate', 'kept_search')").select("d", "cnr"), links(s, d)).select("d", "resolved_cnr"),
    "win1_first_cnr": lambda s, d: corpus.first_of(judgments(s, d).withColumn("k", textops.blank_to_null("cnr")), "k", ["d"], "is_first").where("is_first").select("d", "cnr"),
    "win2_first_fingerprint": lambda s, d: links(s, d),
    "agg1_outcome_counts": lambda s, d: corpus.outcome_counts(labelled(s, d)),
    "agg1_identity": lambda s, d: corpus.identity_check(labelled(s, d)),
    "agg2_kept_date_stats": lambda s, d: corpus.kept_date_stats(rows(s, d)),
    "agg3_kept_meta_stats": lambda s, d: corpus.kept_meta_stats(rows(s, d)),
    "agg4_unmapped_codes_top": lambda s, d: corpus.unmapped_codes(rows(s, d)),
    "agg5_build_rates": lambda s, d: corpus.build_rates(labelled(s, d)).select(F.round("near_duplicate_rate", 6).alias("near_duplicate_rate"), F.round("date_conflict_rate", 6).alias("date_conflict_rate")),
    "set1_union_sources": lambda s, d: corpus.union_sources(judgments(s, d).where("source_config = 'high_courts'"), judgments(s, d).where("source_config = 'supreme_court'").drop("bench")).groupBy("source_rank").agg(F.count(F.lit(1)).alias("n"), F.count("bench").alias("benches"), F.min("d").alias("first_d")),
    "set2_union_corpus": lambda s, d: (lambda r: r.where("in_search_index").select("cnr", "clean_chars").unionByName(r.where("NOT in_search_index").select("cnr", "clean_chars")))(rows(s, d)),
    "scl1_clean_text": lambda s, d: judgments(s, d).select("d", F.sha1(textops.clean_text("full_text")).alias("h")),
    "scl2_normalize_keep_paragraphs": lambda s, d: judgments(s, d).select("d", F.sha1(textops.normalize_keep_paragraphs("full_text")).alias("h")),
    "scl3_control_stats": lambda s, d: judgments(s, d).select("d", textops.control_stats("full_text").alias("x")).select("d", *[F.col(f"x.{c}").cast("long").alias(c) for c in ("length", "control_count", "replacement_count", "newline_count")]),
    "scl4_caesar_decode": lambda s, d: table(s, d, "documents").select("doc_id", F.sha1(textops.caesar_decode("text")).alias("h")),
    "scl5_extract_court": lambda s, d: table(s, d, "documents").select("doc_id", textops.extract_court(F.concat(F.lit("IN THE HIGH COURT OF "), F.upper("lang"), F.lit(" 1\n"), F.col("text"))).alias("court")),
    "scl6_parse_case_reference": lambda s, d: judgments(s, d).select("d", caseref.parse_case_reference("title").alias("r")).select("d", "r.code", "r.number", "r.year"),
    "scl7_case_type": lambda s, d: rows(s, d).select("cnr", "case_type", "case_type_source"),
    "scl9_fingerprint": lambda s, d: judgments(s, d).select("d", textops.fingerprint(textops.clean_text("full_text")).alias("prefix"), textops.fingerprint(textops.clean_text("full_text"), "exact").alias("exact")),
    "scl10_parse_iso_date": lambda s, d: judgments(s, d).select("d", dates.parse_iso_date("decision_date").cast("string").alias("day")),
    "scl11_cnr_date_text": lambda s, d: judgments(s, d).select("d", dates.cnr_date_text("cnr").alias("part")),
    "scl12_date_status": lambda s, d: judgments(s, d).select("d", dates.date_status("decision_date", TODAY).alias("decided"), dates.date_status(dates.cnr_date_text("cnr"), TODAY).alias("inside")),
    "scl13_resolve_date": lambda s, d: judgments(s, d).select("d", *[dates.resolve_date("decision_date", "cnr", TODAY, r)["judgment_date"].alias(r) for r in dates.RULES], *[dates.resolve_date("decision_date", "cnr", TODAY, r)["date_source"].alias(f"{r}_source") for r in dates.RULES]),
    "scl14_judgment_year": lambda s, d: rows(s, d).select("cnr", "judgment_year"),
    "scl18_tokenize": lambda s, d: table(s, d, "documents").select("doc_id", textops.tokenize("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.sha1(F.array_join("t", " ")).alias("h")),
    "scl19_tokenize_references": lambda s, d: table(s, d, "documents").select("doc_id", textops.tokenize_references(F.concat("text", F.lit(" WP/12/2015 a.b-c"))).alias("t"), textops.tokenize_spaces("text").alias("u")).select("doc_id", F.size("t").cast("long").alias("n"), F.sha1(F.array_join("t", " ")).alias("h"), F.size("u").cast("long").alias("n_spaces")),
    "scl20_normalize_match": lambda s, d: table(s, d, "documents").select("doc_id", F.sha1(textops.normalize_match("text")).alias("h"), F.sha1(textops.normalize_match("text", False)).alias("kept")),
}

_W = r"[\p{L}\p{N}_]+"
_MATCH = f"trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_{S}]', ' ', 'g'), '[{S}]+', ' ', 'g'))"
_DATES = f"""
WITH {JUDGMENTS_SQL}, x AS (SELECT d, {sql_status('decision_date')} AS s1, {sql_date('decision_date')} AS d1, cnr_date,
  {sql_status('cnr_date')} AS s2, {sql_date('cnr_date')} AS d2 FROM (SELECT *, {_CNR_DATE} AS cnr_date FROM j) AS q),
y AS (SELECT d, s1, s2, CASE WHEN s1 = 'ok' THEN d1 END AS a, CASE WHEN s2 = 'ok' THEN d2 END AS z FROM x)
"""
_J = f"WITH {JUDGMENTS_SQL} "
_PARAGRAPHS = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(full_text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), "
    r"'[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
)
SQL = {
    "src1_read_judgments": _J + "SELECT d, cnr, bench, title, decision_date, CAST(NULL AS VARCHAR) AS outcome, sha1(full_text) AS text_sha1 FROM j",
    "src2_select_court": _J + "SELECT source_config, count(*) AS scanned, count(*) FILTER (source_config = 'high_courts' AND court_code <> '27_1') AS court_not_selected FROM j GROUP BY 1",
    "src4_cap_rows": _J + "SELECT d, cnr FROM j WHERE court_code = '27_1' ORDER BY d LIMIT 100",
    "flt1_drop_missing_cnr": _J + "SELECT d, cnr FROM j WHERE trim(cnr) <> ''",
    "flt2_drop_empty_text": _J + f"SELECT d FROM j WHERE coalesce({sql_strip('full_text')}, '') <> ''",
    "flt3_drop_corrupted": _J + f"SELECT d, {sql_count('full_text', CTRL)} AS controls FROM j WHERE length(full_text) > 0 AND {sql_count('full_text', CTRL)} / length(full_text) <= 0.01",
    "flt4_route_by_length": _J + f"SELECT d, CASE WHEN length({sql_clean('full_text')}) >= {MIN_CHARS} THEN 'search' ELSE 'lookup_only' END AS route FROM j",
    "flt5_require_date": BUILD_SQL + "SELECT d FROM b WHERE has_text AND NOT bad AND in_search_index AND (a IS NULL OR z IS NULL OR a <> z)",
    "flt6_drop_reason": BUILD_SQL + "SELECT d, outcome_label AS outcome, CASE WHEN outcome_label = 'near_duplicate' THEN winner END AS duplicate_of FROM b",
    "prj1_build_row": ROWS_SQL + "SELECT " + ", ".join(c for c in corpus.OUTPUT if c != "text") + ", sha1(text) AS text_sha1 FROM r",
    "prj2_date_disagreement_rows": ROWS_SQL + f"SELECT cnr, decision_date_raw, cnr_date_raw, judgment_date, trim(regexp_replace(substring(text, 1, 400), '[{S}]+', ' ', 'g')) AS text_start FROM r WHERE date_conflict",
    "jon11_bench_names": ROWS_SQL + "SELECT cnr, bench, bench_name, bench_name_inferred, bench_known, mismatch FROM r",
    "jon12_case_type_names": ROWS_SQL + "SELECT cnr, case_type_code, case_type_name FROM r",
    "jon14_resolve_cnr": BUILD_SQL + "SELECT d, CASE WHEN outcome_label = 'near_duplicate' THEN winner ELSE cnr END AS resolved_cnr FROM b WHERE outcome_label IN ('near_duplicate', 'kept_search')",
    "win1_first_cnr": _J + "SELECT d, cnr FROM (SELECT d, cnr, row_number() OVER (PARTITION BY cnr ORDER BY d) AS n FROM j WHERE trim(cnr) <> '') WHERE n = 1",
    "win2_first_fingerprint": BUILD_SQL + "SELECT cnr AS duplicate_cnr, winner AS kept_cnr, source_config FROM b WHERE outcome_label = 'near_duplicate'",
    "agg1_outcome_counts": BUILD_SQL + ", o AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in (*corpus.DROP_REASONS, *corpus.KEPT)) + "]) AS outcome), g AS (SELECT unnest(['high_courts', 'supreme_court', 'all']) AS source_config) SELECT g.source_config, o.outcome, count(b.d) AS n FROM g CROSS JOIN o LEFT JOIN b ON b.outcome_label = o.outcome AND (g.source_config = 'all' OR b.source_config = g.source_config) GROUP BY 1, 2",
    "agg1_identity": BUILD_SQL + "SELECT source_config, count(*) AS scanned, count(*) FILTER (outcome_label NOT LIKE 'kept%') AS dropped, count(*) FILTER (outcome_label LIKE 'kept%') AS kept FROM b GROUP BY 1",
    "agg2_kept_date_stats": ROWS_SQL + "SELECT 'decision_date_status' AS measure, decision_date_status AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'cnr_date_status', cnr_date_status, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'date_source', coalesce(date_source, 'none'), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'date_conflict', CAST(date_conflict AS VARCHAR), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'year_conflict', CAST(year_conflict AS VARCHAR), count(*) FROM r GROUP BY 2",
    "agg3_kept_meta_stats": ROWS_SQL + "SELECT 'unknown_bench' AS measure, coalesce(bench, '(blank)') AS value, count(*) AS n FROM r WHERE NOT bench_known AND NOT sc GROUP BY 2 UNION ALL SELECT 'bench_prefix_mismatch', 'true', count(*) FROM r WHERE mismatch HAVING count(*) > 0 UNION ALL SELECT 'case_type_source', case_type_source, count(*) FROM r GROUP BY 2",
    "agg4_unmapped_codes_top": ROWS_SQL + "SELECT regexp_replace(case_type_code, '\\(.*\\)$', '') AS code, count(*) AS n FROM r WHERE NOT sc AND case_type_code IS NOT NULL AND case_type_name IS NULL GROUP BY 1 ORDER BY n DESC, code LIMIT 25",
    "agg5_build_rates": BUILD_SQL + "SELECT round(count(*) FILTER (outcome_label = 'near_duplicate') / nullif(count(*) FILTER (outcome_label IN ('near_duplicate', 'kept_search')), 0), 6) AS near_duplicate_rate, round(count(*) FILTER (outcome_label LIKE 'kept%' AND date_conflict) / nullif(count(*) FILTER (outcome_label LIKE 'kept%'), 0), 6) AS date_conflict_rate FROM b",
    "set1_union_sources": _J + "SELECT CAST(source_config = 'supreme_court' AS INTEGER) AS source_rank, count(*) AS n, count(CASE WHEN source_config = 'high_courts' THEN bench END) AS benches, min(d) AS first_d FROM j GROUP BY 1",
    "set2_union_corpus": ROWS_SQL + "SELECT cnr, clean_chars FROM r WHERE in_search_index UNION ALL SELECT cnr, clean_chars FROM r WHERE NOT in_search_index",
    "scl1_clean_text": _J + f"SELECT d, sha1({sql_clean('full_text')}) AS h FROM j",
    "scl2_normalize_keep_paragraphs": _J + f"SELECT d, sha1({sql_strip(_PARAGRAPHS)}) AS h FROM j",
    "scl3_control_stats": _J + f"SELECT d, length(full_text) AS length, {sql_count('full_text', CTRL)} AS control_count, {sql_count('full_text', chr(92) + 'x{FFFD}')} AS replacement_count, {sql_count('full_text', chr(92) + 'n')} AS newline_count FROM j",
    "scl4_caesar_decode": "SELECT doc_id, sha1(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'XYZABCDEFGHIJKLMNOPQRSTUVWxyzabcdefghijklmnopqrstuvw')) AS h FROM documents",
    "scl5_extract_court": r"SELECT doc_id, coalesce(nullif(trim(regexp_extract(substring(t, 1, 1500), 'IN THE (?:HIGH COURT|HIGH COURT OF) ([A-Z][A-Z ]+)', 1)), ''), 'UNKNOWN') AS court FROM (SELECT doc_id, 'IN THE HIGH COURT OF ' || upper(lang) || ' 1' || chr(10) || text AS t FROM documents)",
    "scl6_parse_case_reference": _J + f"SELECT d, nullif(code0, '') AS code, CASE WHEN code0 <> '' THEN num0 END AS number, CASE WHEN code0 <> '' THEN yr0 END AS year FROM (SELECT d, regexp_replace(upper({_ref(1)}), '[^A-Z()]', '', 'g') AS code0, {_ref(2)} AS num0, {_ref(3)} AS yr0 FROM j)",
    "scl7_case_type": ROWS_SQL + "SELECT cnr, case_type, case_type_source FROM r",
    "scl9_fingerprint": _J + f", x AS (SELECT d, lower(regexp_replace({sql_clean('full_text')}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS t FROM j) SELECT d, sha1(substring(t, 1, 2000)) AS prefix, sha1(t) AS exact FROM x",
    "scl10_parse_iso_date": _J + f"SELECT d, CAST({sql_date('decision_date')} AS VARCHAR) AS day FROM j",
    "scl11_cnr_date_text": _J + f"SELECT d, {_CNR_DATE} AS part FROM j",
    "scl12_date_status": _DATES + "SELECT d, s1 AS decided, s2 AS inside FROM y",
    "scl13_resolve_date": _DATES + "SELECT d, CAST(coalesce(a, z) AS VARCHAR) AS prefer_decision, CAST(coalesce(z, a) AS VARCHAR) AS prefer_cnr, CAST(CASE WHEN a = z THEN a END AS VARCHAR) AS agree_only, CASE WHEN a IS NOT NULL THEN 'decision_date' WHEN z IS NOT NULL THEN 'cnr' END AS prefer_decision_source, CASE WHEN z IS NOT NULL THEN 'cnr' WHEN a IS NOT NULL THEN 'decision_date' END AS prefer_cnr_source, CASE WHEN a = z THEN 'decision_date' END AS agree_only_source FROM y",
    "scl14_judgment_year": ROWS_SQL + "SELECT cnr, judgment_year FROM r",
    "scl18_tokenize": f"SELECT doc_id, len(t) AS n, sha1(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_W}') AS t FROM documents)",
    "scl19_tokenize_references": rf"SELECT doc_id, len(t) AS n, sha1(array_to_string(t, ' ')) AS h, len(regexp_extract_all(x, '[^{S}]+')) AS n_spaces FROM (SELECT doc_id, lower(text) AS x, regexp_extract_all(lower(text || ' WP/12/2015 a.b-c'), '[a-z0-9]+(?:[-_/().][a-z0-9]+)*') AS t FROM documents)",
    "scl20_normalize_match": f"SELECT doc_id, sha1({_MATCH}) AS h, sha1(trim(regexp_replace(lower(text), '[{S}]+', ' ', 'g'))) AS kept FROM documents",
}
