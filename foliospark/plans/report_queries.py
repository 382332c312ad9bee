"""Queries of the quality report, the profiles and the samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import textops
from ..operators import corpus, profile, quality, sampling
from .adapters import JUDGMENTS_SQL, judgments, table
from .corpus_queries import BUILD_SQL, CTRL, ROWS_SQL, labelled, links, rows, sql_count, sql_strip


def records(s, d):
    return judgments(s, d).where("court_code = '27_1'").withColumn("text_length", F.char_length("full_text"))


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


CODES = ["27_1", "10_8", "18_6"]
SHARES = ("missing_share", "conflicts_share", "year_conflicts_share")
FEATURES = tuple(textops.OCR_LIMITS)
QUOTAS = [("direct", 60), ("reason", 48), ("compare", 40), ("statute", 32), ("outcome", 20)]


SPACED = "CASE WHEN doc_id % 3 = 0 THEN concat('(a b c d e f) t h e c o u r t. ', text) ELSE text END"


def _ocr(s, d):
    """Measures of the documents; each third one starts with letters in brackets, which do not count, and spaced letters."""
    return table(s, d, "documents").selectExpr("doc_id", f"{SPACED} AS text").select("doc_id", textops.ocr_metrics("text").alias("m"))


QUERIES = {
    "agg7_coverage_by_bench": lambda s, d: _round(quality.coverage_by_bench(rows(s, d)), "search_share"),
    "agg8_coverage_by_period": lambda s, d: quality.coverage_by_period(rows(s, d)),
    "agg9_date_quality": lambda s, d: _round(quality.date_quality(rows(s, d)), *SHARES),
    "agg10_metadata_quality": lambda s, d: quality.metadata_quality(rows(s, d)),
    "agg11_ocr_share": lambda s, d: _round(quality.ocr_share(rows(s, d), 0.5, "q").where("kind = 'bench'"), "estimate", "low", "high"),
    "agg11_ocr_reasons": lambda s, d: _round(quality.ocr_share(rows(s, d), 0.5, "q").where("kind <> 'bench'"), "estimate", "low", "high"),
    "agg12_feature_distribution": lambda s, d: _round(quality.feature_distribution(rows(s, d), 0.5, "q"), "mean", "p95", "p99", "max"),
    "agg13_repeat_share": lambda s, d: _round(quality.repeat_share(rows(s, d)), "repeated_4gram_share", "repeat_cleaned_share"),
    "agg14_residual_duplicates": lambda s, d: quality.residual_duplicates(rows(s, d)),
    "agg15_link_stats": lambda s, d: quality.link_stats(links(s, d)),
    "jon13_duplicate_bench": lambda s, d: quality.duplicates_by_bench(links(s, d), rows(s, d)),
    "jon16_profile_reconcile": lambda s, d: quality.reconcile(judgments(s, d).groupBy("source_config").agg(F.count("cnr").alias("expected")), rows(s, d)),
    "scl15_ocr_metrics": lambda s, d: _round(_ocr(s, d).select("doc_id", *[F.col(f"m.{f}") for f in FEATURES]), "non_ascii_share", "spaced_letter_share", "vowelless_share", "symbol_share"),
    "scl16_ocr_flags": lambda s, d: _ocr(s, d).select("doc_id", textops.ocr_flags("m").alias("f")).select("doc_id", "f.non_ascii_share", "f.spaced_letter_share", "f.vowelless_share", "f.symbol_share", "f.replacement_chars", "f.suspect"),
    "scl17_has_repeated_4gram": lambda s, d: table(s, d, "documents").select("doc_id", textops.has_repeated_4gram("text").alias("repeated")),
    "flt7_hash_sample": lambda s, d: table(s, d, "documents").where(sampling.in_sample("doc_id", 0.25, "salt")).select("doc_id"),
    "flt8_eligible_length": lambda s, d: sampling.eligible_length(table(s, d, "documents"), F.char_length(textops.clean_text("text"))).select("doc_id"),
    "agg16_profile_benches": lambda s, d: profile.by_bench(records(s, d)),
    "agg17_profile_years": lambda s, d: profile.by_cnr_year(records(s, d)),
    "agg18_profile_metadata": lambda s, d: profile.metadata(records(s, d)),
    "agg19_profile_date_check": lambda s, d: profile.date_check(records(s, d)),
    "agg20_profile_source": lambda s, d: profile.source_summary(judgments(s, d).where("source_config = 'supreme_court'").withColumn("text_length", F.char_length("full_text"))),
    "agg21_court_code_prefixes": lambda s, d: profile.court_prefixes(judgments(s, d), CODES),
    "agg22_profile_text_sample": lambda s, d: _round(profile.text_sample(judgments(s, d), F.col("d") % 3 == 0, header="TION"), "repeated_4gram_share", "non_english_share", "near_duplicate_share"),
    "agg22_header_by_bench": lambda s, d: profile.header_by_bench(judgments(s, d), F.col("d") % 3 == 0, header="TION"),
    "agg23_table_profile": lambda s, d: _round(profile.table_profile(judgments(s, d).select("cnr", "court_code", "year", "full_text"), "full_text", ["court_code", "year"])[0], "mean_length"),
    "agg23_value_counts": lambda s, d: profile.table_profile(judgments(s, d).select("cnr", "court_code", "year", "full_text"), "full_text", ["court_code", "year"])[1],
    "agg24_length_by_court": lambda s, d: _round(profile.length_by(judgments(s, d), "court_code", "full_text"), "mean"),
    "agg25_court_majority_name": lambda s, d: profile.majority_name(table(s, d, "documents"), "source", "lang"),
    "agg26_corruption_by_court": lambda s, d: _round(profile.corruption_by(judgments(s, d), "court_code", "full_text"), "mean_controls"),
    "top3_worst_documents": lambda s, d: profile.worst_documents(judgments(s, d).withColumn("key", F.col("d")), "full_text", "key"),
    "top4_uniform_sample": lambda s, d: sampling.uniform_sample(table(s, d, "documents").select("doc_id", "source"), "doc_id", 200, 13),
    "top5_sample_questions": lambda s, d: sampling.sample_questions(table(s, d, "benchmark").select("item_id", F.col("item_id").alias("position")), 10, 5, "item_id"),
    "top7_short_order_sample": lambda s, d: sampling.short_order_sample(rows(s, d), "27_1", 2000, 100, 1).select("cnr", "clean_chars"),
    "win3_exact_text_dedup": lambda s, d: sampling.exact_text_dedup(judgments(s, d).where("cnr IS NOT NULL"), ["d"], "cnr", "full_text", 500).select("d", "cnr"),
    "win4_cap_per_court": lambda s, d: sampling.cap_per_court(judgments(s, d).withColumn("court_code", F.when(F.col("d") % 3 > 0, F.col("court_code"))), "d", 150, 400).select("d", "court"),
    "win5_round_robin": lambda s, d: sampling.round_robin(table(s, d, "documents").select("doc_id", "source"), "source", "doc_id", 200),
    "win6_assign_quota": lambda s, d: sampling.assign_quota(table(s, d, "documents").select("doc_id"), "doc_id", QUOTAS),
    "set6_distinct_courts": lambda s, d: sampling.distinct_courts(rows(s, d), "court_code", "court_name", "source_config"),
}

_J = f"WITH {JUDGMENTS_SQL} "
_REC = f"WITH {JUDGMENTS_SQL}, q AS (SELECT *, length(full_text) AS text_length FROM j WHERE court_code = '27_1') "
_COVER = "count(*) AS records, count(*) FILTER (in_search_index) AS search_records, CAST(coalesce(sum(clean_chars) FILTER (in_search_index), 0) AS BIGINT) AS search_chars, median(clean_chars) FILTER (in_search_index) AS median_search_chars, min(judgment_year) AS first_year, max(judgment_year) AS last_year"
_SAMPLE = "CAST(('0x' || substring(md5('{salt}|' || {key}), 1, 16)) AS UBIGINT) / 18446744073709551616.0 < {rate}"
Z = 1.959963984540054


def sql_wilson(k: str, n: str) -> str:
    p = f"({k} / {n})"
    half = f"{Z} * sqrt({p} * (1 - {p}) / {n} + {Z * Z} / (4.0 * {n} * {n}))"
    mid, den = f"({p} + {Z * Z} / (2.0 * {n}))", f"(1 + {Z * Z} / {n})"
    return (
        f"round({p}, 6) AS estimate, round(CASE WHEN {k} = 0 THEN 0.0 ELSE greatest(0.0, ({mid} - {half}) / {den}) END, 6) AS low, "
        f"round(CASE WHEN {k} = {n} THEN 1.0 ELSE least(1.0, ({mid} + {half}) / {den}) END, 6) AS high"
    )


_PUNCT = r".,;:()\[\]{}''\"\-/&%?!_`’‘“”–—§"
_SPACES = r"\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_ocr(text: str) -> str:
    """Measures but the spaced letters, which need look-around (0 in these tables)."""
    n = f"greatest(length({text}), 1)"
    tokens = f"regexp_extract_all({text}, '[A-Za-z]+')"
    return (
        f"{sql_count(text, r'[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} / {n} AS non_ascii_share, "
        f"{sql_count(text, chr(92) + 'x{FFFD}')} AS replacement_chars, 0.0 AS spaced_letter_share, "
        f"len(list_filter({tokens}, lambda w: length(w) >= 5 AND w <> upper(w) AND NOT regexp_matches(w, '[aeiouyAEIOUY]'))) / greatest(len({tokens}), 1) AS vowelless_share, "
        f"{sql_count(text, '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + _SPACES + _PUNCT + ']')} / {n} AS symbol_share"
    )


#: Without look-around: the characters around a run of spaced letters are matched with it, and only the run counts.
_RUNS = r"regexp_extract_all(text, '(?:^|[^A-Za-z0-9(])((?:[A-Za-z] ){4,}[A-Za-z])(?:[^A-Za-z0-9)]|$)', 1)"
_SPACED_OCR = f"WITH x AS (SELECT doc_id, {SPACED} AS text FROM documents), m AS (SELECT doc_id, coalesce(list_sum(list_transform({_RUNS}, lambda x: length(x))), 0) / greatest(length(text), 1) AS spaced, {sql_ocr('text')} FROM x) "
_OCR = f", m AS (SELECT *, {sql_ocr('text')} FROM r WHERE {_SAMPLE.format(salt='q', key='cnr', rate=0.5)}), f AS (SELECT *, non_ascii_share > 0.05 AS f1, replacement_chars > 5 AS f2, spaced_letter_share > 0.02 AS f3, vowelless_share > 0.05 AS f4, symbol_share > 0.15 AS f5 FROM m), g AS (SELECT *, f1 OR f2 OR f3 OR f4 OR f5 AS suspect FROM f)"
def sql_words(text: str) -> str:
    return f"regexp_extract_all(substring({text}, 1, 3000), '[^{_SPACES}]+')"


#: Over a column ``w`` of words: some phrase of four occurs three times (the last one is not formed).
_GRAMS = (
    "coalesce(list_max(map_values(list_aggregate(list_transform(range(1, greatest(len(w) - 3, 1)), "
    "lambda i: array_to_string(w[i:i + 3], ' ')), 'histogram'))) >= 3, false)"
)
_FEATURE = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(quantile_cont({f}, 0.95), 6) AS p95, round(quantile_cont({f}, 0.99), 6) AS p99, round(CAST(max({f}) AS DOUBLE), 6) AS max FROM m"
    for f in FEATURES
)
_PRINT = "sha1(substring(lower(regexp_replace(full_text, '[^\\p{L}\\p{N}_]', '', 'g')), 1, 2000))"
SQL = {
    "agg7_coverage_by_bench": ROWS_SQL + f"SELECT source_config, bench_name, {_COVER}, round(count(*) FILTER (in_search_index) / count(*), 6) AS search_share FROM r GROUP BY 1, 2",
    "agg8_coverage_by_period": ROWS_SQL + f"SELECT CASE WHEN judgment_year IS NULL THEN 'unknown' WHEN judgment_year < 2010 THEN 'before 2010' WHEN judgment_year < 2015 THEN '2010-14' WHEN judgment_year < 2020 THEN '2015-19' WHEN judgment_year < 2024 THEN '2020-23' ELSE '2024+' END AS period, {_COVER} FROM r GROUP BY 1",
    "agg9_date_quality": ROWS_SQL + "SELECT bench_name, grouping(bench_name) = 1 AS overall, count(*) AS n, count(*) FILTER (judgment_date IS NULL) AS missing, count(*) FILTER (date_conflict) AS conflicts, count(*) FILTER (year_conflict) AS year_conflicts, round(count(*) FILTER (judgment_date IS NULL) / count(*), 6) AS missing_share, round(count(*) FILTER (date_conflict) / count(*), 6) AS conflicts_share, round(count(*) FILTER (year_conflict) / count(*), 6) AS year_conflicts_share FROM r GROUP BY GROUPING SETS ((), (bench_name))",
    "agg10_metadata_quality": ROWS_SQL + "SELECT count(*) AS n, count(*) FILTER (judge IS NULL) AS blank_judge, count(*) FILTER (title IS NULL) AS blank_title, count(*) FILTER (lower(coalesce(outcome, '')) IN ('', 'other')) AS vague_outcome, count(*) FILTER (case_type_source = 'dataset') AS case_type_dataset, count(*) FILTER (case_type_source = 'title') AS case_type_title, count(*) FILTER (case_type_source = 'none') AS case_type_none FROM r",
    "agg11_ocr_share": ROWS_SQL + _OCR + f"SELECT 'bench' AS kind, bench_name AS value, k AS hits, n, {sql_wilson('k', 'n')} FROM (SELECT bench_name, count(*) FILTER (suspect) AS k, count(*) AS n FROM g GROUP BY 1)",
    "agg11_ocr_reasons": ROWS_SQL + _OCR + f", h AS (SELECT 'all' AS kind, 'suspect' AS value, count(*) FILTER (suspect) AS k, count(*) AS n FROM g" + "".join(f" UNION ALL SELECT 'reason', '{r}', count(*) FILTER (f{i + 1}), count(*) FROM g" for i, r in enumerate(FEATURES)) + f") SELECT kind, value, k AS hits, n, {sql_wilson('k', 'n')} FROM h",
    "agg12_feature_distribution": ROWS_SQL + _OCR + _FEATURE,
    "agg13_repeat_share": ROWS_SQL + f"SELECT count(*) AS n, round(avg(CAST(x AS INTEGER)), 6) AS repeated_4gram_share, 0.0 AS repeat_cleaned_share FROM (SELECT {_GRAMS} AS x FROM (SELECT {sql_words('text')} AS w FROM r))",
    "agg14_residual_duplicates": ROWS_SQL + "SELECT count(cnr) - count(DISTINCT cnr) AS repeated_cnrs, count(*) FILTER (in_search_index) - count(DISTINCT sha1(substring(lower(regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g')), 1, 2000))) FILTER (in_search_index) AS repeated_fingerprints FROM r",
    "agg15_link_stats": BUILD_SQL + "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS removed, count(*) AS kept_with_duplicates, coalesce(max(n), 0) + 1 AS largest_group FROM (SELECT winner, count(*) AS n FROM b WHERE outcome_label = 'near_duplicate' GROUP BY 1)",
    "jon13_duplicate_bench": ROWS_SQL + "SELECT coalesce(r.bench_name, '(not in search index)') AS bench, CAST(sum(n) AS BIGINT) AS removed FROM (SELECT winner, count(*) AS n FROM b WHERE outcome_label = 'near_duplicate' GROUP BY 1) x LEFT JOIN r ON r.cnr = x.winner AND r.in_search_index GROUP BY 1",
    "jon16_profile_reconcile": ROWS_SQL + "SELECT source_config, expected, built, built - expected AS difference FROM (SELECT source_config, count(cnr) AS expected FROM j GROUP BY 1) JOIN (SELECT source_config, count(*) AS built FROM r GROUP BY 1) USING (source_config)",
    "scl15_ocr_metrics": _SPACED_OCR + "SELECT doc_id, round(non_ascii_share, 6) AS non_ascii_share, replacement_chars, round(spaced, 6) AS spaced_letter_share, round(vowelless_share, 6) AS vowelless_share, round(symbol_share, 6) AS symbol_share FROM m",
    "scl16_ocr_flags": _SPACED_OCR + "SELECT *, non_ascii_share OR spaced_letter_share OR vowelless_share OR symbol_share OR replacement_chars AS suspect FROM (SELECT doc_id, non_ascii_share > 0.05 AS non_ascii_share, spaced > 0.02 AS spaced_letter_share, vowelless_share > 0.05 AS vowelless_share, symbol_share > 0.15 AS symbol_share, replacement_chars > 5 AS replacement_chars FROM m)",
    "scl17_has_repeated_4gram": f"SELECT doc_id, {_GRAMS} AS repeated FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents)",
    "flt7_hash_sample": f"SELECT doc_id FROM documents WHERE {_SAMPLE.format(salt='salt', key='doc_id', rate=0.25)}",
    "flt8_eligible_length": f"SELECT doc_id FROM documents WHERE length(trim(regexp_replace(regexp_replace(text, '{CTRL}', ' ', 'g'), '[{_SPACES}]+', ' ', 'g'))) BETWEEN 500 AND 80000",
    "agg16_profile_benches": _REC + "SELECT bench, substring(cnr, 1, 6) AS cnr_prefix, count(*) AS records, count(*) FILTER (text_length >= 5000) AS reasoned_records, CAST(sum(text_length) AS BIGINT) AS chars, CAST(coalesce(sum(text_length) FILTER (text_length >= 5000), 0) AS BIGINT) AS reasoned_chars, median(text_length) AS median_chars, count(*) FILTER (text_length < 2000) AS under_2k FROM q GROUP BY 1, 2",
    "agg17_profile_years": _REC + "SELECT CASE WHEN y < 2010 THEN 'before 2010' WHEN y < 2015 THEN '2010-14' WHEN y < 2020 THEN '2015-19' WHEN y < 2024 THEN '2020-23' ELSE '2024+' END AS period, count(*) AS records, count(*) FILTER (text_length >= 5000) AS reasoned_records, CAST(coalesce(sum(text_length) FILTER (text_length >= 5000), 0) AS BIGINT) AS reasoned_chars FROM (SELECT TRY_CAST(substring(split_part(cnr, '_', 3), 1, 4) AS INTEGER) AS y, text_length FROM q) GROUP BY 1",
    "agg18_profile_metadata": _REC + "SELECT count(*) AS records, count(DISTINCT cnr) AS unique_cnr, count(*) FILTER (coalesce(title, '') = '') AS blank_title, count(*) FILTER (judge = '') AS blank_judge, count(*) FILTER (decision_date = '') AS blank_date, count(*) FILTER (case_type = '') AS blank_case_type, count(*) FILTER (disposal_nature_normalized IN ('', 'other')) AS blank_or_other_outcome, min(decision_date) AS earliest_date, max(decision_date) AS latest_date FROM q",
    "agg19_profile_date_check": _REC + "SELECT count(*) FILTER (s = t) AS date_matches_cnr, count(*) FILTER (s <> t) AS date_differs_from_cnr, count(*) FILTER (substring(s, 1, 4) <> substring(t, 1, 4)) AS year_differs_from_cnr, max(s) AS latest_cnr_date FROM (SELECT split_part(cnr, '_', 3) AS s, decision_date AS t FROM q)",
    "agg20_profile_source": _J + "SELECT count(*) AS records, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (length(full_text) >= 5000) AS reasoned_records, CAST(coalesce(sum(length(full_text)) FILTER (length(full_text) >= 5000), 0) AS BIGINT) AS reasoned_chars FROM j WHERE source_config = 'supreme_court'",
    "agg21_court_code_prefixes": _J + "SELECT court_code, substring(cnr, 1, 4) AS cnr_prefix, count(*) AS records FROM j WHERE court_code IN ('27_1', '10_8', '18_6') GROUP BY 1, 2",
    "agg22_profile_text_sample": _J + f", x AS (SELECT CAST({_GRAMS} AS INTEGER) AS r, CAST({sql_count('substring(full_text, 1, 3000)', r'[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} / greatest(length(substring(full_text, 1, 3000)), 1) > 0.2 AS INTEGER) AS f, CAST(contains(upper(substring(full_text, 1, 400)), 'TION') AS INTEGER) AS h, {_PRINT} AS p FROM (SELECT *, {sql_words('full_text')} AS w FROM j) WHERE d % 3 = 0) SELECT count(*) AS sample_rows, round(avg(r), 6) AS repeated_4gram_share, round(avg(f), 6) AS non_english_share, round((count(*) - count(DISTINCT p)) / count(*), 6) AS near_duplicate_share, CAST(sum(h) AS BIGINT) AS header_hits FROM x",
    "agg22_header_by_bench": _J + "SELECT bench, count(*) FILTER (contains(upper(substring(full_text, 1, 400)), 'TION')) AS header_hits, count(*) AS rows FROM j WHERE d % 3 = 0 GROUP BY 1",
    "agg23_table_profile": _J + f"SELECT count(*) AS rows, count(*) FILTER (cnr IS NULL) AS null_cnr, count(*) FILTER (court_code IS NULL) AS null_court_code, count(*) FILTER (year IS NULL) AS null_year, count(*) FILTER (full_text IS NULL) AS null_full_text, count(*) FILTER (trim(full_text) = '') AS empty_texts, count(full_text) - count(DISTINCT full_text) AS duplicate_texts, min(length(full_text)) AS min_length, max(length(full_text)) AS max_length, round(avg(length(full_text)), 6) AS mean_length, quantile_cont(length(full_text), 0.25) AS p25_length, quantile_cont(length(full_text), 0.5) AS median_length, quantile_cont(length(full_text), 0.75) AS p75_length, quantile_cont(length(full_text), 0.95) AS p95_length FROM j",
    "agg23_value_counts": _J + "SELECT 'court_code' AS column, court_code AS value, count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM j GROUP BY 2",
    "agg24_length_by_court": _J + "SELECT court_code, count(*) AS documents, round(avg(length(full_text)), 6) AS mean, median(length(full_text)) AS median, min(length(full_text)) AS min, max(length(full_text)) AS max FROM j GROUP BY 1",
    "agg25_court_majority_name": "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents GROUP BY 1, 2) WHERE k = 1",
    "agg26_corruption_by_court": _J + f"SELECT court_code AS g, count(*) AS documents, count(*) FILTER (c > 0) AS affected, round(avg(c), 6) AS mean_controls, max(c) AS max_controls FROM (SELECT court_code, {sql_count('full_text', CTRL)} AS c FROM j) GROUP BY GROUPING SETS ((), (court_code))",
    "top3_worst_documents": _J + f"SELECT d AS key, {sql_count('full_text', CTRL)} AS controls FROM j ORDER BY controls DESC, d LIMIT 20",
    "top4_uniform_sample": "SELECT doc_id, source FROM documents ORDER BY md5('13|' || doc_id), doc_id LIMIT 200",
    "top5_sample_questions": "SELECT item_id, item_id AS position FROM benchmark ORDER BY md5('5|' || item_id), item_id LIMIT 10",
    "top7_short_order_sample": ROWS_SQL + "SELECT cnr, clean_chars FROM r WHERE court_code = '27_1' AND clean_chars < 2000 ORDER BY md5('1|' || cnr), cnr LIMIT 100",
    "win3_exact_text_dedup": _J + f", x AS (SELECT d, cnr, {sql_strip('full_text')} AS t, row_number() OVER (PARTITION BY cnr ORDER BY d) AS a FROM j WHERE cnr IS NOT NULL AND {sql_strip('full_text')} <> ''), y AS (SELECT d, cnr, row_number() OVER (PARTITION BY t ORDER BY d) AS b FROM x WHERE a = 1) SELECT d, cnr FROM y WHERE b = 1 ORDER BY d LIMIT 500",
    "win4_cap_per_court": _J + ", x AS (SELECT d, coalesce(CASE WHEN d % 3 > 0 THEN court_code END, nullif(substring(cnr, 1, 4), ''), 'UNKNOWN') AS court, md5('0|' || d) AS m FROM j), y AS (SELECT *, row_number() OVER (PARTITION BY court ORDER BY m, d) AS k FROM x) SELECT d, court FROM y WHERE k <= 150 ORDER BY m, d LIMIT 400",
    "win5_round_robin": "SELECT doc_id, source, CAST(k AS INTEGER) AS round FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0|' || doc_id), doc_id) - 1 AS k FROM documents) ORDER BY k, source LIMIT 200",
    "win6_assign_quota": "SELECT doc_id, CAST(k AS INTEGER) AS place, CASE WHEN k <= 60 THEN 'direct' WHEN k <= 108 THEN 'reason' WHEN k <= 148 THEN 'compare' WHEN k <= 180 THEN 'statute' ELSE 'outcome' END AS kind FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 200",
    "set6_distinct_courts": ROWS_SQL + "SELECT DISTINCT court_code, court_name, source_config FROM r",
}
