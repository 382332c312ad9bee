"""A choice of registered queries against their SQL on the smallest tables; entry points."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = (
    "flagship_hybrid src2_select_court flt6_drop_reason prj1_build_row agg1_outcome_counts agg3_kept_meta_stats agg7_coverage_by_bench "
    "agg9_date_quality agg11_ocr_share agg12_feature_distribution scl2_normalize_keep_paragraphs scl13_resolve_date scl17_has_repeated_4gram "
    "agg16_profile_benches agg22_profile_text_sample win3_exact_text_dedup win5_round_robin jon2_gold_window jon3_gold_span_overlap ret2_bm25_search "
    "ret4_dense_search ret6_rerank scl21_extract_citations scl24_build_judge_prompt agg28_recall_breakdown agg35_failure_table sta6_quadratic_kappa "
    "win10_holm_adjust str2_stream_resume src9_read_result_log"
).split()


def rows(frame):
    columns = sorted(frame.columns)
    out = []
    for row in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False):
        out.append(tuple("null" if v is None else f"{v:.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row))
    return columns, sorted(out)


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for name in sorted(os.listdir(DIR)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, views, name):
    assert rows(entry.queries()[name](spark, DIR).toPandas()) == rows(views.execute(entry.oracle_sql()[name]).df())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 130


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
