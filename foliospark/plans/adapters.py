"""The given tables in the shapes that the operators read, in Spark and in SQL with the same arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
TODAY = "2026-11-02"
MIN_CHARS = 1200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], make: Callable[[], T]) -> T:
    """What ``make`` gives, made once for this application and these very files (by path, length and time of change)."""
    files = []
    for x in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{x}.parquet")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in system.listStatus(path)]
    key = (spark.sparkContext.applicationId, name, *files)
    if key not in _KEPT:
        for old in [k for k in _KEPT if k[0] != key[0]]:
            del _KEPT[old]
        _KEPT[key] = make()
    return _KEPT[key]


_DAY = "date_add(DATE'2005-01-01', CAST(({d}) * 37 % 7300 AS INT))"
_CNR = "concat('HCBM0', 1 + ({d}) % 7, '_', {d}, {tail})"
_TAIL = (
    "CASE WHEN d % 50 = 3 THEN '_3021-03-24' "
    "WHEN d % 43 = 5 THEN concat('_', CAST(date_add(DATE'2005-01-01', CAST(d * 37 % 7300 + 1 AS INT)) AS STRING)) "
    "WHEN d % 59 = 7 THEN '' "
    "ELSE concat('_', CAST(date_add(DATE'2005-01-01', CAST(d * 37 % 7300 AS INT)) AS STRING)) END"
)
_EARLIER = "concat('_', CAST(date_add(DATE'2005-01-01', CAST((d - 1) * 37 % 7300 AS INT)) AS STRING))"


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as judgment records; ``d`` is the scan order."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "d")
    return docs.selectExpr(
        "d",
        "CASE WHEN d % 10 = 9 THEN 'supreme_court' ELSE 'high_courts' END AS source_config",
        "CASE WHEN d % 101 = 0 THEN NULL "
        f"WHEN d % 97 = 1 THEN {_CNR.format(d='d - 1', tail=_EARLIER).replace(', d - 1,', ', (d - 1),')} "
        f"ELSE {_CNR.format(d='d', tail=_TAIL)} END AS cnr",
        "CASE WHEN CAST(substring(source, 4) AS INT) < 15 THEN '27_1' ELSE '10_8' END AS court_code",
        "CASE WHEN d % 29 = 0 THEN '' WHEN d % 31 = 0 THEN 'mystery' "
        "ELSE element_at(array('newas', 'newos', 'hcaurdb', 'testcase', 'hcbgoa', 'kolhcdb'), CAST(d % 6 + 1 AS INT)) "
        "END AS bench",
        "CASE WHEN d % 71 = 0 THEN '   ' "
        "WHEN d % 53 = 0 THEN concat(repeat(chr(1), CAST(floor(length(text) / 20) AS INT)), text) ELSE text END AS full_text",
        "CAST(2005 + (d * 37 % 7300) div 365 AS INT) AS year",
        "CASE WHEN d % 41 = 0 THEN '' WHEN d % 47 = 0 THEN 'not a date' WHEN d % 61 = 0 THEN '1850-01-01' "
        "ELSE CAST(date_add(DATE'2005-01-01', CAST(d * 37 % 7300 AS INT)) AS STRING) END AS decision_date",
        "CASE d % 6 WHEN 0 THEN concat('WP/', d, '/2015') WHEN 1 THEN concat('CR. MISC./', d, '/2012 of A Vs B') "
        "WHEN 2 THEN concat('Ram v. State CRA / ', d, ' / 2011') WHEN 3 THEN concat('WP(L)/', d, '/2019') "
        "WHEN 4 THEN 'Ram v. State' END AS title",
        "CASE WHEN d % 4 = 0 THEN 'Criminal Appeal' ELSE '' END AS case_type",
        "CASE WHEN d % 83 = 0 THEN '' ELSE concat('J', d % 20) END AS judge",
        "'Ram' AS petitioner",
        "'State' AS respondent",
        "CASE WHEN d % 6 = 0 THEN 'other' WHEN d % 13 = 0 THEN '' ELSE 'allowed' END AS disposal_nature_normalized",
    )


_BASE = "DATE '2005-01-01' + CAST((d * 37 % 7300) AS INTEGER)"
#: The same records in DuckDB's dialect: common table expression ``j``.
JUDGMENTS_SQL = f"""
j AS (
  SELECT d, CASE WHEN d % 10 = 9 THEN 'supreme_court' ELSE 'high_courts' END AS source_config,
    CASE WHEN d % 101 = 0 THEN NULL
      WHEN d % 97 = 1 THEN 'HCBM0' || (1 + (d - 1) % 7) || '_' || (d - 1) || '_'
           || CAST(CAST(DATE '2005-01-01' + CAST((d - 1) * 37 % 7300 AS INTEGER) AS DATE) AS VARCHAR)
      ELSE 'HCBM0' || (1 + d % 7) || '_' || d ||
        CASE WHEN d % 50 = 3 THEN '_3021-03-24'
          WHEN d % 43 = 5 THEN '_' || CAST(CAST({_BASE} + 1 AS DATE) AS VARCHAR)
          WHEN d % 59 = 7 THEN '' ELSE '_' || CAST(CAST({_BASE} AS DATE) AS VARCHAR) END END AS cnr,
    CASE WHEN CAST(substring(source, 4) AS INTEGER) < 15 THEN '27_1' ELSE '10_8' END AS court_code,
    CASE WHEN d % 29 = 0 THEN '' WHEN d % 31 = 0 THEN 'mystery'
      ELSE (['newas', 'newos', 'hcaurdb', 'testcase', 'hcbgoa', 'kolhcdb'])[d % 6 + 1] END AS bench,
    CASE WHEN d % 71 = 0 THEN '   ' WHEN d % 53 = 0 THEN repeat(chr(1), length(text) // 20) || text ELSE text END AS full_text,
    CAST(2005 + (d * 37 % 7300) // 365 AS INTEGER) AS year,
    CASE WHEN d % 41 = 0 THEN '' WHEN d % 47 = 0 THEN 'not a date' WHEN d % 61 = 0 THEN '1850-01-01'
      ELSE CAST(CAST({_BASE} AS DATE) AS VARCHAR) END AS decision_date,
    CASE d % 6 WHEN 0 THEN 'WP/' || d || '/2015' WHEN 1 THEN 'CR. MISC./' || d || '/2012 of A Vs B'
      WHEN 2 THEN 'Ram v. State CRA / ' || d || ' / 2011' WHEN 3 THEN 'WP(L)/' || d || '/2019'
      WHEN 4 THEN 'Ram v. State' END AS title,
    CASE WHEN d % 4 = 0 THEN 'Criminal Appeal' ELSE '' END AS case_type,
    CASE WHEN d % 83 = 0 THEN '' ELSE 'J' || (d % 20) END AS judge, 'Ram' AS petitioner, 'State' AS respondent,
    CASE WHEN d % 6 = 0 THEN 'other' WHEN d % 13 = 0 THEN '' ELSE 'allowed' END AS disposal_nature_normalized
  FROM (SELECT doc_id AS d, text, source FROM documents))
"""
