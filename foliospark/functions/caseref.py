"""Case references, case types and bench names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import as_col

# Bench code, name, expected prefix of the record number, whether the name is inferred.
BENCHES = [
    ("newas", "Bombay (Appellate Side)", "HCBM01", True),
    ("newos", "Bombay (Original Side)", "HCBM02", True),
    ("hcaurdb", "Aurangabad", "HCBM03", False),
    ("testcase", "Nagpur", "HCBM04", False),
    ("hcbgoa", "Goa", "HCBM05", False),
    ("kolhcdb", "Kolhapur", "HCBM07", False),
]
# Readable names of case type codes.
CASE_TYPES = {
    "WP": "Writ Petition",
    "PIL": "Public Interest Litigation",
    "CRWP": "Criminal Writ Petition",
    "FA": "First Appeal",
    "SA": "Second Appeal",
    "CRA": "Criminal Appeal",
    "ARBP": "Arbitration Petition",
    "LPA": "Letters Patent Appeal",
    "AO": "Appeal from Order",
}
# A code of up to three capital tokens at the start of a title, or one token anywhere in it.
_NUMBER_YEAR = r"\s*/\s*(\d{1,7})\s*/\s*((?:18|19|20)\d{2})(?!\d)"
LEADING = r"^\s*([A-Z][A-Z.&\-]*(?:\s+[A-Z][A-Z.&\-]*){0,2}(?:\s*\([A-Za-z]{1,6}\))?)" + _NUMBER_YEAR
ANYWHERE = r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z.&\-]*(?:\s*\([A-Za-z]{1,6}\))?)" + _NUMBER_YEAR


def parse_case_reference(title: Column | str) -> Column:
    """Struct code, number, year; null if the title holds no reference or its code has no letter."""
    t = F.coalesce(as_col(title), F.lit(""))
    use = F.when(t.rlike(LEADING), F.lit(True)).otherwise(F.lit(False))

    def group(k: int) -> Column:
        return F.when(use, F.regexp_extract(t, LEADING, k)).otherwise(F.regexp_extract(t, ANYWHERE, k))

    code = F.regexp_replace(F.upper(group(1)), r"[^A-Z()]", "")
    return F.when(code != "", F.struct(code.alias("code"), group(2).alias("number"), group(3).alias("year")))


def case_type_name(code: Column | str, supreme: Column) -> Column:
    """Readable name of a code without its bracketed suffix; never for the supreme court's own codes."""
    names = F.create_map(*[F.lit(x) for x in chain(*CASE_TYPES.items())])
    return F.when(~supreme, F.element_at(names, F.regexp_replace(as_col(code), r"\(.*\)$", "")))


def bench_table(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in BENCHES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(code, name, prefix, inferred)")


def with_bench_names(df: DataFrame, bench: str = "bench", cnr: str = "cnr", supreme: str = "is_supreme") -> DataFrame:
    """Adds bench_name, bench_name_inferred, bench_known, bench_prefix_mismatch; two joins with six broadcast rows."""
    known = F.broadcast(bench_table(df.sparkSession))
    by_code = known.select(
        F.col("code").alias("__code"), F.col("name").alias("__name"), F.col("prefix").alias("__prefix"),
        F.col("inferred").alias("__inferred"),
    )
    by_prefix = known.select(F.col("prefix").alias("__by_prefix"), F.col("name").alias("__prefix_name"))
    out = df.join(by_code, F.col(bench) == F.col("__code"), "left")
    out = out.join(by_prefix, F.substring(cnr, 1, 6) == F.col("__by_prefix"), "left")
    unknown = F.when(F.col(bench).isNull(), F.lit("Unknown")).otherwise(
        F.concat(F.lit("Unknown ("), F.col(bench), F.lit(")"))
    )
    found = F.col("__code").isNotNull()
    return out.withColumns(
        {
            "bench_name": F.when(found, F.col("__name"))
            .when(F.col(supreme), F.lit("Supreme Court of India"))
            .otherwise(F.coalesce("__prefix_name", unknown)),
            "bench_name_inferred": F.when(found, F.col("__inferred"))
            .when(F.col(supreme), F.lit(False))
            .otherwise(F.col("__prefix_name").isNotNull()),
            "bench_known": found,
            "bench_prefix_mismatch": found & ~F.col(cnr).startswith(F.col("__prefix")),
        }
    ).drop("__code", "__name", "__prefix", "__inferred", "__by_prefix", "__prefix_name")
