"""Profiles of raw record tables: grouped counts, medians, prefixes and text samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textops
from ..sources.stages import staged
from .quantiles import with_quantiles


def _long(chars: str, least: int):
    return F.col(chars) >= least


def by_bench(df: DataFrame, long_chars: int = 5000) -> DataFrame:
    """By bench and 6-character prefix of the number: records, long ones, characters, median, under 2,000."""
    keep = _long("text_length", long_chars)
    df = staged(df.select("bench", F.substring("cnr", 1, 6).alias("cnr_prefix"), "text_length"))
    out = df.groupBy("bench", "cnr_prefix").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(keep).alias("reasoned_records"),
        F.sum("text_length").alias("chars"),
        F.sum(F.when(keep, F.col("text_length")).otherwise(0)).alias("reasoned_chars"),
        F.count_if(F.col("text_length") < 2000).alias("under_2k"),
    )
    return with_quantiles(out, df, ["bench", "cnr_prefix"], "text_length", {"median_chars": 0.5})


def by_cnr_year(df: DataFrame, long_chars: int = 5000) -> DataFrame:
    """By band of the year inside the number; what does not parse falls to the last band."""
    year = F.substring(F.coalesce(F.get(F.split("cnr", "_"), 2), F.lit("")), 1, 4).try_cast("int")
    band = (
        F.when(year < 2010, "before 2010").when(year < 2015, "2010-14").when(year < 2020, "2015-19")
        .when(year < 2024, "2020-23").otherwise("2024+")
    )
    keep = _long("text_length", long_chars)
    return df.groupBy(band.alias("period")).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(keep).alias("reasoned_records"),
        F.sum(F.when(keep, F.col("text_length")).otherwise(0)).alias("reasoned_chars"),
    )


def metadata(df: DataFrame) -> DataFrame:
    blank = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("cnr").alias("unique_cnr"),
        blank("title").alias("blank_title"),
        blank("judge").alias("blank_judge"),
        blank("decision_date").alias("blank_date"),
        blank("case_type").alias("blank_case_type"),
        F.count_if(F.coalesce("disposal_nature_normalized", F.lit("")).isin("", "other")).alias("blank_or_other_outcome"),
        F.min("decision_date").alias("earliest_date"),
        F.max("decision_date").alias("latest_date"),
    )


def date_check(df: DataFrame) -> DataFrame:
    """Date text in the number against the decision date, as text."""
    s = F.when(F.col("cnr").isNotNull(), F.coalesce(F.get(F.split("cnr", "_"), 2), F.lit("")))
    d = F.col("decision_date")
    return df.agg(
        F.count_if(s == d).alias("date_matches_cnr"),
        F.count_if(s != d).alias("date_differs_from_cnr"),
        F.count_if(F.substring(s, 1, 4) != F.substring(d, 1, 4)).alias("year_differs_from_cnr"),
        F.max(s).alias("latest_cnr_date"),
    )


def source_summary(df: DataFrame, long_chars: int = 5000) -> DataFrame:
    keep = _long("text_length", long_chars)
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count_if(keep).alias("reasoned_records"),
        F.sum(F.when(keep, F.col("text_length")).otherwise(0)).alias("reasoned_chars"),
    )


def court_prefixes(df: DataFrame, codes: list[str]) -> DataFrame:
    listed = df.where(F.col("court_code").isin(codes))
    return listed.groupBy("court_code", F.substring("cnr", 1, 4).alias("cnr_prefix")).agg(F.count(F.lit(1)).alias("records"))


def text_sample(df: DataFrame, keep, text: str = "full_text", header: str = "NAGPUR") -> DataFrame:
    """On the sampled rows: repeated phrases, mostly non-ASCII heads, near duplicates, a word in the header."""
    rows = df.where(keep)
    head = F.substring(text, 1, 3000)
    foreign = F.regexp_count(head, F.lit(r"[^\x00-\x7F]")) / F.greatest(F.char_length(head), F.lit(1)) > 0.2
    per = rows.select(
        textops.has_repeated_4gram(text).cast("int").alias("r"),
        foreign.cast("int").alias("f"),
        F.upper(F.substring(text, 1, 400)).contains(header).cast("int").alias("h"),
        textops.fingerprint(text).alias("p"),
    )
    by_print = per.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"), F.sum("f").alias("f"), F.sum("h").alias("h"))
    n = F.sum("n")
    return by_print.agg(
        n.alias("sample_rows"),
        (F.sum("r") / n).alias("repeated_4gram_share"),
        (F.sum("f") / n).alias("non_english_share"),
        (F.sum(F.col("n") - 1) / n).alias("near_duplicate_share"),
        F.sum("h").alias("header_hits"),
    )


def header_by_bench(df: DataFrame, keep, text: str = "full_text", header: str = "NAGPUR") -> DataFrame:
    """On the sampled rows: how many of each bench have the word in their first 400 characters."""
    hit = F.upper(F.substring(text, 1, 400)).contains(header)
    return df.where(keep).groupBy("bench").agg(F.count_if(hit).alias("header_hits"), F.count(F.lit(1)).alias("rows"))


def table_profile(df: DataFrame, text: str, group_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """One row of counts and text lengths; and value counts of the grouping columns as (column, value, n)."""
    length = F.char_length(text)
    summary = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
        F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) == "").alias("empty_texts"),
        (F.count(text) - F.countDistinct(F.sha1(text))).alias("duplicate_texts"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.avg(length).alias("mean_length"),
    )
    probs = {"p25_length": 0.25, "median_length": 0.5, "p75_length": 0.75, "p95_length": 0.95}
    summary = with_quantiles(summary, df, [], length, probs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in group_cols])
    values = df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    return summary, values


def length_by(df: DataFrame, group: str, text: str) -> DataFrame:
    df = staged(df.select(group, F.char_length(text).alias("n")))
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("documents"), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"))
    return with_quantiles(out, df, [group], "n", {"median": 0.5})


def majority_name(df: DataFrame, group: str, name: str) -> DataFrame:
    """The most frequent name of each group; ties to the smaller name."""
    counted = df.groupBy(group, name).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(group).orderBy(F.desc("n"), name)
    return counted.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def corruption_by(df: DataFrame, group: str, text: str) -> DataFrame:
    """Documents, affected ones, mean and largest count of control characters by group, and over all (group null)."""
    rows = df.select(F.col(group).alias("g"), textops.control_count(text).alias("c"))
    return rows.groupingSets([[], [F.col("g")]], F.col("g")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("c") > 0).alias("affected"), F.avg("c").alias("mean_controls"), F.max("c").alias("max_controls")
    )


def worst_documents(df: DataFrame, text: str, key: str, top: int = 20) -> DataFrame:
    rows = df.select(key, textops.control_count(text).cast("long").alias("controls"))
    return rows.orderBy(F.desc("controls"), F.asc_nulls_last(key)).limit(top)
