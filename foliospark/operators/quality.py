"""Quality report: coverage, dates, metadata, scan noise, repeats and residual duplicates as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, textops
from ..functions.stats_exprs import wilson
from ..sources.stages import staged
from .quantiles import with_quantiles
from .sampling import in_sample


def _covered(rows: DataFrame, *groups: Column | str) -> DataFrame:
    """Counts of each group with the exact median length of its search records; the rows are read once, narrow."""
    named = rows.select(*groups, "in_search_index", "judgment_year", "clean_chars")
    names = named.columns[: len(groups)]
    named = staged(named)
    out = named.groupBy(*names).agg(*_coverage())
    return with_quantiles(out, named.where("in_search_index"), names, "clean_chars", {"median_search_chars": 0.5})


def _coverage() -> list[Column]:
    search = F.col("in_search_index")
    year = F.when(F.col("judgment_year") > 0, F.col("judgment_year"))
    return [
        F.count(F.lit(1)).alias("records"),
        F.count_if(search).alias("search_records"),
        F.coalesce(F.sum(F.when(search, F.col("clean_chars"))), F.lit(0)).alias("search_chars"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
    ]


def coverage_by_bench(rows: DataFrame) -> DataFrame:
    """Records, search records, share, characters, exact median length and years of each source and bench."""
    out = _covered(rows, "source_config", "bench_name")
    return out.withColumn("search_share", F.col("search_records") / F.col("records")).orderBy(
        F.desc("records"), "source_config", "bench_name"
    )


def coverage_by_period(rows: DataFrame) -> DataFrame:
    return _covered(rows, dates.year_period("judgment_year").alias("period"))


def date_quality(rows: DataFrame) -> DataFrame:
    """Missing dates, conflicts and year conflicts over all rows (bench null) and by bench, in one pass."""
    counts = {
        "missing": F.count_if(F.col("judgment_date").isNull()),
        "conflicts": F.count_if("date_conflict"),
        "year_conflicts": F.count_if("year_conflict"),
    }
    out = rows.groupingSets([[], [F.col("bench_name")]], F.col("bench_name")).agg(
        F.grouping("bench_name").alias("overall"),
        F.count(F.lit(1)).alias("n"),
        *[c.alias(k) for k, c in counts.items()],
    )
    return out.select(
        "bench_name", (F.col("overall") == 1).alias("overall"), "n", *counts, *[(F.col(k) / F.col("n")).alias(f"{k}_share") for k in counts]
    )


def metadata_quality(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        blank("judge").alias("blank_judge"),
        blank("title").alias("blank_title"),
        F.count_if(F.lower(F.coalesce("outcome", F.lit(""))).isin("", "other")).alias("vague_outcome"),
        *[F.count_if(F.col("case_type_source") == s).alias(f"case_type_{s}") for s in ("dataset", "title", "none")],
    )


REASONS = tuple(textops.OCR_LIMITS)


def ocr_share(rows: DataFrame, rate: float = 1.0, salt: str = "") -> DataFrame:
    """Share of texts that look badly scanned, on the hash sample: overall, by reason and by bench, with intervals.

    A reason counts only in texts that are suspect.
    """
    sample = rows.where(in_sample("cnr", rate, salt)).select(
        "bench_name", textops.ocr_flags(textops.ocr_metrics("text")).alias("f")
    )
    kinds = F.array(
        F.struct(F.lit("all").alias("kind"), F.lit("suspect").alias("value"), F.col("f.suspect").alias("hit")),
        F.struct(F.lit("bench").alias("kind"), F.col("bench_name").alias("value"), F.col("f.suspect").alias("hit")),
        *[
            F.struct(F.lit("reason").alias("kind"), F.lit(r).alias("value"), (F.col("f.suspect") & F.col(f"f.{r}")).alias("hit"))
            for r in REASONS
        ],
    )
    out = sample.select(F.explode(kinds).alias("x")).groupBy("x.kind", "x.value").agg(
        F.count_if("x.hit").alias("hits"), F.count(F.lit(1)).alias("n")
    )
    return out.withColumn("w", wilson("hits", "n")).select("kind", "value", "hits", "n", "w.estimate", "w.low", "w.high")


def feature_distribution(rows: DataFrame, rate: float = 1.0, salt: str = "") -> DataFrame:
    """Mean, 95th and 99th percentile (linear) and maximum of each scan measure."""
    m = rows.where(in_sample("cnr", rate, salt)).select(textops.ocr_metrics("text").alias("m"))
    pairs = F.array(*[F.struct(F.lit(r).alias("feature"), F.col(f"m.{r}").cast("double").alias("v")) for r in REASONS])
    m = staged(m.select(F.explode(pairs).alias("p")).select("p.feature", "p.v"))
    out = m.groupBy("feature").agg(F.avg("v").alias("mean"), F.max("v").alias("max"))
    return with_quantiles(out, m, ["feature"], "v", {"p95": 0.95, "p99": 0.99}).select("feature", "mean", "p95", "p99", "max")


def repeat_share(rows: DataFrame, rate: float = 1.0, salt: str = "") -> DataFrame:
    return rows.where(in_sample("cnr", rate, salt)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(textops.has_repeated_4gram("text").cast("double")).alias("repeated_4gram_share"),
        F.avg((F.col("repeat_chars_removed") > 0).cast("double")).alias("repeat_cleaned_share"),
    )


def residual_duplicates(rows: DataFrame) -> DataFrame:
    """Repeated numbers over both tables, and repeated fingerprints in the search table."""
    search = rows.where("in_search_index").select(textops.fingerprint("text").alias("p"))
    return rows.agg((F.count("cnr") - F.countDistinct("cnr")).alias("repeated_cnrs")).join(
        search.agg((F.count("p") - F.countDistinct("p")).alias("repeated_fingerprints"))
    )


def link_stats(links: DataFrame) -> DataFrame:
    by_kept = links.groupBy("kept_cnr").agg(F.count(F.lit(1)).alias("n"))
    return by_kept.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("removed"),
        F.count(F.lit(1)).alias("kept_with_duplicates"),
        (F.coalesce(F.max("n"), F.lit(0)) + 1).alias("largest_group"),
    )


def duplicates_by_bench(links: DataFrame, rows: DataFrame) -> DataFrame:
    """Removed duplicates by bench of the kept record; '(not in search index)' where there is none."""
    by_kept = links.groupBy("kept_cnr").agg(F.count(F.lit(1)).alias("n"))
    kept = rows.where("in_search_index").select(F.col("cnr").alias("kept_cnr"), "bench_name")
    out = by_kept.join(kept, "kept_cnr", "left")
    return out.groupBy(F.coalesce("bench_name", F.lit("(not in search index)")).alias("bench")).agg(F.sum("n").alias("removed"))


def reconcile(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """Expected counts by source (source_config, expected) against built ones, and the difference."""
    built = rows.groupBy("source_config").agg(F.count(F.lit(1)).alias("built"))
    out = expected.join(built, "source_config", "full").select(
        "source_config", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("built", F.lit(0)).alias("built")
    )
    return out.withColumn("difference", F.col("built") - F.col("expected"))
