"""Exact percentiles of groups of any size: selection by rank, a histogram of the range that is left in each pass.

Every wanted rank has a range of values that holds it. A pass cuts each range into ``CELLS`` cells, counts them with one
partial aggregation, and keeps the cell with the rank, from its least to its greatest value; a rank is found when both
are the same. So a task never holds more than the cells of a range, whatever the group's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import scratch, staged

#: Cells of a range in a pass; rows of a group up to which Spark's own percentile, which holds a group's values, is taken.
CELLS, SMALL = 4096, 100_000


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on equal names, null being equal to null."""
    right = right.withColumnsRenamed({n: f"__{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return left.join(right, on, how).drop(*[f"__{n}" for n in names])


def quantiles(df: DataFrame, groups: list[str], value: Column | str, probs: dict[str, float], small: int = SMALL) -> DataFrame:
    """The groups with their percentiles of ``value`` by name, linear between neighbours; nulls do not count.

    Values are read as doubles. A group without a value is left out; without groups there is one row, if any value.
    The groups and values are kept in the shared folder, so what they are computed from is read once.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = groups or ["__all"]
    rows = df.withColumn("__all", F.lit(1)) if not groups else df
    rows = staged(rows.select(*keys, value.cast("double").alias("__v")).where("__v IS NOT NULL"))
    found = selected(rows, keys, probs, small)
    return found if groups else found.drop("__all")


def selected(rows: DataFrame, keys: list[str], probs: dict[str, float], small: int = SMALL) -> DataFrame:
    sizes = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")))
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= small:
        return rows.groupBy(*keys).agg(*[F.percentile("__v", F.lit(p)).alias(name) for name, p in probs.items()])
    places = F.array(*[F.struct(F.lit(name).alias("__name"), (F.lit(p) * (F.col("__n") - 1)).alias("__at")) for name, p in probs.items()])
    wanted = sizes.select(*keys, "__lo", "__hi", F.explode(places).alias("__w")).select(*keys, "__lo", "__hi", "__w.*")
    ends = F.array(F.floor("__at"), F.ceil("__at"))
    ranks = wanted.withColumn("__rank", F.explode(F.array_distinct(ends)))
    ranks = _written(ranks.withColumn("__before", F.lit(0).cast("long")))
    done = ranks.where("__lo = __hi")
    left = ranks.where("__lo < __hi")
    while left.limit(1).count():
        ranks = _written(_narrowed(rows, left, keys))
        done, left = done.unionByName(ranks.where("__lo = __hi")), ranks.where("__lo < __hi")
    by_name = done.groupBy(*keys, "__name", "__at").agg(F.min("__lo").alias("a"), F.max("__lo").alias("b"))
    low, high = F.floor("__at"), F.ceil("__at")
    linear = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((high - F.col("__at")) * F.col("a") + (F.col("__at") - low) * F.col("b"))
    return by_name.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, linear)).alias(name) for name in probs])


def _written(df: DataFrame) -> DataFrame:
    """The rows as a table of their true size: the sizes that Spark guesses would multiply from pass to pass."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _narrowed(rows: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """The ranks that are left, each with the cell of its range that holds it as its new range."""
    cut = [*keys, "__lo", "__hi"]
    ranges = left.select(*cut).distinct()
    inside = _same(rows, ranges, keys).where("__v BETWEEN __lo AND __hi")
    share = (F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2)  # halves do not overflow
    # both ends have cells of their own, so each pass cuts off something even of infinite ranges
    cell = F.when(F.col("__v") == F.col("__hi"), CELLS).when(F.col("__v") == F.col("__lo"), -1).otherwise(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
    cells = inside.groupBy(*cut, cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    upto = F.sum("__c").over(Window.partitionBy(*cut).orderBy("__cell"))
    cells = cells.withColumn("__upto", upto)
    held = _same(left, cells, cut).where("__before + __upto > __rank AND __before + __upto - __c <= __rank")
    return held.select(
        *keys, F.col("__least").alias("__lo"), F.col("__most").alias("__hi"), "__name", "__at", "__rank",
        (F.col("__before") + F.col("__upto") - F.col("__c")).alias("__before"),
    )


def with_quantiles(summary: DataFrame, df: DataFrame, groups: list[str], value: Column | str, probs: dict[str, float]) -> DataFrame:
    """A summary by groups with the percentiles beside it; null where a group has no value."""
    found = quantiles(df, groups, value, probs)
    return _same(summary, found, groups, "left") if groups else summary.join(F.broadcast(found), how="left")
