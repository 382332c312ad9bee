"""Samples, caps, rounds and quotas. All draws order rows by a hash, so they repeat for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textops import as_col


def in_sample(key: Column | str, rate: float, salt: str = "") -> Column:
    """Whether the first 8 bytes of md5(salt|key), as a share of 2^64, are under the rate."""
    if rate >= 1:
        return F.lit(True)
    if rate <= 0:
        return F.lit(False)
    digest = F.md5(F.concat(F.lit(f"{salt}|"), as_col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(2.0**64) < F.lit(rate)


def draw(key: Column | str, seed: int | str) -> Column:
    """The key's place in a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|"), as_col(key).cast("string")))


def uniform_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """``size`` rows drawn evenly."""
    return df.orderBy(draw(key, seed), key).limit(size)


def sample_questions(items: DataFrame, size: int, seed: int, key: str = "question_id", position: str = "position") -> DataFrame:
    """``size`` questions in their original order; all of them if there are no more."""
    return items.orderBy(draw(key, seed), key).limit(size).orderBy(position)


def exact_text_dedup(df: DataFrame, order: list[str], cnr: str, text: str, target: int) -> DataFrame:
    """Rows with text whose number and trimmed text are both new in scan order; the first ``target`` of them.

    A number counts as seen only if its row was kept, as does a text, which is why first texts are looked for among
    first numbers.
    """
    from ..functions.textops import strip
    from .corpus import first_of

    rows = df.where(F.coalesce(strip(text), F.lit("")) != "")
    rows = rows.withColumn("__hash", F.sha1(strip(text)))
    rows = first_of(rows, cnr, order, "__a").where("__a OR __a IS NULL")
    rows = first_of(rows, "__hash", order, "__b").where("__b")
    return rows.orderBy(*order).limit(target).drop("__a", "__b", "__hash")


def cap_per_court(df: DataFrame, key: str, cap: int, total: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each court (code, else 4-character prefix of the number, else UNKNOWN), ``total`` in all."""
    court = F.coalesce(F.nullif(F.trim("court_code"), F.lit("")), F.nullif(F.substring("cnr", 1, 4), F.lit("")), F.lit("UNKNOWN"))
    ordered = Window.partitionBy("court").orderBy("__draw", key)
    rows = df.withColumns({"court": court, "__draw": draw(key, seed)})
    rows = rows.withColumn("__n", F.row_number().over(ordered)).where(F.col("__n") <= cap)
    return rows.orderBy("__draw", key).limit(total).drop("__draw", "__n")


def round_robin(df: DataFrame, group: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """Rows numbered within their group in shuffled order; the first ``size`` by (round, group)."""
    ordered = Window.partitionBy(group).orderBy(draw(key, seed), key)
    rows = df.withColumn("round", F.row_number().over(ordered)).where(F.col("round") <= size)  # as a rank, so that tasks keep so many rows
    return rows.withColumn("round", F.col("round") - 1).orderBy("round", group).limit(size)


def assign_quota(df: DataFrame, key: str, quotas: list[tuple[str, int]], seed: int = 0) -> DataFrame:
    """The first rows of a shuffled order are dealt out: so many to each kind, in the order given."""
    total = sum(n for _, n in quotas)
    rows = df.orderBy(draw(key, seed), key).limit(total)
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(draw(key, seed), key)))
    kind, upto = None, 0
    for name, n in quotas:
        upto += n
        test = F.col("place") <= upto
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return rows.withColumn("kind", kind)


def eligible_length(df: DataFrame, chars: Column, low: int = 500, high: int = 80_000) -> DataFrame:
    return df.where(chars.between(low, high))


def distinct_courts(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def label_sheet(answers: DataFrame, size: int, seed: int, key: str = "item_id") -> DataFrame:
    """Answered, not refused items without judge scores, with blank fields to fill in by hand."""
    rows = answers.where("generation_ok AND NOT refused")
    blank = lambda c: F.lit(None).cast("int").alias(c)
    return uniform_sample(rows, key, size, seed).select(
        key, "question", "answer", blank("answer_relevance"), blank("faithfulness"), blank("citation_correctness"),
        F.lit(None).cast("boolean").alias("hallucination"), F.lit("").alias("notes"),
    )


def short_order_sample(rows: DataFrame, court: str, most_chars: int, size: int, seed: int) -> DataFrame:
    """Records of one court under a length, drawn evenly, shortest first."""
    short = rows.where((F.col("court_code") == court) & (F.col("clean_chars") < most_chars))
    return uniform_sample(short, "cnr", size, seed).orderBy("clean_chars", "cnr")
