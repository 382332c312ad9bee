"""Evidence passages matched to chunks of the same judgment: exact, by word windows, by span, by similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textops
from ..functions.udfs import sequence_ratio

SIZES = (60, 40, 25, 15, 10)


def _sides(items: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = items.select("question_id", "cnr", textops.normalize_match("supporting_text").alias("passage")).where("passage <> ''")
    right = chunks.select("chunk_id", "cnr", "chunk_index", textops.normalize_match("text").alias("norm"))
    return left, right


def gold_exact(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, chunk_id: every chunk of the judgment that holds the whole normalised passage."""
    left, right = _sides(items, chunks)
    return left.join(right, "cnr").where(F.contains("norm", "passage")).select("question_id", "chunk_id")


def gold_window(items: DataFrame, chunks: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """question_id, chunk_id, size, place: for questions without an exact hit, windows of words instead.

    The largest window size with a hit wins, and all chunks hit at that size come in the order of their first hit.
    """
    left, right = _sides(items, chunks)
    left = left.join(gold_exact(items, chunks).select("question_id").distinct(), "question_id", "left_anti")
    left = left.withColumn("w", F.split("passage", " ")).withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    left = left.where(F.size("w") >= F.col("size"))
    step = F.greatest(F.lit(1), F.expr("size div 2"))
    left = left.withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"), step)))
    phrase = F.array_join(F.slice("w", F.col("pos") + 1, F.col("size")), " ")
    hits = left.select("question_id", "cnr", "size", "pos", phrase.alias("phrase")).join(right, "cnr").where(F.contains("norm", "phrase"))
    first = hits.groupBy("question_id", "size", "chunk_id").agg(F.min(F.struct("pos", "chunk_index")).alias("seen"))
    best = first.withColumn("best", F.max("size").over(Window.partitionBy("question_id"))).where("size = best")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("seen", "chunk_id"))
    return best.select("question_id", "chunk_id", "size", place.alias("place"))


def gold_span_overlap(items: DataFrame, documents: DataFrame, chunks: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """question_id, chunk_id: chunks of the judgment that overlap the span where the passage stands in the whole text.

    Case and white space do not count. Chunks are placed in the whole text by their own first occurrence. Questions
    without such a chunk get the first chunk that holds a window of the passage's words: largest size first, then the
    first place, moving on word by word.
    """
    same = lambda c: textops.normalize_match(c, punctuation=False)
    asked = items.select("question_id", "cnr", same("supporting_text").alias("p")).where("p <> ''")
    whole = documents.select("cnr", same("text").alias("t")).join(asked.select("cnr").distinct(), "cnr", "left_semi")
    parts = chunks.select("chunk_id", "cnr", "chunk_index", same("text").alias("c")).join(asked.select("cnr").distinct(), "cnr", "left_semi")
    spans = asked.join(whole, "cnr").select("question_id", "cnr", (F.instr("t", F.col("p")) - 1).alias("start"), F.char_length("p").alias("n"))
    placed = parts.join(whole, "cnr").select("cnr", "chunk_id", (F.instr("t", F.col("c")) - 1).alias("at"), F.char_length("c").alias("m"))
    hits = spans.where("start >= 0").join(placed.where("at >= 0"), "cnr").where("at < start + n AND at + m > start").select("question_id", "chunk_id").distinct()
    rest = asked.join(hits.select("question_id").distinct(), "question_id", "left_anti").withColumn("w", F.split("p", " "))
    rest = rest.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(F.size("w") >= F.col("size"))
    rest = rest.withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))))
    rest = rest.select("question_id", "cnr", "size", "pos", F.array_join(F.slice("w", F.col("pos") + 1, F.col("size")), " ").alias("phrase"))
    found = rest.join(parts, "cnr").where(F.contains("c", "phrase"))
    first = found.groupBy("question_id").agg(F.min(F.struct(-F.col("size"), "pos", "chunk_index", "chunk_id")).alias("x"))
    return hits.unionByName(first.select("question_id", "x.chunk_id"))


#: Classes of signs whose counts bound a similarity: each letter a to z, the blank, all digits; the rest is one more.
_CLASSES = (*"abcdefghijklmnopqrstuvwxyz", " ", "0123456789")


def sign_counts(text: Column) -> Column:
    """How often a text has signs of each class; an array of as many numbers as there are classes, and one."""
    n = F.char_length(text)
    each = [n - F.char_length(F.translate(text, c, "")) for c in _CLASSES]
    rest = n
    for c in each:
        rest = rest - c
    return F.array(*each, rest)


def _lowered(items: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    left = items.select("question_id", "cnr", low("supporting_text").alias("a"))
    right = chunks.select("chunk_id", "cnr", low("text").alias("b"))
    return left, right.join(left.select(F.col("cnr").alias("asked")).distinct(), F.expr("cnr = asked"), "left_semi")


def similar_pairs(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages beside the chunks of their judgment, lower-cased, with an upper bound of their similarity.

    Matching blocks share signs one to one, so the similarity is at most twice what both have in common, class by class,
    over both lengths. Counts are taken once for each passage and chunk, before they meet.
    """
    left, right = _lowered(items, chunks)
    left, right = left.withColumn("m", sign_counts(F.col("a"))), right.withColumn("n", sign_counts(F.col("b")))
    common = F.aggregate(F.zip_with("m", "n", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    length = F.char_length("a") + F.char_length("b")
    return left.join(right, "cnr").withColumn("bound", F.when(length == 0, F.lit(1.0)).otherwise(2.0 * common / length)).drop("m", "n")


def gold_similarity(items: DataFrame, chunks: DataFrame, least: float = 0.5, top: int = 1) -> DataFrame:
    """The chunks of the judgment that are most like the passage, from ``least`` up.

    A pair is compared only as long as it can still reach ``least``, by the signs that both hold and by the blocks found so
    far; the counts of signs are taken beside the comparison (those of ``similar_pairs`` cost more than they spare here).
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return sequence_ratio(a, b, least)

    left, right = _lowered(items, chunks)
    scored = left.join(right, "cnr").withColumn("score", ratio("a", "b")).where(F.col("score") >= least)
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("question_id", "rank", "chunk_id", "score")


def one_per_cnr(items: DataFrame, order: str = "question_id") -> DataFrame:
    first = Window.partitionBy("cnr").orderBy(order)
    return items.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
