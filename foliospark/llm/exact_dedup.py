"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

A Misra-Gries sketch (Spark's frequent-items sketch, which keeps a fixed number of counters and lowers all of
them when it is full) finds digests that may be frequent. Each group of input partitions has a sketch; summaries
are merged by adding the counters of equal keys and keeping the largest, so no task gathers whole sketches. Candidates are then counted exactly; those that do repeat are the winners, at
most ``counters`` rows, which are broadcast: their rows are settled where they are read and never shuffled. All
other digests are rare by the sketch's guarantee, and go through one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequent_digests(digests: DataFrame, counters: int = 1024) -> DataFrame:
    """At most ``counters`` keys (column ``__key``), among them each one with a share over 4/``counters``."""
    sketched = (
        digests.select("__key", (F.spark_partition_id() % 256).alias("__part"))
        .groupBy("__part")
        .agg(F.expr(f"approx_top_k(__key, {counters}, {counters})").alias("__items"))
        .select(F.explode("__items").alias("__item"))
    )
    return (
        sketched.groupBy(F.col("__item.item").alias("__key"))
        .agg(F.sum("__item.count").alias("__count"))
        .orderBy(F.desc("__count"), "__key")
        .limit(counters)
        .select("__key")
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest id
    stays. A null id is smaller than any other; a group in which every id is null keeps all its rows (keep_id
    null). Rows that repeat both id and text are the same row twice: all of them carry the same verdict. Texts of
    any length count whole; only their digests are shuffled. An empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("__hex")
    ).select("doc_id", F.unhex("__hex").alias("__digest"))
    rows = rows.withColumn("__key", F.xxhash64("__digest"))
    candidates = F.broadcast(frequent_digests(rows, counters))
    winners = (
        rows.join(candidates, "__key", "left_semi")
        .groupBy("__digest")
        .agg(F.max("doc_id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
        .where("__size > 1")
    )
    tagged = rows.drop("__key").join(F.broadcast(winners), "__digest", "left")
    hot = tagged.where("__size IS NOT NULL")
    group = Window.partitionBy("__digest")
    cold = (
        tagged.where("__size IS NULL")
        .select("__digest", "doc_id")
        .select(
            "__digest",
            "doc_id",
            F.max("doc_id").over(group).alias("__keep"),
            F.count(F.lit(1)).over(group).alias("__size"),
        )
    )
    return hot.select(*cold.columns).unionByName(cold).select(
        "doc_id",
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def op1_exact_dedup(spark, sf_dir):
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
