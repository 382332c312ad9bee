"""Overlapping chunks of long texts; no shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import split_chunks


def chunk_documents(
    df: DataFrame, cnr: str = "cnr", text: str = "text", carry: tuple[str, ...] = (), size: int = 1200, overlap: int = 200,
    least: int = 100, id_form: str = "{cnr}_chunk_{i}", separators: tuple[str, ...] = ("\n\n", "\n", " ", ""),
) -> DataFrame:
    """``chunk_id, cnr, chunk_index, text`` and carried columns. Indexes count before short chunks go, so ids have gaps."""

    @F.pandas_udf("array<struct<i int, text string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"i": i, "text": c} for i, c in enumerate(split_chunks(t, size, overlap, separators)) if len(c) >= least]
                if t and len(t.strip()) >= least
                else []
                for t in texts
            ]
        )

    before, after = id_form.split("{cnr}")[0], id_form.split("{cnr}")[1].split("{i}")
    out = df.select(F.col(cnr).alias("cnr"), *carry, F.explode(cut(F.col(text))).alias("c"))
    chunk_id = F.concat(F.lit(before), F.col("cnr").cast("string"), F.lit(after[0]), F.col("c.i").cast("string"), F.lit(after[1]))
    return out.select(chunk_id.alias("chunk_id"), "cnr", F.col("c.i").alias("chunk_index"), F.col("c.text").alias("text"), *carry)


def window_chunks(df: DataFrame, cnr: str, text: str, size: int = 1200, step: int = 1000) -> DataFrame:
    """Plain windows of characters: chunk_id, cnr, chunk_index, chunk_start (from 0), chunk_end, text."""
    n = F.char_length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    out = df.select(F.col(cnr).alias("cnr"), F.col(text).alias("__t"), n.alias("__n"), F.posexplode(starts).alias("chunk_index", "chunk_start"))
    return out.select(
        F.concat(F.col("cnr").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "cnr", "chunk_index", "chunk_start",
        F.least(F.col("chunk_start") + size, F.col("__n")).alias("chunk_end"),
        F.substring("__t", F.col("chunk_start") + 1, F.lit(size)).alias("text"),
    )


def drop_short(chunks: DataFrame, least: int = 100) -> DataFrame:
    return chunks.where(F.char_length("text") >= least)


def chunk_stats(chunks: DataFrame, prefix: int = 4) -> DataFrame:
    """Chunks and distinct judgments by prefix of the number, with lengths."""
    n = F.char_length("text")
    return chunks.groupBy(F.substring(F.col("cnr").cast("string"), 1, prefix).alias("prefix")).agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("cnr").alias("judgments"), F.avg(n).alias("mean_length"), F.max(n).alias("max_length")
    )
