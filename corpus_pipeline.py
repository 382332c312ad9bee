"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, packing; each stage over all that the last one kept.

Every stage but the last returns the columns of its input (those of ``documents``); stages are written as Parquet
and read again by the next one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import ready_checkpoints
from foliospark.llm.language_id import fit_language_model, identify
from foliospark.llm.line_dedup import line_dedup
from foliospark.llm.mixing import TARGET_WEIGHTS, in_mixture_order, mix
from foliospark.llm.near_dedup import near_dedup
from foliospark.llm.packing import pack_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Pieces of a block of the packing stage.
BLOCK_ROWS = 8192


def hidden(docs: DataFrame) -> DataFrame:
    """The rows with columns beyond those of ``documents`` under numbered names, which no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in COLUMNS else f"column_{k}_of_input") for k, c in enumerate(docs.columns)])


def shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, under their own names and in their order."""
    return rows.select(*[F.col(c if c in COLUMNS else f"column_{k}_of_input").alias(c) for k, c in enumerate(docs.columns)])


def file_order(path: str) -> tuple[str, int, str]:
    """Folder, number of the part (-1 if the name has none) and name: part-99999 comes before part-100000."""
    folder, _, name = path.rpartition("/")
    part = re.search(r"part-(\d+)", name)
    return folder, int(part[1]) if part else -1, name


def with_places(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows with ``__place``: their number in the order of the files (``file_order``), from 0 on.

    A file is known by its whole path, so files of one name in two folders are two. Rows that come from no files are written to the shared folder first, so that a lost executor does not renumber them.
    One count for each file reaches the driver.
    """
    try:
        docs = docs.withColumns({"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})
    except AnalysisException:
        ready_checkpoints(spark)
        number = F.lpad(F.spark_partition_id().cast("string"), 10, "0")
        docs = docs.checkpoint().withColumns({"__file": number, "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    before, start = [], 0
    for name, n in sorted((tuple(r) for r in docs.groupBy("__file").count().collect()), key=lambda r: file_order(r[0])):
        before.append((name, start))
        start += n
    starts = F.broadcast(spark.createDataFrame(before, "__file string, __start long"))
    placed = docs.join(starts, "__file").withColumn("__place", F.col("__start") + F.col("__at"))
    return placed.drop("__file", "__at", "__start")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run has written."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID accepts; those without a letter (null, empty or blank texts too) or with a rejected
    prediction go. Repeated rows come out alike; rows without ``lang`` are not learned from, but judged like any other.
    """
    rows = hidden(docs)
    return shown(identify(rows, fit_language_model(rows)).where("NOT rejected"), docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines, ``n_chars`` following; a document all of whose text went goes too.

    A null text stays null, an empty one empty. Rows that repeat id and text are one document, and all of them stay.
    """
    cut = line_dedup(hidden(docs), passages=True)
    cut = cut.where(~((F.col("chunks_removed") > 0) & (F.trim(F.col("text")) == "")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast("long"))
    return shown(cut, docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word shingles, similarity of 0.8): smallest id, then place in the files.

    Rows are dropped one by one, so other rows of an id stay and repeated rows go; null ids come last. Null, empty
    and blank texts are copies of nothing and stay.
    """
    keyed = with_places(spark, hidden(docs))
    keyed = keyed.withColumn("__key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__place"))
    gone = near_dedup(keyed, id_col="__key", size=5, percent=80).where("NOT kept").select("doc_id.__place")
    return shown(keyed.join(gone, "__place", "left_anti"), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture to the target weights: range-partitioned and sorted files.

    Null and empty sources are one source, repeated rows take places of their own, an empty table stays empty.
    """
    return shown(in_mixture_order(mix(hidden(docs), TARGET_WEIGHTS)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in packed sequences of 2048: a row for each piece, with its place.

    Blocks are cut from the rows in the order of the files, which is that of the mixture. A null or empty text is one
    piece of one token; repeated rows have pieces of their own.
    """
    return pack_documents(with_places(spark, hidden(docs)), with_ids=True, place_col="__place", block_rows=BLOCK_ROWS)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL cannot express the trained model, the hashes that cut chunks, nor the packing search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again.

    A stage's folder is removed when the next one is written; the last one holds the result and stays.
    """
    ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
