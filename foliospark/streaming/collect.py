"""Streams: collection that knows what it has seen, and results that resume.

There is no event time, so what has been seen grows with the keys. It is kept as tables of hashes, a part for each batch,
never as texts; a batch meets it by anti-joins, so no key goes through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.textops import strip

#: Columns of a batch besides those of the stream.
PLACE, CNR = "place_of_the_row", "hash_of_the_number"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _first(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key by its place; each task keeps the first ones of its own before they are shuffled."""
    first = Window.partitionBy(key).orderBy(PLACE)
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def stream_collect(
    source: DataFrame, sink: str, checkpoint: str, cnr: str = "cnr", text: str = "text", place: Column | None = None, shard_rows: int = 5000
) -> StreamingQuery:
    """Appends the first row of each number, and of these the first of each trimmed text, to numbered shards.

    Rows with a blank number or text are dropped. Of the rows of a batch the first by ``place`` (any text that sorts; by
    default the path and row of a file) counts; an earlier batch comes before a later one. A number is taken by its first
    row even if that one goes for its text. A restart goes on from the
    checkpoint; the numbers that its batches have taken lie beside it. Without one, the numbers and texts of the shards in
    the sink are what is known, so a run over the same source adds nothing that is there. Each batch reads the hashes of
    all earlier ones, so few large batches cost less than many small ones. Shards have ``shard_rows`` rows, but for the last one of a batch, and lie
    in run=r/batch=b/shard=n; n goes on from run to run. A batch that is run again writes the same shards anew.
    """
    spark = source.sparkSession
    if place is None:
        place = F.concat(F.col("_metadata.file_path"), F.lpad(F.col("_metadata.row_index").cast("string"), 20, "0"))
    names = [*source.columns, "text_hash"]
    rows = source.withColumn(PLACE, place).withColumn("text_hash", F.sha1(strip(text))).withColumn(CNR, F.sha1(strip(cnr)))
    rows = rows.where((F.coalesce(strip(text), F.lit("")) != "") & (F.coalesce(strip(cnr), F.lit("")) != ""))
    run = _run_number(spark, sink, checkpoint, _exists(spark, sink))
    batches = _collected(sink, run, f"{checkpoint}_numbers", cnr, names, shard_rows)
    return rows.writeStream.foreachBatch(batches).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _run_number(spark: SparkSession, sink: str, checkpoint: str, known: bool) -> int:
    """Number of the run that a checkpoint belongs to: written beside it at its first start."""
    path = f"{checkpoint}_run"
    if not _exists(spark, path):
        last = spark.read.parquet(sink).agg(F.max("run")).first()[0] if known else None
        spark.createDataFrame([(0 if last is None else int(last) + 1,)], "run int").coalesce(1).write.parquet(path)
    return spark.read.parquet(path).first()[0]


def _collected(sink: str, run: int, taken: str, cnr: str, names: list[str], shard_rows: int):
    """What is done with a batch: its new numbers go to ``taken``, the rows of theirs with new texts to the shards."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = None
        if _exists(spark, sink):
            old = spark.read.parquet(sink).where((F.col("run") < run) | ((F.col("run") == run) & (F.col("batch") < number)))
        new = _first(batch, CNR)
        if old is not None:
            new = new.join(old.where(F.col("run") < run).select(F.sha1(strip(cnr)).alias(CNR)), CNR, "left_anti")
        if _exists(spark, taken):
            seen = spark.read.schema(f"{CNR} string, batch int").parquet(taken).where(F.col("batch") < number)
            new = new.join(seen.select(CNR), CNR, "left_anti")
        new = new.persist()  # both the numbers and the rows
        try:
            new.select(CNR).write.mode("overwrite").parquet(f"{taken}/batch={number}")
            kept = _first(new, "text_hash")
            if old is not None:
                kept = kept.join(old.select("text_hash"), "text_hash", "left_anti")
            _write_shards(kept, old, f"{sink}/run={run}/batch={number}", names, shard_rows)
        finally:
            new.unpersist()

    return append


def _write_shards(rows: DataFrame, old: DataFrame | None, path: str, names: list[str], shard_rows: int) -> None:
    spark = rows.sparkSession
    batch = rows.repartitionByRange(PLACE).sortWithinPartitions(PLACE).withColumn("__part", F.spark_partition_id()).persist()
    try:
        counts = sorted(tuple(r) for r in batch.groupBy("__part").count().collect())  # one for each partition
        if not counts:
            return
        last = old.agg(F.max("shard")).first()[0] if old is not None else None
        first = 0 if last is None else last + 1
        starts, at = [], 0
        for part, n in counts:
            starts.append((part, at))
            at += n
        starts = F.broadcast(spark.createDataFrame(starts, "__part int, __start long"))
        inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        placed = batch.withColumn("__in", inside).join(starts, "__part")
        shard = F.lit(first) + F.floor((F.col("__start") + F.col("__in")) / shard_rows)
        out = placed.select(*names, shard.cast("int").alias("shard")).repartition("shard")
        out.write.mode("overwrite").partitionBy("shard").parquet(path)
    finally:
        batch.unpersist()


def stream_resume(
    spark: SparkSession, source: DataFrame, item: str, work, sink: str, checkpoint: str, settings: dict[str, str], retry: tuple[str, ...] = ()
) -> StreamingQuery:
    """Applies ``work`` (rows to rows with ``status``) to items that the sink has no finished record for.

    Records with a status in ``retry`` are worked on again. A sink that was started with other settings is refused.
    """
    wanted = sorted((str(k), str(v)) for k, v in settings.items())
    kept = f"{sink}_settings"
    if _exists(spark, kept):
        found = sorted((r[0], r[1]) for r in spark.read.parquet(kept).collect())
        if found != wanted:
            raise ValueError(f"the sink was started with other settings: {dict(found)}")
    else:
        spark.createDataFrame(wanted, "key string, value string").coalesce(1).write.parquet(kept)

    def append(batch: DataFrame, number: int) -> None:
        todo = batch
        if _exists(spark, sink):  # it does not before the first batch
            done = batch.sparkSession.read.parquet(sink).where(F.col("batch") != number)
            if retry:
                done = done.where(~F.col("status").isin(*retry))
            todo = batch.join(done.select(item), item, "left_anti")
        work(todo).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
