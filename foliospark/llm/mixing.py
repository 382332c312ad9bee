"""Mixing sources to target weights by Pfair scheduling.

Rows of each source are dealt into blocks of ``block_rows``. Block k of a source with weight w may not start before
slot floor(k / w) and is due by slot ceil((k + 1) / w); each slot takes one block, the eligible one that is due
first. With weights that add up to one every slot is filled, no block is late, and after any number of slots each
source is less than one block away from its exact share.

Weights are read as fractions. With a common denominator P the schedule repeats after P slots, exactly, so only one
period is scheduled on the driver, whatever the size of the table; the slot of every row follows from its rank in
its source by arithmetic and a join with that small table. Weights whose common denominator is over ``most_slots``
are rounded to multiples of 1 / ``most_slots`` first (largest remainders, each source one slot at least), and
the schedule is exact for the rounded weights.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Production weights of the query and of the pipeline's stage; a source that is not named counts as their mean.
TARGET_WEIGHTS = {f"src{k}": 1.0 + k % 5 for k in range(20)}


def quotas(weights: dict[str, float], most_slots: int = 1 << 17) -> dict[str, int]:
    """Slots of a period for each source, in exactly the ratio of the weights if the period allows it."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    total = sum(exact.values())
    shares = {s: w / total for s, w in exact.items()}
    period = lcm(*[x.denominator for x in shares.values()])
    if period > most_slots:
        period = max(most_slots, len(shares))
    wanted = {s: x * period for s, x in shares.items()}
    out = {s: max(1, int(x)) for s, x in wanted.items()}
    gap = period - sum(out.values())
    if gap > 0:
        for s in sorted(wanted, key=lambda s: (out[s] - wanted[s], s))[:gap]:
            out[s] += 1
    while gap < 0:  # sources raised to one slot take it from those that are furthest above their share
        for s in sorted((s for s in wanted if out[s] > 1), key=lambda s: (wanted[s] - out[s], s))[:-gap]:
            out[s] -= 1
            gap += 1
    return out


def schedule(quota: dict[str, int]) -> list[str]:
    """The source of each slot of one period: earliest deadline first among released blocks."""
    period = sum(quota.values())
    waiting = [(0, s, 0) for s in sorted(quota)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // quota[s]), -quota[s], s, k))
        deadline, _, s, k = heapq.heappop(ready)
        assert slot < deadline, "a block is late"
        out.append(s)
        if k + 1 < quota[s]:
            heapq.heappush(waiting, ((k + 1) * period // quota[s], s, k + 1))
    return out


def mix(
    df: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id",
    block_rows: int = 16, most_slots: int = 1 << 17, bucket_rows: int = 512, group_buckets: int = 4096,
) -> DataFrame:
    """All rows and columns, with ``mix_source, mix_block, mix_slot, mix_row, mix_release, mix_deadline``.

    Reading by (mix_slot, mix_row) gives the mixture. Rows of a source come in the order of a hash of their values.
    Nothing is dropped or repeated: when a source runs out, its later slots stay empty and the others go on at
    their own pace. ``weights`` (positive; default: the same for each) may name sources that do not occur; sources
    that it leaves out get the mean of the weights given. Null and empty sources are one source. Null ids are
    ordered by their other values; repeated rows take places of their own. Texts are only hashed. Columns named like
    a result are replaced. An empty table stays empty. One row for each source reaches the driver.

    Ranks do not gather a source in one task: rows are ranked in buckets of the hash, of about ``bucket_rows`` rows
    whatever the size of the source, and a bucket's first rank is the count of the rows in the buckets before it,
    summed in groups of ``group_buckets`` buckets first.
    """
    spark = df.sparkSession
    clash = {"mix_source", "mix_block", "mix_slot", "mix_row", "mix_release", "mix_deadline"}
    kept = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in clash])
    hashed = [f"`{f.name}`" for f in kept.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = kept.select(F.struct(*[f"`{c}`" for c in kept.columns]).alias("row"), source.alias("mix_source"), F.xxhash64(*hashed).alias("hash"), F.col(id_col).alias("key"))
    sizes = {r[0]: r[1] for r in rows.groupBy("mix_source").count().collect()}
    given = {s: w for s, w in (weights or {}).items() if s in sizes}
    other = sum(given.values()) / len(given) if given else 1.0
    quota = quotas({s: given.get(s, other) for s in sizes}, most_slots) if sizes else {}
    period, seen, slots = sum(quota.values()) or 1, dict.fromkeys(quota, 0), []
    for slot, s in enumerate(schedule(quota)):
        slots.append((s, seen[s], slot))
        seen[s] += 1
    turns = F.broadcast(spark.createDataFrame(slots, "mix_source string, turn long, first long"))
    facts = [(s, quota[s], max(0, (n // bucket_rows).bit_length())) for s, n in sizes.items()]
    sources = F.broadcast(spark.createDataFrame(facts, "mix_source string, quota long, bits int"))

    rows = rows.join(sources, "mix_source")
    rows = rows.withColumn("bucket", F.expr("CASE WHEN bits = 0 THEN 0L ELSE shiftrightunsigned(hash, 64 - bits) END"))
    counts = rows.groupBy("mix_source", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.expr(f"bucket div {group_buckets}"))
    earlier = (Window.unboundedPreceding, -1)
    groups = counts.groupBy("mix_source", "group").agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("mix_source").orderBy("group").rowsBetween(*earlier))
    groups = groups.select("mix_source", "group", F.coalesce(whole, F.lit(0)).alias("base"))
    inner = F.sum("n").over(Window.partitionBy("mix_source", "group").orderBy("bucket").rowsBetween(*earlier))
    counts = counts.select("mix_source", "group", "bucket", F.coalesce(inner, F.lit(0)).alias("before")).join(groups, ["mix_source", "group"])
    offsets = counts.select("mix_source", "bucket", (F.col("base") + F.col("before")).alias("before"))
    inside = Window.partitionBy("mix_source", "bucket").orderBy("hash", "key")
    ranked = rows.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["mix_source", "bucket"])
    ranked = ranked.withColumn("place", F.col("place") + F.col("before")).withColumn("mix_block", F.expr(f"place div {block_rows}"))
    placed = ranked.withColumn("turn", F.expr("mix_block % quota")).join(turns, ["mix_source", "turn"])
    return placed.select(
        *[F.col("row")[c].alias(c) for c in kept.columns],
        "mix_source",
        "mix_block",
        F.expr(f"(mix_block div quota) * {period} + first").alias("mix_slot"),
        F.expr(f"place % {block_rows}").alias("mix_row"),
        F.expr(f"(mix_block * {period}) div quota").alias("mix_release"),
        F.expr(f"((mix_block + 1) * {period} + quota - 1) div quota").alias("mix_deadline"),
    )


def in_mixture_order(mixed: DataFrame) -> DataFrame:
    """The rows range-partitioned and sorted into the order of the mixture, without the helper columns."""
    helpers = ["mix_source", "mix_block", "mix_slot", "mix_row", "mix_release", "mix_deadline"]
    return mixed.repartitionByRange("mix_slot", "mix_row").sortWithinPartitions("mix_slot", "mix_row").drop(*helpers)


def op9_pfair_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, TARGET_WEIGHTS).select(
        "doc_id", "source", "mix_block", "mix_slot", "mix_row", "mix_release", "mix_deadline"
    )
