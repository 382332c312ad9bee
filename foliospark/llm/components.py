"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready_checkpoints


HOT, SALTS = 1024, 64


def _smallest(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (v, u) with m, the smallest of v and all that v is linked to.

    Where links fill more than one task, those of the nodes that have most of them are dealt out over several keys.
    """
    least = edges.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")).select("v", F.least("v", "m").alias("m"), "n")
    if parts == 1:
        return edges.join(least.drop("n").coalesce(1), "v").coalesce(1)
    hot = F.broadcast(least.orderBy(F.desc("n"), "v").limit(HOT).select("v", F.lit(True).alias("hot")))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    least = least.join(hot, "v", "left").select("v", "m", F.explode(salts).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")).otherwise(0)
    return edges.join(hot, "v", "left").withColumn("salt", salt).join(least, ["v", "salt"]).select("v", "u", "m").coalesce(parts)


def components(links: DataFrame, part_rows: int = 200_000) -> DataFrame:
    """``node, label`` for each node of the links ``a, b`` (longs): the smallest node of its component.

    Each step is two grouped minima joined back, so a node with very many links is combined on the map side and
    dealt out by a salt; labels settle in about the logarithm of the longest chain. Self-links are ignored. Steps
    run in as many tasks as ``part_rows`` links to a task give, so that a small table does not leave thousands of
    small shuffle files.
    """
    ready_checkpoints(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    edges, seen = edges.checkpoint(), None
    parts = max(1, -(-edges.count() // part_rows))
    edges = edges.coalesce(parts)
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _smallest(both, parts).where("u > v AND u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        down = _smallest(large.distinct().coalesce(parts), parts)
        small = down.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = small.unionByName(down.select("v", F.col("m").alias("u"))).distinct().coalesce(parts).checkpoint()
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct().coalesce(parts)
    return edges.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(roots)
