"""An inverted index as a stored table, and BM25 search over it that skips blocks of chunks.

The index is written once: chunks are dealt into blocks by a hash of their id, and a row holds the postings of one token in
one block, beside the pairs of token count and least length that bound their weight for any k1 and b. The table is
bucketed by block, so a search reads it without a shuffle, in this session or in a later one. A row without a token
lists all chunks of its block.

A search first adds up, from the bounds alone, what a block can reach for a question. The most promising blocks give each
question a k-th score to beat; only blocks that can still beat it are scored, each in one task for all its questions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import textops
from ..sources.stages import staged


def rank_within(df: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Rows 1 to ``k`` of each question in the given order, as ``rank``."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


@dataclass(frozen=True)
class InvertedIndex:
    """``postings`` (block, token, best, postings), ``terms`` (token, df, idf), and the corpus' figures.

    idf is ln(n - df + 0.5) - ln(df + 0.5); negative ones become a quarter of the mean idf.
    """

    spark: SparkSession
    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    blocks: int


def write_index(
    chunks: DataFrame, path: str, chunk_id: str = "chunk_id", text: str = "text", position: str | None = None,
    block_rows: int = 1024, buckets: int | None = None,
) -> InvertedIndex:
    """Write the index of a chunk table (ids, texts, and places that break ties; else ids do) below ``path``.

    Texts are cut into tokens once and shuffled once, by block. A block holds about ``block_rows`` chunks and is one
    key of that shuffle, so a common token is spread over all blocks. Null texts have no tokens, but count as chunks.
    """
    spark = chunks.sparkSession
    n_blocks = max(1, -(-chunks.count() // block_rows))
    buckets = buckets or min(n_blocks, 4096)
    words = textops.tokenize(text)
    docs = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(position or chunk_id).alias("position"), F.coalesce(words, F.array().cast("array<string>")).alias("tokens"))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(n_blocks)).cast("int")).repartition(buckets, "block")
    tokens = docs.select("block", "chunk_id", "position", F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("token"))
    counted = tokens.groupBy("block", "token", "chunk_id", "position", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    same = counted.groupBy("block", "token", "tf").agg(F.min("dl").alias("least"), F.collect_list(F.struct("position", "chunk_id", "dl", "tf")).alias("held"))
    rows = same.groupBy("block", "token").agg(F.collect_list(F.struct("tf", F.col("least").alias("dl"))).alias("best"), F.sort_array(F.flatten(F.collect_list("held"))).alias("postings"))
    name = f"inverted_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "block").sortBy("block").option("path", f"{path}/postings").saveAsTable(name)
    postings = spark.table(name)
    heads = postings.where("token IS NULL").select(F.explode("postings").alias("p"))
    n, size = heads.agg(F.count(F.lit(1)), F.coalesce(F.sum("p.dl"), F.lit(0))).first()
    terms = staged(postings.where("token IS NOT NULL").groupBy("token").agg(F.sum(F.size("postings")).alias("df")))
    terms = terms.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = terms.agg(F.avg("raw")).first()[0]
    idf = F.when(F.col("raw") < 0, F.lit(0.25 * floor)).otherwise(F.col("raw")) if floor is not None else F.col("raw")
    terms.select("token", "df", idf.alias("idf")).write.parquet(f"{path}/terms")
    spec = [(n, size / n if n else 0.0, n_blocks, buckets)]
    spark.createDataFrame(spec, "n long, avgdl double, blocks int, buckets int").coalesce(1).write.parquet(f"{path}/corpus")
    return read_index(spark, path, name)


def read_index(spark: SparkSession, path: str, name: str | None = None) -> InvertedIndex:
    """The index that was written below ``path``, by this session or another one."""
    n, avgdl, blocks, buckets = spark.read.parquet(f"{path}/corpus").first()
    if name is None:
        name = f"inverted_{uuid.uuid4().hex}"
        columns = spark.read.parquet(f"{path}/postings")._jdf.schema().toDDL()
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (block) SORTED BY (block) INTO {buckets} BUCKETS LOCATION '{path}/postings'")
    return InvertedIndex(spark, spark.table(name), spark.read.parquet(f"{path}/terms"), n, avgdl, blocks)


def _weight(tf: Column, dl: Column, k1: float, b: float, avgdl: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl or 1.0)))


def _scores(k: int, k1: float, b: float, avgdl: float, every: bool, kinds: tuple[pa.DataType, pa.DataType, pa.DataType]):
    """Best ``k`` chunks of a block for each of its questions; with ``every`` also those without a match, at score 0."""
    names = ["question_id", "chunk_id", "position", "score"]
    empty = pa.table({x: pa.array([], t) for x, t in zip(names, [*kinds, pa.float64()])})

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asked) or not len(block):
            return empty
        block, asked = block.combine_chunks(), asked.sort_by("question_id").combine_chunks()
        tokens = block.column("token").to_pylist()
        lists = block.column("postings").chunk(0)
        head = lists[tokens.index(None)].values
        ids, n = head.field("chunk_id"), len(head)
        flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        place = pc.index_in(flat.field("chunk_id"), value_set=ids).to_numpy()
        tf, dl = flat.field("tf").to_numpy().astype(np.float64), flat.field("dl").to_numpy()
        w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (avgdl or 1.0)))
        at = {t: (int(ends[j]), int(ends[j + 1])) for j, t in enumerate(tokens) if t is not None}
        questions = asked.column("question_id").chunk(0)
        number = questions.dictionary_encode().indices.to_numpy()
        words, share = asked.column("token").to_pylist(), asked.column("share").to_numpy()
        rows, hits, scores, first = [], [], [], 0
        for last in np.append(np.flatnonzero(np.diff(number)) + 1, len(number)).tolist():
            spans = [(*at[words[j]], share[j]) for j in range(first, last) if words[j] in at]
            if spans or every:
                total, seen = np.zeros(n), np.full(n, every)
                if spans:
                    where = np.concatenate([place[a:z] for a, z, _ in spans])
                    total = np.bincount(where, np.concatenate([w[a:z] * x for a, z, x in spans]), n)
                    seen |= np.bincount(where, minlength=n) > 0
                some = np.flatnonzero(seen)
                best = some[np.lexsort((some, -np.round(total[some], 9)))[:k]]
                rows += [first] * len(best)
                hits.append(best)
                scores.append(total[best])
            first = last
        if not rows:
            return empty
        best = pa.array(np.concatenate(hits))
        return pa.table([questions.take(pa.array(rows)), ids.take(best), head.field("position").take(best), pa.array(np.concatenate(scores))], names=names)

    return run


def search_index(
    index: InvertedIndex, queries: DataFrame, k: int = 50, k1: float = 1.5, b: float = 0.75, first: int = 2, broadcast_rows: int = 1_000_000
) -> tuple[DataFrame, DataFrame]:
    """``question_id, rank, chunk_id, score`` for queries (question_id, query), and ``question_id, blocks, scored``: how many
    blocks hold a token of a question, and how many of them were scored.

    Questions without tokens get nothing. Chunks without a match have score 0 and come by position, before chunks with
    a negative score. Scores equal to 9 digits are ties and go by position. Tokens and blocks are broadcast to narrow the
    reading only up to ``broadcast_rows`` of them (counted); beyond that the index is read whole, with the same result.
    """
    spark, postings = index.spark, index.postings
    asked = queries.select("question_id", F.explode(textops.tokenize("query")).alias("token"))
    asked = staged(asked.groupBy("question_id", "token").agg(F.count(F.lit(1)).alias("times")))
    wanted = asked.select("token").distinct()
    narrow = wanted.count() <= broadcast_rows
    known = index.terms.join(F.broadcast(wanted) if narrow else wanted, "token", "left_semi").select("token", "idf")
    shares = staged(asked.join(known, "token", "left").select("question_id", "token", F.coalesce(F.col("idf") * F.col("times"), F.lit(0.0)).alias("share")))

    bound = F.array_max(F.transform("best", lambda x: _weight(x["tf"], x["dl"], k1, b, index.avgdl)))
    metas = postings.where("token IS NOT NULL").select("block", "token", "best")
    metas = metas.join(F.broadcast(wanted), "token", "left_semi") if narrow else metas
    metas = metas.select("block", "token", bound.alias("top"))
    reach = metas.join(shares, "token").groupBy("question_id", "block").agg(F.sum(F.greatest(F.col("share") * F.col("top"), F.lit(0.0))).alias("reach"))
    order = Window.partitionBy("question_id").orderBy(F.desc("reach"), "block")
    reach = staged(reach.withColumn("turn", F.row_number().over(order)))

    schema = f"question_id {dict(queries.dtypes)['question_id']}, " + ", ".join(f"{c} {t}" for c, t in _fields(postings)) + ", score double"
    kinds = tuple(x.type for x in spark.createDataFrame([], schema).select("question_id", "chunk_id", "position").toArrow().schema)

    def scored(pairs: DataFrame, every: bool = False) -> DataFrame:
        rows = postings.select("block", "token", "postings")
        if narrow:
            rows = rows.join(F.broadcast(wanted.withColumn("asked", F.lit(True))), "token", "left").where("token IS NULL OR asked").drop("asked")
        if index.blocks <= broadcast_rows:
            rows = rows.join(F.broadcast(pairs.select(F.col("block").alias("at")).distinct()), F.expr("block = at"), "left_semi")
        requests = pairs.select("question_id", F.col("block").alias("at")).join(shares, "question_id")
        return rows.groupBy("block").cogroup(requests.groupBy("at")).applyInArrow(_scores(k, k1, b, index.avgdl, every, kinds), schema)

    best = (F.round("score", 9).desc(), F.col("position").asc())
    early = staged(rank_within(scored(reach.where(F.col("turn") <= first)), k, *best))
    beat = early.where(F.col("rank") == k).select("question_id", (F.col("score") - 1e-8).alias("beat"))
    rest = reach.where(F.col("turn") > first).join(beat, "question_id", "left").where("beat IS NULL OR reach >= beat")
    found = staged(rank_within(early.drop("rank").unionByName(scored(rest)), k, *best))

    above = found.where("score > 0").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    lacking = staged(asked.select("question_id").distinct().join(above, "question_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("question_id"))
    if lacking.limit(1).count():
        everywhere = lacking.join(postings.where("token IS NULL").select("block"))
        filled = rank_within(scored(everywhere, True), k, *best)
        found = found.join(lacking, "question_id", "left_anti").unionByName(filled)
    visits = reach.where(F.col("turn") <= first).select("question_id", "block").unionByName(rest.select("question_id", "block"))
    visits = reach.groupBy("question_id").agg(F.count(F.lit(1)).alias("blocks")).join(visits.groupBy("question_id").agg(F.count(F.lit(1)).alias("scored")), "question_id")
    return found.select("question_id", "rank", "chunk_id", "score"), visits


def _fields(postings: DataFrame) -> list[tuple[str, str]]:
    """Names and types of a posting's id and position."""
    item = postings.schema["postings"].dataType.elementType
    return [(x, item[x].dataType.simpleString()) for x in ("chunk_id", "position")]
