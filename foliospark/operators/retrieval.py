"""Retrieval for whole batches of questions: BM25, exact vector search, rank fusion, reranking."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import l2_normalize
from ..sources.stages import scratch, staged
from .inverted import InvertedIndex, rank_within, search_index, write_index


def _pairs(left: DataFrame, n_left: int, right: DataFrame, n_right: int) -> DataFrame:
    """Every block of one side beside every block of the other, each pair under a key (and so a task) of its own.

    left: ``block`` and its payload; right: ``other`` and its payload. A stated set of questions against all rows.
    """
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return left.withColumn("other", numbers(n_right)).join(right.withColumn("block", numbers(n_left)), ["block", "other"])


def _number(n_blocks: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_blocks)).cast("int")


def bm25_search(
    queries: DataFrame, chunks: DataFrame | None, k: int = 50, k1: float = 1.5, b: float = 0.75, chunk_id: str = "chunk_id",
    text: str = "text", position: str | None = None, index: InvertedIndex | None = None,
) -> DataFrame:
    """``question_id, rank, chunk_id, score`` for queries (question_id, query); questions without tokens get nothing.

    Without an ``index`` one is written to the shared folder first. Where fewer than ``k`` chunks score above 0, those
    without a match come next, by position. Scores equal to 9 digits are ties and go by position.
    """
    index = index or write_index(chunks, scratch(queries.sparkSession), chunk_id, text, position)
    return search_index(index, queries, k, k1, b)[0]


def normalize_index(vectors: DataFrame, chunk_id: str, embedding: str) -> DataFrame:
    """The vectors at length one, as floats."""
    return vectors.select(F.col(chunk_id).alias("chunk_id"), l2_normalize(embedding).cast("array<float>").alias("embedding"))


def check_embeddings(vectors: DataFrame, embedding: str) -> DataFrame:
    """Rows, smallest and largest width."""
    return vectors.agg(F.count(F.lit(1)).alias("rows"), F.min(F.size(embedding)).alias("min_dim"), F.max(F.size(embedding)).alias("max_dim"))


def _packed(df: DataFrame, n_blocks: int, name: str, number: str) -> DataFrame:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = {"id": rows["id"].to_numpy(), "v": np.array(rows["v"].tolist(), np.float64)}
        return pd.DataFrame({"dim": [key[1]], number: [key[0]], name: [pickle.dumps(held)]})

    rows = df.withColumn("number", _number(n_blocks, "id"))
    return rows.groupBy("number", F.size("v")).applyInPandas(pack, f"dim int, {number} int, {name} binary")


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 50, exclude_self: bool = False, block_rows: int = 4096) -> DataFrame:
    """Exact inner products of queries (id long, v array) and vectors (id long, v array): best ``k`` of each query.

    Both sides are packed into blocks of bounded size; each pair of blocks of one width is one matrix product that
    returns only its own best ``k``, so nothing but k rows for a query and block is shuffled.
    """
    n_left, n_right = (max(1, -(-x.count() // block_rows)) for x in (queries, vectors))
    q = _packed(queries, n_left, "queries", "block")
    v = _packed(vectors, n_right, "vectors", "other").withColumnRenamed("dim", "width")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left, right in zip(batch["queries"], batch["vectors"]):
                a, b = pickle.loads(left), pickle.loads(right)
                score = a["v"] @ b["v"].T
                if exclude_self:
                    score[a["id"][:, None] == b["id"][None, :]] = -np.inf
                rounded = np.round(score, 12)
                n = min(k, score.shape[1])
                least = np.partition(rounded, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
                row, at = np.nonzero((rounded >= least[:, None]) & np.isfinite(score))  # all that tie with the k-th
                order = np.lexsort((b["id"][at], -rounded[row, at], row))
                row, at = row[order], at[order]
                some = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, at = row[some], at[some]
                yield pd.DataFrame({"question_id": a["id"][row], "chunk_id": b["id"][at], "score": score[row, at]})

    hits = _pairs(q, n_left, v, n_right).where("dim = width").select("queries", "vectors")
    hits = hits.mapInPandas(multiply, "question_id long, chunk_id long, score double")
    return rank_within(hits, k, F.round("score", 12).desc(), F.col("chunk_id").asc()).select("question_id", "rank", "chunk_id", "score")


def union_ranked(lists: dict[str, DataFrame]) -> DataFrame:
    """Ranked lists (question_id, rank, chunk_id) as one table with ``system`` and its place ``list``."""
    out = None
    for place, (system, ranked) in enumerate(lists.items()):
        part = ranked.select("question_id", "rank", "chunk_id", F.lit(system).alias("system"), F.lit(place).alias("list"))
        out = part if out is None else out.unionByName(part)
    return out


def rrf_fuse(ranked: DataFrame, k: int = 60, top: int = 50) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists; ties go to what was seen first (earlier list, then rank)."""
    fused = ranked.groupBy("question_id", "chunk_id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen")
    )
    return rank_within(fused, top, F.round("score", 12).desc(), F.col("seen").asc()).select("question_id", "rank", "chunk_id", "score")


def attach_chunks(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids with text and other columns of the chunk table; unknown ids get nulls."""
    return ranked.join(chunks, "chunk_id", "left")


def in_full_batches(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The rows in frames whose lengths are multiples of ``size``, but for the last: rows wait over the ends of batches."""
    held = None
    for rows in batches:
        held = rows if held is None or not len(held) else pd.concat([held, rows], ignore_index=True)
        full = len(held) - len(held) % size
        if full:
            yield held.iloc[:full]
            held = held.iloc[full:]
    if held is not None and len(held):
        yield held


_LOADED: dict[str, object] = {}


def loaded(token: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in each Python worker for a token; those of other tokens go."""
    if token not in _LOADED:
        _LOADED.clear()
        _LOADED[token] = make()
    return _LOADED[token]


def score_pairs(df: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], batch_size: int = 32) -> DataFrame:
    """Adds ``score`` to rows with query and text; the scorer gets full batches in each task."""
    schema = T.StructType([*df.drop("score").schema.fields, T.StructField("score", T.DoubleType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in in_full_batches(batches, batch_size):
            scores: list[float] = []
            for a in range(0, len(rows), batch_size):
                part = rows.iloc[a : a + batch_size]
                scores += [float(x) for x in scorer(part["query"].tolist(), part["text"].tolist())]
            yield rows.assign(score=scores)[names]

    return df.drop("score").mapInPandas(run, schema)


def embed(df: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", batch_size: int = 32, kind: str = "float") -> DataFrame:
    """Adds ``embedding``: the encoder's vectors at length one; a null text is read as an empty one.

    Lengths are taken as doubles; ``kind`` (float or double) is what the numbers are kept as. A share of exactly 0.35 lies
    below it as a float, so numbers that are rounded later need doubles.

    ``make`` loads the encoder. It is called once in each Python worker, however many tasks that runs, and the encoder
    gets batches of ``batch_size`` texts, but for the last one of a task. A vector of zeros stays one.
    """
    token = uuid.uuid4().hex
    schema = T.StructType([*df.drop("embedding").schema.fields, T.StructField("embedding", T.ArrayType({"float": T.FloatType(), "double": T.DoubleType()}[kind]))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = loaded(token, make)
        for rows in in_full_batches(batches, batch_size):
            out = []
            for a in range(0, len(rows), batch_size):
                x = np.asarray(encode([t or "" for t in rows[text].iloc[a : a + batch_size]]), float)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                out += list(x.astype(np.float32 if kind == "float" else float))
            yield rows.assign(embedding=out)

    return df.drop("embedding").mapInPandas(run, schema)


def letter_encoder(dim: int = 8) -> Callable[[list[str]], np.ndarray]:
    """An encoder without a model: how many letters a to z of a text fall in each of ``dim`` classes, by their place."""
    place = np.full(256, dim)
    for c in range(26):
        place[97 + c] = place[65 + c] = c % dim

    def encode(texts: list[str]) -> np.ndarray:
        rows = [place[np.frombuffer(t.encode("utf-8", "replace"), np.uint8)] for t in texts]
        return np.array([np.bincount(r, minlength=dim + 1)[:dim] for r in rows], float)

    return encode


def overlap_scorer(queries: list[str], texts: list[str]) -> list[float]:
    """Share of the query's distinct words that the text holds; for tests and as a stand-in for a model."""
    import re

    out = []
    for q, t in zip(queries, texts):
        a, b = set(re.findall(r"\w+", (q or "").lower())), set(re.findall(r"\w+", (t or "").lower()))
        out.append(len(a & b) / len(a) if a else 0.0)
    return out


def rerank(pool: DataFrame, queries: DataFrame, chunks: DataFrame, scorer=overlap_scorer, k: int = 5, batch_size: int = 32) -> DataFrame:
    """Pool (question_id, chunk_id) rescored by the scorer; unknown ids go. A question that has candidates, none of
    them known, is an error; it is looked for among the ids, before any pair is scored."""
    pool = pool.select("question_id", "chunk_id")
    known = pool.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    lost = pool.select("question_id").distinct().join(known.select("question_id"), "question_id", "left_anti")
    if lost.limit(1).count():
        raise ValueError("some questions have candidates but none of them is in the chunk table")
    rows = pool.join(chunks.select("chunk_id", "text"), "chunk_id").join(queries.select("question_id", "query"), "question_id")
    scored = score_pairs(rows, scorer, batch_size)
    return rank_within(scored, k, F.round("score", 12).desc(), F.col("chunk_id").asc()).select("question_id", "rank", "chunk_id", "score")


def context_rows(ranked: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` ids of each question and system with their texts, nested in order of rank."""
    rows = attach_chunks(ranked.where(F.col("rank") <= k), chunks)
    items = F.struct("rank", "chunk_id", "text", "court_code", "decision_date")
    return rows.groupBy("question_id", "system").agg(F.sort_array(F.collect_list(items)).alias("context"))


def retrieve_all(queries: DataFrame, chunks: DataFrame, dense: DataFrame, scorer=overlap_scorer, k: int = 50, index: InvertedIndex | None = None) -> DataFrame:
    """bm25, dense, hybrid_rrf and hybrid_rerank lists of every question as one long table."""
    bm25 = staged(bm25_search(queries, chunks, k, index=index))
    lists = union_ranked({"bm25": bm25, "dense": dense})
    fused = staged(rrf_fuse(lists, top=k))
    again = rerank(fused.join(queries.select("question_id"), "question_id", "left_semi"), queries, chunks, scorer, k)
    out = None
    for system, ranked in (("bm25", bm25), ("dense", dense), ("hybrid_rrf", fused), ("hybrid_rerank", again)):
        part = ranked.select("question_id", F.lit(system).alias("system"), "rank", "chunk_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def retrieval_records(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """One record for each question: ``status``, ``systems`` (ids of each list by rank), ``context`` (first ``k`` texts).

    The status is ``error`` for a question without any list, else ``ok``; chunks has text, court_code, decision_date.
    """
    lists = ranked.groupBy("question_id", "system").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("list"))
    lists = lists.select("question_id", "system", F.transform("list", lambda x: x["chunk_id"]).alias("ids"))
    lists = lists.join(context_rows(ranked, chunks, k), ["question_id", "system"], "left")
    entry = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("system", c))))
    found = lists.groupBy("question_id").agg(entry("ids").alias("systems"), entry("context").alias("context"))
    status = F.when(F.col("systems").isNull(), "error").otherwise("ok").alias("status")
    return queries.select("question_id").join(found, "question_id", "left").select("question_id", status, "systems", "context")
