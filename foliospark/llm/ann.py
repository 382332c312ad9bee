"""Approximate nearest neighbours by inner product on a robust-pruned directed graph.

Vectors are dealt by hash into shards; each shard's graph is built in one task. Points enter in batches: a greedy
beam search in the graph so far proposes neighbours, and robust pruning keeps a diverse few of them (a neighbour
goes if one kept already is nearer to it by the factor ``alpha``); reverse edges are pruned in the same way. Inner
products become distances by one more component that gives all vectors the same length. Searches start at points far
from each other; what cannot be reached from them gets links, and each shard measures how wide a beam it needs. Queries, in blocks of
bounded size, run a beam search through every shard, and what the beams hold is scored on the original vectors in
double precision.

Equal vectors are one point of a graph, with the smallest ids that carry it: ties go to smaller ids, so no other of
its rows could be among the results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

DEGREE, BEAM, ALPHA, WIDE = 24, 64, 1.2, 8


def beam_search(
    points: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` points with the largest products that a greedy search finds for each query, and the products.

    All queries advance together: each step expands the best ``WIDE`` points of every beam that are not yet
    expanded. -1 fills beams that hold fewer points.
    """
    nq, n = len(queries), len(points)
    ids = np.full((nq, beam), -1, np.int64)
    score = np.full((nq, beam), -np.inf, np.float32)
    done = np.ones((nq, beam), bool)
    seen = np.zeros((nq, n), bool)
    k = min(len(start), beam)
    ids[:, :k] = start[:k]
    score[:, :k] = queries @ points[start[:k]].T
    done[:, :k] = False
    seen[:, start[:k]] = True
    active = np.arange(nq)
    while len(active):
        waiting = np.where(done[active], -np.inf, score[active])
        picks = np.argpartition(-waiting, min(WIDE, beam) - 1, axis=1)[:, :WIDE]
        live = np.isfinite(np.take_along_axis(waiting, picks, 1))
        more = live.any(1)
        active, picks, live = active[more], picks[more], live[more]
        if not len(active):
            break
        at = np.take_along_axis(ids[active], picks, 1)
        done[active[:, None], picks] = True
        near = np.where(live[:, :, None], graph[np.where(live, at, 0)], -1).reshape(len(active), -1)
        ok = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        order = np.argsort(np.where(ok, near, n), axis=1, kind="stable")
        near, ok = np.take_along_axis(near, order, 1), np.take_along_axis(ok, order, 1)
        ok[:, 1:] &= near[:, 1:] != near[:, :-1]
        rows, cols = np.nonzero(ok)
        seen[active[rows], near[rows, cols]] = True
        found = np.full(near.shape, -np.inf, np.float32)
        found[rows, cols] = np.einsum("ij,ij->i", points[near[rows, cols]], queries[active[rows]])
        all_ids = np.concatenate([ids[active], np.where(ok, near, -1)], 1)
        all_score = np.concatenate([score[active], found], 1)
        all_done = np.concatenate([done[active], ~ok], 1)
        best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        score[active] = np.take_along_axis(all_score, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
    return ids, score


def robust_prune(points: np.ndarray, at: np.ndarray, candidates: np.ndarray, norm2: float) -> np.ndarray:
    """Up to DEGREE of each row's candidates (-1: none), nearest first, without those that a kept one covers."""
    out = np.full((len(at), DEGREE), -1, np.int64)
    order = np.argsort(candidates, axis=1)
    candidates = np.take_along_axis(candidates, order, 1)
    alive = (candidates >= 0) & (candidates != at[:, None])
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    vectors = points[np.maximum(candidates, 0)]

    def distance(product: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * norm2 - 2 * product, 0))

    own = distance(np.einsum("ijk,ik->ij", vectors, points[at]))
    rows = np.arange(len(at))
    for k in range(DEGREE):
        if not alive.any():
            break
        best = np.where(alive, own, np.inf).argmin(1)
        has = alive[rows, best]
        out[has, k] = candidates[rows, best][has]
        between = distance(np.einsum("ijk,ik->ij", vectors, vectors[rows, best]))
        alive &= ~(has[:, None] & (ALPHA * between <= own))
        alive[rows, best] = False
    return out


def build_graph(points: np.ndarray, norm2: float, batch: int = 512, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Out-neighbours of each point (n x DEGREE, -1 where fewer) and the points where searches start."""
    n = len(points)
    graph = np.full((n, DEGREE), -1, np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    middle = int((points @ points.mean(0)).argmax())
    order = np.concatenate([[middle], order[order != middle]])
    start = order[:1]
    entered = 1
    while entered < n:
        new = order[entered : entered + min(batch, max(entered, 16))]
        found, _ = beam_search(points, graph, start, points[new], BEAM)
        if entered < 4 * DEGREE:  # the first points are all candidates for each other
            found = np.concatenate([found, np.broadcast_to(order[:entered], (len(new), entered))], 1)
        kept = robust_prune(points, new, found, norm2)
        graph[new] = kept
        rows, cols = np.nonzero(kept >= 0)
        to, back = kept[rows, cols], new[rows]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, count)
        wide = np.full((len(targets), DEGREE + int(count.max())), -1, np.int64)
        wide[:, :DEGREE] = graph[targets]
        wide[np.repeat(np.arange(len(targets)), count), DEGREE + rank] = back
        full = (wide >= 0).sum(1) > DEGREE
        simple = np.sort(wide[~full], axis=1)[:, ::-1][:, :DEGREE]
        graph[targets[~full]] = simple
        for a in range(0, int(full.sum()), 1024):
            some = np.flatnonzero(full)[a : a + 1024]
            graph[targets[some]] = robust_prune(points, targets[some], wide[some], norm2)
        entered += len(new)
    return graph, order[: min(n, 8)]


def spread_starts(points: np.ndarray, first: np.ndarray, most: int = 48) -> np.ndarray:
    """The given starts and points far from all before them, one after the other, so that each group of points has one."""
    chosen = first.tolist()
    nearest_ = (points @ points[chosen].T).max(1)
    while len(chosen) < min(most, len(points)):
        far = int(nearest_.argmin())
        if far in chosen:
            break
        chosen.append(far)
        nearest_ = np.maximum(nearest_, points @ points[far])
    return np.array(chosen)


def connected(points: np.ndarray, graph: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The graph with further links where some points cannot be reached from the starts: a point that can gets one to the
    nearest that cannot, again and again. Lists grow as they must; -1 fills them."""
    n, reached = len(points), np.zeros(len(points), bool)
    front, more = np.unique(start), [[] for _ in range(n)]
    reached[front] = True
    while True:
        while len(front):
            near = np.unique(graph[front])
            front = near[near >= 0]
            front = front[~reached[front]]
            reached[front] = True
        lost = np.flatnonzero(~reached)
        if not len(lost):
            break
        there = np.flatnonzero(reached)
        product = points[there] @ points[lost[0]]
        more[int(there[product.argmax()])].append(int(lost[0]))
        front = lost[:1]
        reached[front] = True
    width = max(map(len, more))
    if not width:
        return graph
    extra = np.full((n, width), -1, np.int64)
    for k, links in enumerate(more):
        extra[k, : len(links)] = links
    return np.concatenate([graph, extra], 1)


def enough_beam(points: np.ndarray, scaled: np.ndarray, graph: np.ndarray, start: np.ndarray, beam: int, k: int, recall: float) -> int:
    """The smallest of ``beam``, twice it, and so on, that finds a share ``recall`` of the true ``k`` best of a sample of the
    graph's own points, and half of them for nine in ten; at most all points."""
    n, k = len(points), min(k, len(points))
    some = np.unique(np.linspace(0, n - 1, min(n, 64)).astype(int))
    asked = np.concatenate([scaled[some], np.zeros((len(some), 1))], 1).astype(np.float32)
    true = np.partition(asked @ points.T, n - k, axis=1)[:, n - k]
    while beam < n:
        _, score = beam_search(points, graph, start, asked, beam)
        share = (score >= true[:, None] - 1e-6 * np.abs(true[:, None])).sum(1) / k
        if np.minimum(share, 1).mean() >= recall and np.quantile(share, 0.1) >= 0.5:
            break
        beam *= 2
    return min(beam, max(n, 2))


def _best_rows(g: dict, found: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best rows of one graph for each query, out of the points its beam holds (-1: none).

    Points are ordered by exact score and then by their smallest id before anything is cut. Each of the first k + 1
    points has a row other than the query's own that comes before all rows of the points behind it.
    """
    some = np.maximum(found, 0)
    exact = np.where(found >= 0, np.einsum("qbd,qd->qb", g["v"][some], v), -np.inf)
    smallest = np.array([x[0] for x in g["ids"]], np.int64)
    order = np.lexsort((smallest[some], -exact), axis=1)[:, : k + 1]
    point, score = np.take_along_axis(some, order, 1).ravel(), np.take_along_axis(exact, order, 1).ravel()
    query = np.repeat(np.arange(len(ids)), order.shape[1])
    real = np.isfinite(score)
    point, score, query = point[real], score[real], query[real]
    sizes = np.array([len(g["ids"][p]) for p in point], np.int64)
    rows = np.concatenate([g["ids"][p] for p in point]) if len(point) else np.zeros(0, np.int64)
    query, score = np.repeat(query, sizes), np.repeat(score, sizes)
    other = rows != ids[query]
    rows, query, score = rows[other], query[other], score[other]
    order = np.lexsort((rows, -score, query))
    rows, query, score = rows[order], query[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return pd.DataFrame({"query_id": ids[query[kept]], "vec_id": rows[kept], "score": score[kept]})


def nearest(
    df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    shard_rows: int = 8192, block_rows: int = 2048, beam: int = 128, group_blocks: int = 16, shard_bytes: int = 1 << 26,
    recall: float = 0.93,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows found for each query, other than the query's own id.

    Score is the inner product in double precision; ties go to the smaller id. Null ids, and vectors that are null,
    empty, zero or hold a null or non-finite component, take no part; vectors are compared with those of the same
    width. Rows that repeat id and vector count once. Extra columns are not read. Fewer than ``k`` candidates give
    fewer rows, an empty side none. Shards and blocks of queries hold fewer rows where vectors are so wide that they
    would take more than ``shard_bytes``. A shard's beam starts at ``beam`` and is doubled until a sample of its own points
    finds the share ``recall`` of their true neighbours, up to a search of the whole shard.
    """

    def usable(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))

    (n, width), (n_asked, wide) = (x.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector_col)), F.lit(0))).first() for x in (df, queries))
    n_shards = max(1, -(-n // max(1, min(shard_rows, shard_bytes // (16 * max(width, 1))))))
    n_blocks = max(1, -(-n_asked // max(1, min(block_rows, shard_bytes // (16 * max(wide, 1))))))
    first = Window.partitionBy("v").orderBy("id")
    points = (
        usable(df)
        .withColumn("__rank", F.dense_rank().over(first))
        .where(F.col("__rank") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_set("id")).alias("ids"))
        .select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(n_shards)).alias("shard"), "ids", "v")
    )

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        original = np.array(rows["v"].tolist(), np.float64)
        order = np.lexsort(original.T[::-1])
        original, ids = original[order], [np.asarray(x, np.int64) for x in rows["ids"].iloc[order]]
        scale = np.abs(original).max()
        scaled = original / scale
        square = (scaled**2).sum(1)
        longest = float(square.max())
        lifted = np.concatenate([scaled, np.sqrt(np.maximum(longest - square, 0))[:, None]], 1).astype(np.float32)
        graph, start = build_graph(lifted, longest)
        start = spread_starts(lifted, start)
        graph = connected(lifted, graph, start)
        wide = enough_beam(lifted, scaled, graph, start, beam, k + 1, recall)
        kept = {"v": original, "points": lifted, "ids": ids, "graph": graph.astype(np.int32), "start": start, "beam": wide}
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "graph": [pickle.dumps(kept)]})

    # A number of partitions of their own, so that small shards are not put together in one task.
    graphs = points.repartition(4 * n_shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, graph binary")

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = {"id": rows["id"].to_numpy(np.int64), "v": np.array(rows["v"].tolist(), np.float64)}
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "queries": [pickle.dumps(held)]})

    asked = usable(queries).distinct()
    asked = asked.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).alias("block"), "id", "v")
    blocks = asked.groupBy("dim", "block").applyInPandas(gather, "dim int, block long, queries binary")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for graph, block in zip(batch["graph"], batch["queries"]):
                g, q = pickle.loads(graph), pickle.loads(block)
                points_, links = g["points"], g["graph"].astype(np.int64)
                step = max(1, 256 * 128 // max(g["beam"], 128))
                for a in range(0, len(q["id"]), step):
                    ids, v = q["id"][a : a + step], q["v"][a : a + step]
                    scaled = v / np.abs(v).max(1, keepdims=True)
                    asked_ = np.concatenate([scaled, np.zeros((len(v), 1))], 1).astype(np.float32)
                    found, _ = beam_search(points_, links, g["start"], asked_, min(g["beam"], max(len(points_), 2)))
                    yield _best_rows(g, found, ids, v, k)

    # Each shard meets each group of blocks in a task of its own, whatever the number of widths.
    shards, groups = (F.explode(F.expr(f"sequence(0L, {n - 1}L)")) for n in (n_shards, -(-n_blocks // group_blocks)))
    left = graphs.withColumn("group", groups)
    right = blocks.select("dim", F.expr(f"block div {group_blocks}").alias("group"), "queries", shards.alias("shard"))
    pairs = left.join(right, ["dim", "shard", "group"]).select("graph", "queries")
    hits = pairs.mapInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op10_graph_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
