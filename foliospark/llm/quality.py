"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Features are byte 1-, 2- and 3-grams of the raw text (case and signs count), hashed into buckets; a text is the
vector of log(1 + count), of length one. A truncated SVD of labelled texts gives the latent space. The labelled
vectors, a bounded number of them, are broadcast; every document is compared with all of them in blocks of exact
cosine products, and its nearest neighbours vote for their labels with their similarity as weight. Labels are
sampled evenly, so votes are weighted back to the labels' true shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, blocks, hash_sample, hashed_ngrams, remainder, small_batches, spaced, table, text_bytes, windows, words_of

BITS, SIZES = 12, (1, 2, 3)
_BLANK = np.array([32 if c <= 32 else c for c in range(256)], np.uint8)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each bucket of n-grams occurs in each row."""
    n = len(offsets) - 1
    text, starts = spaced(data, offsets)
    row = np.repeat(np.arange(n), np.diff(starts))
    inside = np.ones(len(text), bool)
    inside[starts[1:] - 1] = False
    out = np.zeros((n, 1 << BITS))
    for size in SIZES:
        h = hashed_ngrams(text, size, BITS)
        ok = inside[: len(h)]
        for k in range(1, size):
            ok = ok & inside[k : len(h) + k]
        where = (row[: len(h)] << BITS) + h
        out += np.bincount(where[ok], minlength=n << BITS).reshape(n, -1)
    return out


def repeated_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row that say the word before them again, and words of each row."""
    n = len(offsets) - 1
    text, starts = spaced(data, offsets)
    first, _, word = words_of(_BLANK[text])
    owner = np.searchsorted(starts, first, "right") - 1
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[again], minlength=n), np.bincount(owner, minlength=n)


def features(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """log(1 + count) of the hashed n-grams of each row, scaled to length one; rows without text stay zero.

    One more component is the share of words that say the word before them again; then the length is one again. A
    row of over ``most`` bytes is read in stretches between words, whose counts add up.
    """
    if len(offsets) == 2 and offsets[1] - offsets[0] > most:
        counts, again, words = np.zeros((1, 1 << BITS)), 0, 0
        body = data[offsets[0] : offsets[1]]
        before = np.zeros(0, np.uint8)  # the last word and what follows it
        for a, b in windows(_BLANK[body], most):
            over = gram_counts(body, np.array([a, min(b + SIZES[-1] - 1, len(body))]))
            counts += over - _late(body, b)
            part = np.concatenate([before, body[a:b]])
            said, n = repeated_words(part, np.array([0, len(part)]))
            again, words = again + int(said[0]), words + int(n[0]) - (len(before) > 0)
            plain = _BLANK[part]
            last = np.flatnonzero(plain != 32)
            if len(last):
                gap = np.flatnonzero(plain[: last[-1]] == 32)
                before = part[gap[-1] + 1 if len(gap) else 0 :]
        said, n = np.array([again]), np.array([words])
    else:
        counts = gram_counts(data, offsets)
        said, n = repeated_words(data, offsets)
    out = unit(np.log1p(counts.astype(np.float32)))
    return unit(np.concatenate([out, (said / np.maximum(n, 1))[:, None].astype(np.float32)], 1))


def _late(body: np.ndarray, cut: int) -> np.ndarray:
    """Counts of n-grams that start at ``cut`` or later among the bytes that a stretch up to there reads beyond it."""
    return gram_counts(body, np.array([cut, min(cut + SIZES[-1] - 1, len(body))]))


def latent(x: np.ndarray, dim: int, seed: int = 5) -> np.ndarray:
    """Right singular vectors (features x dim) by a randomised SVD with power steps."""
    rng = np.random.default_rng(seed)
    dim = min(dim, *x.shape)
    y = x @ rng.normal(size=(x.shape[1], min(dim + 16, *x.shape))).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _ = np.linalg.qr(y)
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:dim].T.astype(np.float32)


@dataclass(frozen=True)
class Neighbours:
    space: np.ndarray  #: features x dim
    vectors: np.ndarray  #: labelled rows x dim, of length one
    labels: np.ndarray
    weights: np.ndarray  #: of each row's vote
    prior: float
    k: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the votes of the k nearest labelled rows; the prior where nothing is similar."""
        sims = unit(x @ self.space) @ self.vectors.T
        k = min(self.k, sims.shape[1])
        near = np.argpartition(-sims, min(k, sims.shape[1] - 1), axis=1)[:, : k + 1]
        value = np.take_along_axis(sims, near, 1)
        if near.shape[1] > k:  # the last one is the next in line; where it ties with a chosen one, the first labelled rows count
            tied = value[:, :k].min(1) == value[:, k]
            near = near[:, :k]
            near[tied] = np.argsort(-sims[tied], axis=1, kind="stable")[:, :k]
        votes = np.maximum(np.take_along_axis(sims, near, 1), 0) * self.weights[near]
        total = votes.sum(1)
        return np.where(total > 0, (votes * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.prior)


def fit_neighbours(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_label: int = 1500, dim: int = 64, k: int = 15,
) -> Neighbours | None:
    """A model from a bounded sample: at most ``per_label`` labelled documents of each label (0 and 1).

    Sampled texts are read as a whole and turned into feature vectors (16-bit floats, 8 KB) on the executors; only
    those reach the driver. Null labels and ids are left out; of several labels of an id the largest counts. None
    if no labelled document has text.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    counts = {r[0]: r[1] for r in known.groupBy("__label").count().collect()}
    ids = hash_sample(known, id_col, "__label", per_label)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    sample = rows.join(F.broadcast(ids), "__id").select("__id", "__text", "__class")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets):
                x = features(data, offsets[a : b + 1]).astype(np.float16)
                found = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), found], ["__id", "__class", "x"]
                )

    schema = T.StructType([rows.schema["__id"], ids.schema["__class"], T.StructField("x", T.BinaryType())])
    got = sample.mapInArrow(vectors, schema).toArrow()
    if not got.num_rows:
        return None
    y = np.array(got.column("__class").to_pylist())
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(len(y), -1).astype(np.float32)
    order = np.lexsort((y, [str(v) for v in got.column("__id").to_pylist()]))
    x, y = x[order], y[order]
    some = np.linalg.norm(x, axis=1) > 0
    x, y = x[some], y[some]
    if not len(y):
        return None
    space = latent(x, dim)
    share = {c: counts[c] / max(1, int((y == c).sum())) for c in counts}
    weights = np.array([share[c] for c in y.tolist()])
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return Neighbours(space, unit(x @ space), y.astype(np.float64), weights / weights.max(), prior, k)


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score_quality(df: DataFrame, model: Neighbours | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of the table with ``score, predicted``; one row per row, no shuffle.

    ``score`` is the share of label 1 among the neighbours' votes, ``predicted`` is 1 from ``threshold`` up. A null
    or empty text gets the labels' true share (0.5 without a model). Each row stands for itself, so repeated rows come
    out alike and an empty table stays empty; texts count whole, a long one in stretches of 1 MB. Of neighbours that are
    equally near, the first labelled ones vote. Columns named like a result are replaced.
    """
    small_batches(df.sparkSession)
    kept, schema = add_columns(df, FIELDS)
    text, names = kept.columns.index(text_col), schema.fieldNames()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            out = np.full(batch.num_rows, 0.5)
            for a, b in blocks(offsets) if known is not None else ():
                out[a:b] = known.scores(features(data, offsets[a : b + 1]))
            out = np.clip(out, 0.0, 1.0)
            new = [pa.array(out), pa.array((out >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)

    return kept.mapInArrow(run, schema)


def op7_quality_knn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit_neighbours(docs, labels.where(remainder("doc_id", 4) != 2))
    return score_quality(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted"
    )
