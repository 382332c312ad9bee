"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the average of the embeddings of its hashed subwords (byte 2-, 3- and 4-grams that stay inside a word,
with its edges). A linear softmax reads the language from that average. Since both are linear, embedding times
output layer is folded into one table with a row per bucket, so a prediction is the counts of a text's buckets times
that table: whole texts of any length go through in blocks of bytes.

Rejection is calibrated on labelled rows kept out of the training, and on texts made from some of them by shuffling their
letters, which look like no language. A second table holds the logarithms of the buckets' shares in each language: its
average over a text says how usual the text's subwords are in the predicted language, and a logistic curve turns that
into the chance that the text is of a learned language at all. The score is that chance times the confidence of the
softmax, whose temperature gives the kept-out rows their labels and the shuffled ones an even spread. A text is rejected
if its score is under half of what all but a stated share of the kept-out rows reach.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTERS, add_columns, blocks, hash_sample, hashed_ngrams, remainder, slices, small_batches, spaced, table, text_bytes

BITS, SIZES = 12, (2, 3, 4)
UNIT = 4096  #: shares are kept in units of 1 / UNIT


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: row and bucket of each subword of these rows."""
    text, starts = spaced(data, offsets, LETTERS)
    text = np.concatenate([np.full(1, 32, np.uint8), text])  # each row now starts with the space in front of it
    letter = text != 32
    row = np.append(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), len(starts) - 2)
    for size in SIZES:
        h = hashed_ngrams(text, size, BITS)
        n = len(h)
        ok = letter[:n] | letter[size - 1 : n + size - 1]
        for k in range(1, size - 1):
            ok &= letter[k : n + k]
        yield row[:n][ok], h[ok]


def stretches(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
    """First row, and the offsets of pieces from it on: many short rows, or one stretch of a row of over ``most`` bytes.

    A long row is cut between words, so that its subwords are those of the whole row.
    """
    for first, last in blocks(offsets, most):
        at, end = int(offsets[first]), int(offsets[last])
        while end - at > most and last == first + 1:
            cut = at + most
            while cut < end and len(gap := np.flatnonzero(LETTERS[data[cut : min(end, cut + most)]] == 32)) == 0:
                cut += most
            cut = min(end, cut + int(gap[0]) if cut < end else end)
            yield first, np.array([at, cut])
            at = cut
        yield first, np.concatenate([[at], offsets[first + 1 : last + 1]])


def subword_counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and last row of a block, and how often each bucket occurs in each of its rows."""
    held: tuple[int, int, np.ndarray] | None = None
    for first, ends in stretches(data, offsets):
        n = len(ends) - 1
        out = np.zeros((n, 1 << BITS))
        for row, h in subwords(data, ends):
            out += np.bincount((row << BITS) + h, minlength=n << BITS).reshape(n, -1)
        if held is not None and held[0] == first:
            out += held[2]
        elif held is not None:
            yield held
        held = (first, first + n, out)
    if held is not None:
        yield held


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter, dtype=np.int64)])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for k in np.flatnonzero(~out):
        piece = data[offsets[k] : offsets[k + 1]]
        if (piece >= 128).any():
            out[k] = any(c.isalpha() for c in piece.tobytes().decode("utf-8", "replace"))
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    scores: np.ndarray  #: bucket x language: embedding times output layer
    bias: np.ndarray
    temperature: float
    threshold: float
    usual: np.ndarray  #: bucket x language: logarithm of the bucket's share
    curve: tuple[float, float]  #: slope and middle of the chance over the average of ``usual``

    def confidence(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def judged(self, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language, and score, of rows of bucket shares."""
        p = self.confidence(shares @ self.scores + self.bias)
        best = p.argmax(1)
        usual = (shares @ self.usual)[np.arange(len(best)), best]
        return best, p.max(1) / (1 + np.exp(np.clip(-self.curve[0] * (usual - self.curve[1]), -50, 50)))

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of whole texts."""
        best, score = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1)
        for first, last, counts in subword_counts(data, offsets):
            best[first:last], score[first:last] = self.judged(counts / np.maximum(counts.sum(1), 1)[:, None])
        return best, score


def logistic(good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve between values of two kinds, each kind weighing the same (Newton steps).

    A little pull on the slope, in units of the spread, keeps it finite where the kinds do not overlap.
    """
    x = np.concatenate([good, bad])
    y = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    weight = np.concatenate([np.full(len(good), 0.5 / len(good)), np.full(len(bad), 0.5 / len(bad))])
    shift, spread = (good.mean() + bad.mean()) / 2, max(x.std(), 1e-9)
    z = np.column_stack([(x - shift) / spread, np.ones(len(x))])
    w, pull = np.array([1.0, 0.0]), np.array([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + np.diag(pull), z.T @ (weight * (y - p)) - pull * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(w[0]), 1e-3)
    return slope / spread, float(shift - w[1] / slope * spread)


def train(
    features: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], shuffled: np.ndarray, dim: int = 16, epochs: int = 30,
    rate: float = 0.5, batch: int = 32, seed: int = 7, keep: float = 0.999,
) -> LanguageModel:
    """SGD over averaged embeddings; each fourth row is kept out to fit temperature, curve and threshold.

    ``features`` are bucket shares in units of 1 / ``UNIT``; they stay 16-bit floats but for the rows of a batch. ``shuffled``
    are those of texts with shuffled letters.
    """
    rng = np.random.default_rng(seed)
    n, k = len(labels), len(languages)
    held = np.arange(n) % 4 == 3
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(n)
    emb = rng.normal(0, 1 / dim, (features.shape[1], dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (dim, k)).astype(np.float32), np.zeros(k, np.float32)
    norms = [np.linalg.norm(features[k : k + 256].astype(np.float32), axis=1) for k in range(0, n, 256)]
    scale = np.float32(1 / max(np.concatenate(norms)[fit].mean(), 1e-6))
    steps, done = epochs * (-(-len(fit) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            x, lr = features[rows].astype(np.float32) * scale, np.float32(rate * (1 - done / steps))
            hidden = x @ emb
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            d_hidden = p @ out.T
            out -= lr * (hidden.T @ p)
            bias -= lr * p.sum(0)
            emb -= lr * (x.T @ d_hidden)
            done += 1
    table_ = (emb @ out * (scale * UNIT)).astype(np.float32)
    check = np.flatnonzero(held) if held.any() else fit
    parts = np.array_split(check, max(1, len(check) // 256))
    z = np.concatenate([features[k].astype(np.float32) @ (table_ / UNIT) + bias for k in parts])

    usual = np.zeros((features.shape[1], k), np.float32)
    for c in range(k):
        rows = fit[labels[fit] == c]
        sums = sum((features[part].astype(np.float64).sum(0) for part in np.array_split(rows, max(1, len(rows) // 256))), np.zeros(features.shape[1]))
        usual[:, c] = np.log(0.98 * sums / max(sums.sum(), 1) + 0.02 / features.shape[1])
    rest = shuffled.astype(np.float32) / UNIT
    z, y = z.astype(np.float64), rest @ table_ + bias

    def loss(t: float) -> float:
        model = LanguageModel(languages, table_, bias, t, 0.0, usual, (1.0, 0.0))
        right = -np.log(np.maximum(model.confidence(z)[np.arange(len(check)), labels[check]], 1e-12)).mean()
        return float(right - (np.log(np.maximum(model.confidence(y), 1e-12)).mean() if len(y) else 0.0))

    t = min((2.0**e for e in np.arange(-6, 10.01, 0.25)), key=loss)
    if len(y):
        best = z.argmax(1)
        good = np.concatenate([((features[i].astype(np.float32) / UNIT) @ usual)[np.arange(len(i)), j] for i, j in zip(parts, np.split(best, np.cumsum([len(i) for i in parts])[:-1]))])
        curve = logistic(good, (rest @ usual)[np.arange(len(rest)), y.argmax(1)])
    else:
        curve = (0.0, 0.0)
    model = LanguageModel(languages, table_, bias, t, 0.0, usual, curve)
    judged = [model.judged(features[i].astype(np.float32) / UNIT) for i in parts]
    best, score = (np.concatenate([x[j] for x in judged]) for j in range(2))
    right = score[best == labels[check]]
    threshold = float(np.quantile(right, 1 - keep)) * 0.5 if len(right) else 0.0
    return LanguageModel(languages, table_, bias, t, min(threshold, 0.5), usual, curve)


def shuffled_letters(text: str) -> str:
    """The text with its letters in another order, which depends on the text alone; all other signs stay."""
    at = np.array([k for k, c in enumerate(text) if c.isalpha()], np.int64)
    signs = np.array(list(text), object)
    signs[at] = signs[np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace"))).permutation(at)]
    return "".join(signs)


def fit_language_model(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 500, most_rows: int = 8000, most_languages: int = 1000,
) -> LanguageModel | None:
    """A model from a bounded sample of labelled rows: at most ``per_language`` rows of each language.

    The sample takes the smallest hashes of the ids, so it is the same in every run. Each sampled text is read as
    a whole and becomes one row of bucket shares in 16-bit floats (8 KB) on the executors, for one in four ids another row
    of the text with shuffled letters; only those reach the driver. All languages together get ``most_rows`` rows at most, in even shares; beyond ``most_languages`` the
    most common ones are learned. None if there is no labelled text with a letter.
    """
    small_batches(df.sparkSession)
    ids = hash_sample(df, id_col, lang_col, per_language, most_rows, most_languages)
    rows = df.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__class"), F.col(text_col).alias("__text"))
    sample = rows.join(F.broadcast(ids), ["__id", "__class"], "left_semi")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [zlib.crc32(str(x).encode()) % 4 == 0 for x in batch.column(0).to_pylist()]
            other = batch.filter(pa.array(chosen, pa.bool_()))
            made = pa.array([shuffled_letters(x or "") for x in other.column(2).to_pylist()], pa.string())
            for rows_, column, false in ((batch, batch.column(2), False), (other, made, True)):
                for a, b, counts in subword_counts(*text_bytes(column)):
                    total = counts.sum(1)
                    some = total > 0
                    out = (counts[some] / total[some][:, None] * UNIT).astype(np.float16)
                    vectors, mask, part = pa.array([x.tobytes() for x in out], pa.binary()), pa.array(some), rows_.slice(a, b - a)
                    arrays = [part.column(0).filter(mask), part.column(1).filter(mask), vectors, pa.array([false] * len(vectors), pa.bool_())]
                    yield pa.RecordBatch.from_arrays(arrays, ["__id", "__class", "x", "shuffled"])

    schema = T.StructType([rows.schema["__id"], rows.schema["__class"], T.StructField("x", T.BinaryType()), T.StructField("shuffled", T.BooleanType())])
    both = sample.mapInArrow(shares, schema).toArrow().combine_chunks()
    got = both.filter(pc.invert(both.column("shuffled")))
    if not got.num_rows:
        return None
    vectors = sorted(both.filter(both.column("shuffled")).column("x").to_pylist())
    shuffled = np.frombuffer(b"".join(vectors), np.float16).reshape(len(vectors), 1 << BITS)
    langs = np.array(got.column("__class").to_pylist())
    languages = tuple(str(x) for x in sorted(set(langs.tolist())))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(len(langs), -1)
    ids_ = np.array([str(v) for v in got.column("__id").to_pylist()])
    order = np.lexsort((langs, ids_))
    labels = np.searchsorted(languages, langs)
    return train(x[order], labels[order], languages, shuffled)


FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
]


def identify(df: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """All columns of the table with ``lang_pred, score, rejected``; one row per row, no shuffle.

    ``lang_pred`` is ``und`` (score 0, rejected) if the text is null or has no letter, or if there is no model.
    Otherwise it is the likeliest language, and ``rejected`` says that its confidence is under the calibrated
    threshold. Of languages that are equally likely the first by name is taken. Each row stands for itself, so
    repeated rows come out alike and an empty table stays empty; texts of any length are read whole, in stretches
    of bounded size. Existing columns named like a result are replaced. Nothing but the text is read.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept, schema = add_columns(df, FIELDS)
    text = kept.columns.index(text_col)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text):
            n = batch.num_rows
            pred, score, out = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            if model is not None and n:
                data, offsets = text_bytes(batch.column(text))
                lettered = has_letter(data, offsets)
                best, score = model.judge(data, offsets)
                score = np.where(lettered, score, 0.0)
                pred = np.where(lettered, np.array(model.languages, object)[best], "und")
                out = ~lettered | (score < model.threshold)
            new = [pa.array(pred, pa.string()), pa.array(score), pa.array(out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)

    return kept.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs.where(remainder("doc_id", 3) != 1))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected"
    )
