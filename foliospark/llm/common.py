"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stages import ready_checkpoints  # noqa: F401

#: ASCII bytes that are letters, lower-cased; every other ASCII byte becomes a space; UTF-8 bytes stay.
LETTERS = np.array(
    [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Large arrays of Python workers go back to the system when they are freed, and do not stay with idle workers.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the bytes of the Arrow batches that go to Python workers, unless the session has set a bound itself.

    Spark's own bound of 64 MB is held several times over, outside the heap, by each task.
    """
    for name, value in MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864b", "64m"):
        spark.conf.set(key, size)


#: Bytes of a row group of a stored table, looked at after every row: a writer holds one whole, and a reader a batch of 4,096
#: rows of one, so rows of several MB (blocks) would otherwise stand in memory by the dozen, the more the larger a task is.
GROUP = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a stored table with row groups of about 8 MB."""
    df.write.options(**GROUP).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(modulus)


def add_columns(df: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    """The frame without columns that new ones replace (names compare without case), and the new schema."""
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    return df.select(*[f"`{f.name}`" for f in kept]), T.StructType(kept + fields)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, most: int = 1 << 18, rows: int = 128) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows that hold about ``most`` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), first + rows, n)
        yield first, last
        first = last


def spaced(data: np.ndarray, offsets: np.ndarray, mapping: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows one after another with a space after each one, mapped byte by byte; and where each row starts."""
    lengths = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(starts[-1], 32, np.uint8)
    body = data[offsets[0] : offsets[-1]]
    if len(lengths) == 1:  # a long row has no array of places
        out[:-1] = body if mapping is None else mapping[body]
        return out, starts
    out[np.arange(len(body)) + np.repeat(np.arange(len(lengths)), lengths)] = body if mapping is None else mapping[body]
    return out, starts


def hashed_ngrams(data: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram of ``size`` bytes that starts at each place (fewer places at the end)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = data[:n].astype(np.uint32) + np.uint32(size * 0x9E37)
    for k in range(1, size):
        h *= np.uint32(0x01000193)
        h ^= data[k : n + k]
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - bits)


_BYTE = np.random.default_rng(20240607).integers(0, 2**64, 256, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 2**64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over all of them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = text != 32
    first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    end = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    powers = np.cumprod(np.full(len(text), _P, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[text] * powers)])
    inverse = np.cumprod(np.full(len(text), _P_INVERSE, np.uint64))
    return first, end, mixed((total[end] - total[first]) * inverse[first] + (end - first).astype(np.uint64))


def windows(text: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes that end in front of a byte 32, so that no word is cut; a longer word stays whole."""
    at, n = 0, len(text)
    while at < n:
        cut = at + most
        while cut < n and not len(gap := np.flatnonzero(text[cut : cut + most] == 32)):
            cut += most
        cut = cut + int(gap[0]) if cut < n else n
        yield at, cut
        at = cut


def words_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of a text of bytes in which 32 separates words.

    The hash is that of a polynomial over the word's bytes, read off sums over windows of the text.
    """
    if len(text) <= 1 << 21:
        return _words(text)
    parts = [(a, *_words(text[a:b])) for a, b in windows(text)]
    return np.concatenate([a + x for a, x, _, _ in parts]), np.concatenate([a + x for a, _, x, _ in parts]), np.concatenate([x for *_, x in parts])


def hash_sample(
    df: DataFrame, id_col: str, class_col: str, per_class: int, most_rows: int = 8000, most_classes: int = 1000
) -> DataFrame:
    """``__id, __class`` of at most ``per_class`` rows of each class: those whose ids have the smallest hashes.

    Classes are counted first. The sample as a whole is bounded by ``most_rows``: where there are many classes, each
    gets an even share of that, one row at least; of more than ``most_classes`` classes the most common ones are
    sampled (ties to the smaller one). Of a class of n rows only those with a hash in the lowest 4 * per_class / n of
    the range are ranked (4 * per_class rows or so), so a common class does not fill a task.
    """
    ids = df.select(F.col(id_col).alias("__id"), F.col(class_col).alias("__class"), F.xxhash64(id_col).alias("__hash"))
    ids = ids.where("__id IS NOT NULL AND __class IS NOT NULL")
    counts = ids.groupBy("__class").count().orderBy(F.desc("count"), "__class").limit(most_classes).collect()
    per_class = min(per_class, max(1, most_rows // max(1, len(counts))))
    below = [(value, (2 * min(1.0, 4 * per_class / n) - 1) * 2.0**63) for value, n in counts]
    schema = T.StructType([ids.schema["__class"], T.StructField("__below", T.DoubleType())])
    limits = F.broadcast(df.sparkSession.createDataFrame(below, schema))
    first = Window.partitionBy("__class").orderBy("__hash", "__id")
    ids = ids.join(limits, "__class").where(F.col("__hash").cast("double") <= F.col("__below"))
    ids = ids.withColumn("__rank", F.row_number().over(first))
    return ids.where(F.col("__rank") <= per_class).select("__id", "__class").distinct()


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts hold about ``most`` bytes, so that what is made of a slice stays small."""
    for batch in batches:
        for first, last in blocks(text_bytes(batch.column(column))[1], most, 1 << 20):
            yield batch.slice(first, last - first)
