"""Line dedup over content-defined chunks of lines.

Each text is cut into chunks of lines. A rolling hash over the hashes of the last ``window`` lines decides whether a
chunk of at least two lines ends there, so boundaries follow the content: lines put in or taken out elsewhere do not
move them. A line of ``min_words`` words or more stands alone, since it is a passage by itself. Chunks of two or more
lines with text, and such single lines, are compared over the whole corpus; those that occur in two documents
are compared byte by byte before anything is removed, and every occurrence but the first goes.

A chunk starts with the lines in front of a passage, so chunks alone miss short passages and the ends of long ones.
With ``passages`` the shortest run of lines of ``min_words`` words from each line on, and the one up to each line, are
compared in the same way. Any run of whole lines with so many words that two documents share is then covered from its
first line to its last. A passage inside a longer line is not found.

A run is known by 64 bits made from the hashes of its lines. What is shuffled: pairs of 64-bit hashes (run, document) to
find the runs of two documents; places of runs, to join them with those; whole texts once, by document; and of the
repeated runs the bytes, combined on the map side (smallest and largest bytes of each hash: they are equal if all are).
Runs that share a hash without being equal are left alone. The ``HOT`` runs with most places are dealt out over ``SALTS``
keys each, so a line that stands in a third of all documents does not fill a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _P, _P_INVERSE, add_columns, blocks, mixed, ready_checkpoints, small_batches, table, text_bytes

HOT, SALTS = 1024, 64


class Lines:
    """Lines of many texts at once: ``lines``, the text ``row`` of each, its hash and number of words, ``first`` of each text."""

    def __init__(self, texts: list[bytes], min_words: int, divisor: int, window: int):
        import xxhash

        self.lines = b"\n".join(texts).split(b"\n") if texts else []
        n, self.min_words = len(self.lines), min_words
        sizes = np.array([x.count(b"\n") + 1 for x in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(texts)), sizes)
        self.hash = np.fromiter(map(xxhash.xxh64_intdigest, self.lines), np.uint64, n)
        self.words = np.fromiter(map(len, map(bytes.split, self.lines)), np.int64, n)
        place = np.arange(n) - self.first[self.row]
        rolled = self.hash.copy()
        for k in range(1, window):
            older = np.where(place >= k, np.concatenate([np.zeros(min(k, n), np.uint64), self.hash[: max(n - k, 0)]]), np.uint64(0))
            rolled ^= ((older << np.uint64(7 * k)) | (older >> np.uint64(64 - 7 * k))) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
        self.ends = (rolled * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(divisor) == 0

    def chunk_starts(self) -> np.ndarray:
        """The line each chunk starts with; chunks follow each other without gaps and do not cross texts."""
        starts: list[int] = []
        opened, closed = set(self.first[:-1].tolist()), True
        for k, (cut, alone) in enumerate(zip(self.ends.tolist(), (self.words >= self.min_words).tolist())):
            if closed or alone or k in opened:
                starts.append(k)
            closed = alone or (cut and k > starts[-1])
        return np.array(starts, np.int64)

    def runs(self, passages: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First line, line after the last, and hash of each run that takes part, each run once."""
        n = len(self.lines)
        starts = self.chunk_starts()
        ends = np.append(starts[1:], n)[: len(starts)]
        text = np.concatenate([[0], np.cumsum(self.words > 0)])
        used = (text[ends] - text[starts] >= 2) | (self.words[starts] >= self.min_words)
        begin, end = starts[used], ends[used]
        if passages and n:
            total = np.concatenate([[0], np.cumsum(self.words)])
            full = np.flatnonzero(self.words)
            on = np.searchsorted(total, total[full] + self.min_words)
            ok = on <= self.first[self.row[full] + 1]
            back = np.searchsorted(total, total[full + 1] - self.min_words, "right") - 1
            too = back >= self.first[self.row[full]]
            begin, end = np.concatenate([begin, full[ok], back[too]]), np.concatenate([end, on[ok], full[too] + 1])
            code = np.unique(begin * (n + 1) + end)
            begin, end = code // (n + 1), code % (n + 1)
        powers, inverse = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (_P, _P_INVERSE))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.hash) * powers[:n])])
        return begin, end, mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)).view(np.int64)


def line_chunks(text: bytes, min_words: int = 50, divisor: int = 2, window: int = 2) -> list[bytes]:
    """Chunks of one text in order; joined by line ends they are the text again."""
    seen = Lines([text], min_words, divisor, window)
    starts = seen.chunk_starts().tolist()
    return [b"\n".join(seen.lines[a:b]) for a, b in zip(starts, [*starts[1:], len(seen.lines)])]


FIELDS = [
    T.StructField("chunks", T.LongType()),
    T.StructField("chunks_removed", T.LongType()),
    T.StructField("bytes_removed", T.LongType()),
]


def line_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, divisor: int = 2, window: int = 2,
    passages: bool = False,
) -> DataFrame:
    """All rows and columns, the text without repeated chunks, and ``chunks, chunks_removed, bytes_removed``.

    With ``passages`` runs of lines of ``min_words`` words are compared as well as chunks; ``chunks_removed`` counts
    the chunks that lost lines. Of the places of a repeated chunk or run the first stays: smallest id (null ids first),
    then smallest place in the text; what repeats in that text takes no line of the first place. A chunk must occur in
    two different documents; repeats inside one document alone stay. Rows that repeat both id and text count as one
    document and come out alike. A null text has no chunks and stays null; an empty one stays empty. A text all of
    whose chunks are repeated becomes empty; the row stays. Texts of any length are handled whole, a long one by
    itself. Columns named like a result are replaced; all others come through whatever their names. An empty table
    stays empty.
    """
    small_batches(df.sparkSession)
    ready_checkpoints(df.sparkSession)
    cut = {"min_words": min_words, "divisor": divisor, "window": window}
    kept, out_schema = add_columns(df, FIELDS)
    text_at, out_names = kept.columns.index(text_col), out_schema.fieldNames()
    whole = F.struct(*[f"`{c}`" for c in kept.columns])
    base = kept.select(whole.alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"))
    narrow = kept.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    narrow = narrow.where(F.col("text").isNotNull())
    hash_ = T.StructField("h", T.LongType())
    number = [T.StructField("no", T.IntegerType()), T.StructField("end", T.IntegerType())]
    place_schema = T.StructType([*narrow.schema.fields[:2], hash_, *number])

    def parts(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        """Slices of a batch whose texts hold about 4 MB, and their texts (null: empty)."""
        for a, b in blocks(text_bytes(texts)[1], 1 << 22, 1 << 20):
            yield batch.slice(a, b - a), [x or b"" for x in texts.slice(a, b - a).cast(pa.binary()).to_pylist()]

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch, texts in parts(whole_batch, whole_batch.column(2)):
                seen = Lines(texts, **cut)
                begin, end, h = seen.runs(passages)
                row = seen.row[begin]
                at, least = pa.array(row), seen.first[row]
                arrays = [batch.column(0).take(at), batch.column(1).take(at), pa.array(h)]
                arrays += [pa.array((x - least).astype(np.int32)) for x in (begin, end)]
                yield pa.RecordBatch.from_arrays(arrays, place_schema.fieldNames())

    places = narrow.mapInArrow(places_of, place_schema)
    repeated = (
        places.select("h", F.xxhash64("id", "t").alias("doc"))
        .groupBy("h")
        .agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n"))
        .where("least <> most")
        .select("h", "n")
        .checkpoint()  # short rows; the plans below then read texts twice and not once for each use
    )
    hot = F.broadcast(repeated.orderBy(F.desc("n"), "h").limit(HOT).select("h", F.lit(True).alias("hot")))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int")).otherwise(0)

    def salted(runs: DataFrame, *columns: str) -> DataFrame:
        """A row for each salt under which places of a run may be found."""
        return runs.join(hot, "h", "left").select("h", *columns, F.explode(salts).alias("salt"))

    again = places.join(hot, "h", "left").withColumn("salt", salt).drop("hot").join(salted(repeated), ["h", "salt"])
    # The end is not needed here; with the same columns as below, the shuffled places are made once for both.
    firsts = again.groupBy("h").agg(F.min(F.struct("id", "t", "no", "end")).alias("first"))
    here = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t"))
    marks = again.join(salted(firsts, "first"), ["h", "salt"]).withColumn("first", F.when(here, F.col("first.no")).otherwise(-1))
    per_doc = marks.groupBy("id", "t").agg(F.collect_set(F.struct("no", "end", "first", "h")).alias("marks"))

    def by_document(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed({"id": "id2", "t": "t2"})
        return left.join(right, F.col("id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2")), how).drop("id2", "t2")

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch, texts in parts(whole_batch, whole_batch.column(0).flatten()[text_at]):
                h, chunk = [], []
                for text, wanted in zip(texts, batch.column(1).to_pylist()):
                    lines = text.split(b"\n")
                    for mark in wanted:
                        h.append(mark["h"])
                        chunk.append(b"\n".join(lines[mark["no"] : mark["end"]]))
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(chunk, pa.binary())], ["h", "chunk"])

    unequal = (
        by_document(base, per_doc, "inner")
        .select("row", "marks")  # whole rows, so that the shuffle of texts is that of the last step
        .mapInArrow(bytes_of, "h long, chunk binary")
        .groupBy("h")
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        .where("least <> most")
        .select("h")
    )
    spared = marks.join(salted(unequal), ["h", "salt"], "left_semi").groupBy("id", "t").agg(F.collect_set("h").alias("spared"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            columns = whole_batch.column(0).flatten()
            for a, b in blocks(text_bytes(columns[text_at])[1], 1 << 22, 1 << 20):
                own = [x.slice(a, b - a) for x in columns]
                texts = own[text_at].cast(pa.binary()).to_pylist()
                seen = Lines([x or b"" for x in texts], **cut)
                starts = seen.chunk_starts()
                owner = seen.row[starts]
                chunks = np.bincount(owner, minlength=b - a)
                gone = np.zeros(len(seen.lines), bool)
                lists = zip(*(whole_batch.column(k).slice(a, b - a).to_pylist() for k in (1, 2)))
                for k, (runs, left) in enumerate(lists):
                    least = int(seen.first[k])
                    for run in runs or ():
                        no, end, first = run["no"], run["end"], run["first"]
                        if no != first and not (left and run["h"] in left):
                            gone[least + (no if first < 0 else max(no, first + end - no)) : least + end] = True
                lost = np.bincount(owner[np.logical_or.reduceat(gone, starts)], minlength=b - a) if len(starts) else chunks
                removed = np.zeros(b - a, np.int64)
                for k in np.flatnonzero(lost).tolist():
                    first, last = int(seen.first[k]), int(seen.first[k + 1])
                    left_over = b"\n".join(x for x, o in zip(seen.lines[first:last], gone[first:last].tolist()) if not o)
                    removed[k] = len(texts[k]) - len(left_over)
                    texts[k] = left_over
                some = np.array([x is not None for x in texts], bool)
                own[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
                new = [pa.array(np.where(some, x, 0).astype(np.int64)) for x in (chunks, lost, removed)]
                yield pa.RecordBatch.from_arrays([*own, *new], out_names)

    marked = by_document(by_document(base, per_doc, "left"), spared, "left")
    return marked.select("row", "marks", "spared").mapInArrow(rebuild, out_schema)


def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, passages=True).select(
        "doc_id",
        "chunks",
        "chunks_removed",
        "bytes_removed",
        F.char_length("text").cast("long").alias("chars_left"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
