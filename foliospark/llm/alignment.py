"""Cross-tokenizer alignment: common ends of the tokens of two tokenizers, by hash sets of cumulative byte ends.

Where a token of each tokenizer ends at the same byte, the text is cut into groups; ids that share a group are linked.
Both tokenizers cut where another sign is followed by a blank or a line end, and where a letter is followed by a mark
(looked up in the vocabulary), so a text is read as the pieces between such places: a piece has the same ids wherever
it stands, and a worker does not read again what it remembers. Inside a piece the ends of the first tokenizer's tokens are keys of a dictionary to token numbers, so are those of the second; the sorted
keys of both slice the two id lists into groups, and links are expanded slice by slice, equal ids at once.

How many documents hold a pair of ids is counted over the corpus. Documents are read once, in blocks, and their links
are kept in the shared folder as numbers into the block's sorted pairs; only a block's distinct pairs are shuffled, for
the counts and for the answers that go back to it.
"""

from __future__ import annotations

import hashlib
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stages import scratch
from .common import small_batches, table, written
from .packing import encoder, slow_encoder

#: A letter, as far as the search for cuts goes: signs of words without digits.
_LETTER = "[^\\W\\d_¹²³]"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Signs of a block of documents, and of a stretch of a longer text; pieces that are read at once; what a worker remembers:
#: pieces (some 500 bytes each), and bytes of their texts, groups and links.
BLOCK, AT_ONCE, REMEMBERED, BYTES = 1 << 21, 1 << 14, 160_000, 1 << 26


def default_vocabularies() -> tuple[str, str, str]:
    """Rank file and JSON form of the first vocabulary, model file of the second."""
    import public_tokenizers

    return tuple(public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def aligned(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of each tokenizer end at or before each byte at which tokens of both end, in order."""
    a_at = dict(zip(a_ends, range(1, len(a_ends) + 1)))
    b_at = dict(zip(b_ends, range(1, len(b_ends) + 1)))
    common = sorted(a_at.keys() & b_at.keys())
    return [*map(a_at.__getitem__, common)], [*map(b_at.__getitem__, common)]


def links(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of ids that share a slice (first id << 32 | second id), how often, and the number of the slice.

    Slices end at ``a_at`` and ``b_at``. Those with many pairs are expanded by different ids.
    """
    a_from, b_from = np.append(0, a_at[:-1]), np.append(0, b_at[:-1])
    wide, high = a_at - a_from, b_at - b_from
    size = np.where(wide * high <= 4096, wide * high, 0)
    of = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    keys = [a[a_from[of] + k // high[of]] << 32 | b[b_from[of] + k % high[of]]]
    times, slices_ = [np.ones(len(of), np.int64)], [of]
    for g in np.flatnonzero((size == 0) & (wide * high > 0)).tolist():
        x, n = np.unique(a[a_from[g] : a_at[g]], return_counts=True)
        y, m = np.unique(b[b_from[g] : b_at[g]], return_counts=True)
        keys.append((x[:, None] << 32 | y).ravel())
        times.append((n[:, None] * m).ravel())
        slices_.append(np.full(len(x) * len(y), g))
    return np.concatenate(keys), np.concatenate(times), np.concatenate(slices_)


class Tokenizers:
    """Both tokenizers with the bytes of their tokens. The second one gets texts with the blank that it would add."""

    def __init__(self, ranks: str, whole: str, model: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.ranks, self.whole = ranks, whole
        first = encoder(ranks)
        self.a_bytes = {k: first.decode_single_token_bytes(k) for k in range(first.n_vocab)}
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as file:
            proto.ParseFromString(file.read())
        proto.normalizer_spec.add_dummy_prefix = False
        self.second = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        names = [self.second.id_to_piece(k) for k in range(len(self.second))]
        self.b_bytes = [bytes([int(m[1], 16)]) if self.second.is_byte(k) and (m := _BYTE.fullmatch(x)) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        self.a_sizes = np.array([len(self.a_bytes[k]) for k in range(len(self.a_bytes))])
        self.b_sizes = np.array([*map(len, self.b_bytes)])
        self.place = self._cuts([x.replace("▁", " ") for k, x in enumerate(names) if not (self.second.is_byte(k) or self.second.is_control(k) or self.second.is_unknown(k))])

    @staticmethod
    def _cuts(names: list[str]) -> re.Pattern | None:
        """Places at which no token of either tokenizer goes on: those that no piece of the second one goes across."""
        ways = [rf"(?<=\S)(?={x})" for x in (" ", "\n") if not any(re.search(f"[^{x}]{x}", n) for n in names)]
        marks = [c for c in string.punctuation if c != "_" and not any(re.search(_LETTER + re.escape(c), n) for n in names)]
        ways += [f"(?<={_LETTER})(?=[{re.escape(''.join(marks))}])"] if marks else []
        return re.compile("|".join(ways)) if ways else None

    def first_ids(self, text: str) -> list[int]:
        try:
            return encoder(self.ranks).encode_ordinary(text)
        except ValueError:  # the pattern gives up on a million blanks in a row
            slow = slow_encoder(self.whole)
            slow.encode_special_tokens = True
            return slow.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def tokenizers(ranks: str, whole: str, model: str) -> Tokenizers:
    return Tokenizers(ranks, whole, model)


class Pieces(dict):
    """Number of each piece read so far, and what is known of it by that number."""

    def __init__(self, both: Tokenizers) -> None:
        self.both, self.new = both, []
        self.sizes = array("q")  # tokens of both, groups, links, and whether the bytes agree; five numbers a piece
        self.texts: list[str] = []
        self.keys, self.times, self.ends = array("q"), array("q"), array("q", [0])
        self.used = np.zeros(0, np.int64)  # in how many texts each piece stood, halved from time to time
        self.held = 0  # bytes of the texts and groups

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        self.new.append(piece)
        return k

    def numbers(self, pieces: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        new, self.new = self.new, []
        for k in range(0, len(new), AT_ONCE):
            self.read(new[k : k + AT_ONCE])
        return out

    def use(self, numbers: np.ndarray) -> None:
        if len(self.used) < len(self):
            self.used = np.concatenate([self.used, np.zeros(len(self) - len(self.used) + AT_ONCE, np.int64)])
        self.used[numbers] += 1

    def full(self) -> bool:
        return len(self) > REMEMBERED or self.held + 16 * len(self.keys) > BYTES

    def forget(self) -> Pieces:
        """The half of the pieces that stood in most texts (of half the bytes at most), with new numbers."""
        out = Pieces(self.both)
        ends = np.frombuffer(self.ends, np.int64)
        widths, names = np.diff(ends), [*self]
        used = np.concatenate([self.used, np.zeros(max(0, len(self) - len(self.used)), np.int64)])[: len(self)]
        order = np.argsort(-used, kind="stable")[: REMEMBERED // 2]
        sizes = [len(names[k]) + len(self.texts[k]) for k in order.tolist()]
        order = order[np.cumsum(np.array(sizes, np.int64) + 16 * widths[order]) <= BYTES // 2]
        for k in order.tolist():
            out[names[k]] = len(out)
            out.texts.append(self.texts[k])
            out.held += len(names[k]) + len(self.texts[k])
        out.sizes.frombytes(np.frombuffer(self.sizes, np.int64).reshape(-1, 5)[order].tobytes())
        after = np.cumsum(widths[order])
        place = np.arange(int(widths[order].sum())) + np.repeat(ends[order] - (after - widths[order]), widths[order])
        out.keys.frombytes(np.frombuffer(self.keys, np.int64)[place].tobytes())
        out.times.frombytes(np.frombuffer(self.times, np.int64)[place].tobytes())
        out.ends.frombytes(after.astype(np.int64).tobytes())
        out.used = used[order] // 2
        return out

    def read(self, pieces: list[str]) -> None:
        """Read pieces that are not known yet, one behind the other: their ends are bytes of all of them."""
        both = self.both
        a_lists, b_lists = [both.first_ids(x) for x in pieces], both.second.encode(pieces, num_threads=1)
        a_bytes, b_bytes = both.a_bytes.__getitem__, both.b_bytes.__getitem__
        good = np.ones(len(pieces), bool)
        for k, piece in enumerate(pieces):
            data = piece.encode()
            if b"".join(map(b_bytes, b_lists[k])) != data or b"".join(map(a_bytes, a_lists[k])) != data:
                good[k], a_lists[k], b_lists[k] = False, [], []
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_lists, b_lists))
        a_count, b_count = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_lists, b_lists))
        a_at, b_at = aligned(np.cumsum(both.a_sizes[a]).tolist(), np.cumsum(both.b_sizes[b]).tolist())
        a_said, b_said = [*map(str, a.tolist())], [*map(str, b.tolist())]
        said = [",".join(a_said[w:x]) + "|" + ",".join(b_said[y:z]) for w, x, y, z in zip(chain((0,), a_at), a_at, chain((0,), b_at), b_at)]
        a_at, b_at = np.array(a_at, np.int64), np.array(b_at, np.int64)
        of = np.searchsorted(np.cumsum(a_count), a_at)  # the piece of each group
        groups = np.bincount(of, minlength=len(pieces))
        keys, times, slices_ = links(a, b, a_at, b_at)
        of = of[slices_]
        order = np.argsort(of, kind="stable")
        self.keys.frombytes(keys[order].tobytes())
        self.times.frombytes(times[order].tobytes())
        ends = np.cumsum(np.bincount(of, minlength=len(pieces))) + self.ends[-1]
        self.ends.frombytes(ends.tobytes())
        n_links = np.bincount(of, times, len(pieces)).astype(np.int64)
        self.sizes.frombytes(np.column_stack([a_count, b_count, groups, n_links, good]).astype(np.int64).tobytes())
        at = np.cumsum(groups).tolist()
        texts = [";".join(said[x:y]) for x, y in zip(chain((0,), at), at)]
        self.texts.extend(texts)
        self.held += sum(map(len, pieces)) + sum(map(len, texts))


@lru_cache(maxsize=1)
def remembered(vocabularies: tuple[str, str, str]) -> list[Pieces]:
    """What this worker has read with these vocabularies, in a list of one so that it can be replaced."""
    return [Pieces(tokenizers(*vocabularies))]


def stretches(text: str, place: re.Pattern | None, most: int = BLOCK) -> Iterator[list[str]]:
    """The pieces of a blank and the text, in stretches of about ``most`` signs; one piece if it may not be cut."""
    text, at = " " + text, 0
    while place and len(text) - at > most and (cut := place.search(text, at + most)):
        yield place.split(text[at : cut.start()])
        at = cut.start()
    rest = text[at:] if at else text
    yield place.split(rest) if place else [rest]


def read_block(known: Pieces, texts: list[str | None]) -> dict:
    """Numbers of each text (tokens of both, groups, links), its digest, and its links as numbers into sorted pairs."""
    n = len(texts)
    sizes, digests = np.zeros((n, 4), np.int64), [""] * n
    rows, numbers, often = [], [], []
    for row, text in enumerate(texts):
        if not text:
            continue
        digest, total, held = hashlib.sha256(), np.zeros(5, np.int64), []
        for k, pieces in enumerate(stretches(text, known.both.place)):
            found = known.numbers(pieces)
            total += np.frombuffer(known.sizes, np.int64).reshape(-1, 5)[found].sum(0) - [0, 0, 0, 0, len(found)]
            if total[4]:  # some piece has other bytes than the text
                break
            digest.update((";" if k else "").encode() + ";".join(map(known.texts.__getitem__, found.tolist())).encode())
            held.append(np.unique(found, return_counts=True))
            known.use(held[-1][0])
        if not total[4]:
            sizes[row], digests[row] = total[:4], digest.hexdigest()
            for some, counts in held:
                rows.append(np.full(len(some), row))
                numbers.append(some)
                often.append(counts)
    if not rows:
        return {"sizes": sizes, "digests": digests, "pairs": np.zeros(0, np.int64), "held": np.zeros(0, np.int64), "ends": np.zeros(n + 1, np.int64), "links": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
    row, piece, count = np.concatenate(rows), np.concatenate(numbers), np.concatenate(often)
    ends = np.frombuffer(known.ends, np.int64)
    widths = ends[piece + 1] - ends[piece]
    before = np.cumsum(widths) - widths
    place = np.arange(int(widths.sum())) - np.repeat(before - ends[piece], widths)
    pairs, link = np.unique(np.frombuffer(known.keys, np.int64)[place], return_inverse=True)
    times = np.frombuffer(known.times, np.int64)[place] * np.repeat(count, widths)
    key, where = np.unique(np.repeat(row, widths) * len(pairs) + link, return_inverse=True)
    times = np.bincount(where, times, len(key)).astype(np.int64)
    row, link = np.divmod(key, len(pairs))
    return {
        "sizes": sizes, "digests": digests, "pairs": pairs, "held": np.bincount(link, minlength=len(pairs)),
        "ends": np.searchsorted(row, np.arange(n + 1)), "links": link, "times": times,
    }


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _doc_type(id_type: pa.DataType) -> pa.StructType:
    ints = pa.list_(pa.field("element", pa.int64()))
    return pa.struct([("id", id_type), *[(x, pa.int64()) for x in NUMBERS], ("groups_sha256", pa.string()), ("links", ints), ("times", ints)])


def aligned_blocks(df: DataFrame, id_col: str, text_col: str, vocabularies: tuple[str, str, str]) -> DataFrame:
    """A row for each block of documents: its number, its documents with their links, its distinct pairs and in how many
    of its documents each is."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    longs = T.ArrayType(T.LongType())
    doc = T.StructType([rows.schema["id"], *[T.StructField(x, T.LongType()) for x in NUMBERS], T.StructField("groups_sha256", T.StringType()), T.StructField("links", longs), T.StructField("times", longs)])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(doc)), T.StructField("pairs", longs), T.StructField("held", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = remembered(vocabularies), TaskContext.get().partitionId() << 32
        ids: list[pa.Scalar] = []
        texts: list[str | None] = []
        signs, id_type = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal block, ids, texts, signs
            if held[0].full():
                held[0] = held[0].forget()
            got = read_block(held[0], texts)
            ends = pa.array(got["ends"], pa.int32())
            kind = _doc_type(id_type)
            columns = [pa.array(ids, id_type), *[pa.array(got["sizes"][:, k]) for k in range(4)], pa.array(got["digests"], pa.string())]
            columns += [pa.ListArray.from_arrays(ends, pa.array(got[x])) for x in ("links", "times")]
            docs = pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(columns, kind, strict=True)], fields=list(kind))
            whole = [pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), docs)]
            whole += [pa.ListArray.from_arrays(pa.array([0, len(got[x])], pa.int32()), pa.array(got[x])) for x in ("pairs", "held")]
            block, ids, texts, signs = block + 1, [], [], 0
            return pa.RecordBatch.from_arrays(whole, ["block", "docs", "pairs", "held"])

        for batch in batches:
            id_type = batch.column(0).type
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                if texts and signs + len(text or "") > BLOCK:
                    yield flush()
                ids.append(batch.column(0)[k])
                texts.append(text)
                signs += len(text or "") + 16
        if texts:
            yield flush()

    return rows.mapInArrow(run, schema)


def align_tokenizers(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str, str] | None = None
) -> DataFrame:
    """A row for each row of the table: its id, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A blank and the text are read by both tokenizers, special tokens as plain text. A pair of ids counts the rows that
    hold it linked. ``n_best`` is how many links of the row are of a pair with the highest count of its first id (ties
    all), ``count_sum`` the sum of the counts over its links. Null and empty texts, and those whose tokens have other
    bytes than the text, have no tokens: zeros and an empty digest. Repeated rows are rows of their own; null ids stay;
    an empty table stays empty. Only the id and the text are read. Long texts are read in stretches of about 2 million
    signs; a run without a place to cut is read at once.

    Blocks of about 2 million signs are written to the shared folder, so a lost executor costs only its own blocks. A block
    meets its counts in a cogroup. A worker forgets the pieces that it uses least before they fill its memory.
    """
    spark = df.sparkSession
    path = scratch(spark)
    vocabularies = vocabularies or default_vocabularies()
    blocks = written(aligned_blocks(df, id_col, text_col, vocabularies), path)
    held = blocks.select("block", F.explode(F.arrays_zip("pairs", "held")).alias("x"))
    held = held.select("block", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = held.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("first", F.shiftright("pair", 32))
    highest = counts.groupBy("first").agg(F.max("count").alias("highest"))
    counts = counts.join(highest, "first").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = held.join(counts, "pair").select(F.col("block").alias("of"), "pair", "count", "best")
    id_field = T.StructField(id_col, df.schema[id_col].dataType)
    names = [*NUMBERS, "n_best", "count_sum"]
    schema = T.StructType([id_field, *[T.StructField(x, T.LongType()) for x in names], T.StructField("groups_sha256", T.StringType())])

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        docs = block.column("docs").combine_chunks().values
        pairs = np.asarray(block.column("pairs").combine_chunks().values)
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        where = np.searchsorted(pairs, np.asarray(answers.column("pair")))
        count[where] = np.asarray(answers.column("count"))
        best[where] = np.asarray(answers.column("best").cast(pa.int64()))
        lists = docs.field("links")
        ends = np.asarray(lists.offsets).astype(np.int64)
        link, times = np.asarray(lists.values)[ends[0] : ends[-1]], np.asarray(docs.field("times").flatten())
        sums = [np.concatenate([[0], np.cumsum(times * x[link])]) for x in (best, count)]
        sums = [pa.array(x[ends[1:] - ends[0]] - x[ends[:-1] - ends[0]]) for x in sums]
        columns = [docs.field("id"), *[docs.field(x) for x in NUMBERS], *sums, docs.field("groups_sha256")]
        return pa.Table.from_arrays(columns, schema.fieldNames())

    return blocks.select("block", "docs", "pairs").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(run, schema)


def op12_token_alignment(spark, sf_dir):
    return align_tokenizers(table(spark, sf_dir, "documents"))
