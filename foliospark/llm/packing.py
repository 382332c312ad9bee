"""Best-fit packing of tokenised documents by bin completion.

Documents are tokenised where they are read. Pieces then go by hash to blocks of about ``block_rows`` pieces, each
packed in one task that holds lengths, not tokens. Inside a block best-fit decreasing gives the first incumbent; if
it meets the lower bound it is optimal. Otherwise bin completion searches: it takes the largest piece left,
enumerates undominated fillings of the room beside it, fullest first, and gives a branch up as soon as its waste
shows that it cannot beat the incumbent. The search ends with the proof or after ``nodes`` steps and ``STEPS`` more for
each bin, so that it reaches whole packings of any block; the loosest bins of the best packing found are then packed
anew in groups. Blocks hold thousands of pieces, so what the blocks' last sequences leave open is far below 0.1 %.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from operator import le

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches, table

END_OF_TEXT = "<|endoftext|>"
#: Steps of the search for each bin, besides a fixed number: one bin takes one step on the way to a first packing.
STEPS = 3


@lru_cache(maxsize=2)
def encoder(path: str, end_of_text: int = 50256):
    """Byte-level BPE from a rank file. It gives the ids that the JSON form of the same vocabulary gives."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: end_of_text}
    )


@lru_cache(maxsize=2)
def slow_encoder(path: str):
    """The JSON form of the vocabulary, which has no limit on runs of blanks."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_vocabulary() -> tuple[str, str]:
    """Rank file and JSON form of the same vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def token_ids(text: str, ranks: str, whole: str) -> np.ndarray:
    """Ids of a text by the rank file; by the JSON form where the pattern of the first gives up (a million blanks in a row)."""
    try:
        if END_OF_TEXT in text:
            return encoder(ranks).encode_to_numpy(text, allowed_special={END_OF_TEXT})
        return encoder(ranks).encode_to_numpy(text, disallowed_special=())
    except ValueError:
        return np.array(slow_encoder(whole).encode(text, add_special_tokens=False).ids, np.uint32)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers. A set of bits tells which rooms are open."""
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            where = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
            bins[where].append(item)
        else:
            room, where = capacity, len(bins)
            bins.append([item])
        if room > size:
            open_[room - size].append(where)
            rooms |= 1 << (room - size)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by volume, and with pieces over half a bin counted one to a bin."""
    bound = -(-int(sizes.sum()) // capacity)
    for k in np.unique(sizes[sizes <= capacity // 2])[:64].tolist() or [1]:
        big = sizes > capacity - k
        mid = (sizes > capacity // 2) & ~big
        low = (sizes >= k) & (sizes <= capacity // 2)
        rest = int(sizes[low].sum()) - (int(mid.sum()) * capacity - int(sizes[mid].sum()))
        bound = max(bound, int(big.sum()) + int(mid.sum()) + max(0, -(-rest // capacity)))
    return bound


def beaten(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether ``b``, which is no less full, has as many pieces as ``a`` and none smaller, or is one piece."""
    return a != b and (len(b) == 1 or len(a) == len(b) and all(map(le, a, b)))


def fillings(
    counts: dict[int, int], rising: list[int], room: int, waste: int, most: int = 32, tries: int = 3000
) -> Iterator[tuple[int, ...]]:
    """Undominated multisets of sizes that fit in ``room`` and leave at most ``waste``, fullest first.

    ``rising`` are the sizes in stock, ``counts`` how many of each. A filling is dominated if another one of as many
    pieces has none smaller, or is one piece as large as all of them. Sets are tried with large pieces first, ``tries``
    at most, in the call; dominance is decided as the iterator goes on, since most steps take the first filling only.
    """
    n = bisect_right(rising, room)
    if not n:
        return iter([()] if room <= waste else [])
    if rising[n - 1] == room and waste >= 0:  # dominates all others
        return iter([(room,)])
    found: list[tuple[int, ...]] = []
    enough, smallest = 4 * most, rising[0]

    # A set may be extended by sizes up to number ``at``; of that one ``spare`` are left besides the set, of lower ones all.
    chosen, left, at, spare = (), room, n - 1, counts[rising[n - 1]]
    open_: list[tuple] = []
    while True:
        tries -= 1
        end, k = bisect_right(rising, left, 0, at + 1), -1
        if end:
            last = bisect_right(rising, left - smallest, 0, end)  # from there on nothing fits beside a size
            full = bisect_left(rising, left - waste, last, end)  # and from there on it wastes little enough
            if full < end:
                n = min(end - full, max(0, tries), max(0, enough - len(found)))
                found.extend([(*chosen, s) for s in rising[end - n : end][::-1]])
                if n < end - full:
                    break
                tries -= n
            tries -= full - last  # sets that waste too much are counted without a look at each
            k = last - 1
        elif left <= waste:
            found.append(chosen)
        while k < 0 and open_:
            chosen, left, at, spare, k = open_.pop()
        if k < 0 or tries <= 0 or len(found) >= enough:
            break
        open_.append((chosen, left, at, spare, k - 1))
        s = rising[k]
        chosen, left, more = (*chosen, s), left - s, (spare if k == at else counts[s]) - 1
        at, spare = (k, more) if more else (k - 1, counts[rising[k - 1]] if k else 0)
    return undominated(found, most)


def undominated(found: list[tuple[int, ...]], most: int) -> Iterator[tuple[int, ...]]:
    """Fillings that no other one beats, fullest first; one that beats another stands in front of it."""
    kept: list[tuple[int, ...]] = []
    for a in sorted(dict.fromkeys(found), key=lambda a: (-sum(a), len(a), a)):
        if len(kept) < most and not any(beaten(a, b) for b in kept):
            kept.append(a)
            yield a


def complete_bins(sizes: np.ndarray, capacity: int, incumbent: int, nodes: int) -> list[tuple[int, ...]] | None:
    """Bins (as sizes) of a packing with fewer than ``incumbent`` bins, the best found in ``nodes`` steps."""
    values, amounts = np.unique(sizes, return_counts=True)
    rising, counts = values.tolist(), dict(zip(values.tolist(), amounts.tolist()))
    total, best, bound = int(sizes.sum()), None, lower_bound(sizes, capacity)
    path: list[tuple[int, ...]] = []
    wasted, steps = 0, 0

    def take(s: int) -> None:
        counts[s] -= 1
        if not counts[s]:
            del rising[bisect_left(rising, s)]

    def give(s: int) -> None:
        if not counts[s]:
            insort(rising, s)
        counts[s] += 1

    def options() -> Iterator[tuple[int, ...]]:
        budget = (incumbent - 1) * capacity - total - wasted
        if budget < 0:
            return iter(())
        top = rising[-1]
        take(top)
        out = fillings(counts, rising, capacity - top, budget)
        give(top)
        return ((top, *x) for x in out)

    stack, left = [options()], len(sizes)
    while stack and steps < nodes:
        steps += 1
        if (chosen := next(stack[-1], None)) is None:
            stack.pop()
            if path:
                for s in (last := path.pop()):
                    give(s)
                left += len(last)
                wasted -= capacity - sum(last)
            continue
        if wasted + capacity - sum(chosen) > (incumbent - 1) * capacity - total:
            continue
        path.append(chosen)
        for s in chosen:
            take(s)
        left -= len(chosen)
        wasted += capacity - sum(chosen)
        if left == 0:
            if len(path) < incumbent:
                best, incumbent = list(path), len(path)
                if incumbent <= bound:
                    break
            stack.append(iter(()))
        else:
            stack.append(options() if len(path) < incumbent - 1 else iter(()))
    return best


def repacked(bins: list[tuple[int, ...]], capacity: int, bound: int, nodes: int, group: int = 128) -> list[tuple[int, ...]]:
    """The bins with the loosest ones packed anew, ``group`` bins at a time, until no group saves one.

    A group whose bins leave less room than one bin cannot save any; bins go from the loosest, so the rest cannot either.
    """
    gained = True
    while gained and len(bins) > bound:
        gained = False
        bins = sorted(bins, key=lambda x: (sum(x), x))
        out: list[tuple[int, ...]] = []
        for first in range(0, len(bins), group):
            some = bins[first : first + group]
            if len(some) * capacity - sum(map(sum, some)) >= capacity:
                sizes = np.array([s for one in some for s in one], np.int64)
                if len(some) > lower_bound(sizes, capacity):
                    better = complete_bins(sizes, capacity, len(some), nodes + STEPS * len(some))
                    if better is not None:
                        some, gained = better, True
            out += some
        bins = out
    return bins


def pack(sizes: np.ndarray, capacity: int, nodes: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item."""
    bins = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(bins) > bound:
        better = complete_bins(sizes, capacity, len(bins), nodes + STEPS * len(bins))
        better = better or [tuple(int(sizes[item]) for item in one) for one in bins]
        better = repacked(better, capacity, bound, nodes)
        if len(better) < len(bins):
            by_size: dict[int, list[int]] = {}
            for item, size in enumerate(sizes.tolist()):
                by_size.setdefault(size, []).append(item)
            bins = [[by_size[s].pop() for s in one] for one in better]
    number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k, items in enumerate(bins):
        at = 0
        for item in items:
            number[item], offset[item] = k, at
            at += int(sizes[item])
    return number, offset


def token_pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0,
    vocabulary: tuple[str, str] | None = None, with_ids: bool = False, place_col: str | None = None,
) -> DataFrame:
    """Pieces of the tokenised texts: ``doc_id, piece, start, length, ids_crc32, __row`` and, if wanted, ``ids``.

    A text's ids are followed by ``end_id``; null counts as empty (one piece that is ``end_id`` alone). Only what
    is longer than ``capacity`` is cut; then the first piece takes the remainder and all others are full. Texts of
    any length are encoded whole. Ids may be null or repeated, repeated rows have pieces of their own, an empty table
    has none; other columns are not read. ``vocabulary`` is a rank file and its JSON form. ``__row`` is ``place_col`` where given, else the row's number in
    its task.
    """
    small_batches(df.sparkSession)
    ranks, whole = vocabulary or default_vocabulary()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(place_col)] if place_col else []))
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("__row", T.LongType()),
        ]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in slices(batches, 1):
            rows_, pieces, starts, lengths, crcs, ids = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.append(token_ids(text or "", ranks, whole), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(tokens) % capacity or capacity, len(tokens) + 1, capacity)]
                if len(tokens) <= capacity:
                    cuts = [0, len(tokens)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows_.append(k)
                    pieces.append(p)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(tokens[a:b].tobytes()))
                    if with_ids:
                        ids.append(tokens[a:b].astype(np.int32))
            out = [
                batch.column(0).take(pa.array(rows_, pa.int64())),
                pa.array(pieces, pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(crcs, pa.int64()),
                batch.column(2).take(pa.array(rows_, pa.int64())) if place_col else pa.array(np.array(rows_, np.int64) + number, pa.int64()),
            ]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays(out, schema.fieldNames())

    return rows.mapInArrow(run, schema)


def pack_pieces(
    pieces: DataFrame, n_rows: int, capacity: int = 2048, block_rows: int = 8192, n_places: int | None = None
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; one shuffle, by block.

    ``n_rows`` only sets the number of blocks. Blocks are dealt by a hash of the row's place, so neither copies
    nor repeated ids can fill one. With ``n_places`` rows in an order, of which ``__row`` is the place, blocks are
    consecutive rows instead and ``sequence_id`` rises with them; a text of over ``block_rows`` pieces goes on in the
    next block.
    """
    n_blocks = max(1, -(-n_rows // block_rows))
    block = F.pmod(F.xxhash64("doc_id", "piece", "__row"), F.lit(n_blocks)).cast("long")
    if n_places:
        block = F.expr(f"(__row * {n_blocks} div {n_places} + piece div {block_rows}) % {n_blocks}").cast("long")
    fields = [f for f in pieces.schema.fields if f.name != "__row"]
    schema = T.StructType(
        [*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        by = [("length", "ascending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")]
        rows = rows.take(pa.compute.sort_indices(rows, by)).drop_columns(["__row", "__block"])
        number, offset = pack(rows.column("length").to_numpy(), capacity)
        first = key[0].as_py() << 32
        rows = rows.append_column("sequence_id", pa.array(first + number, pa.int64()))
        return rows.append_column("offset", pa.array(offset, pa.int64()))

    return pieces.withColumn("__block", block).groupBy("__block").applyInArrow(run, schema)


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, with_ids: bool = False,
    place_col: str | None = None, block_rows: int = 8192, **options,
) -> DataFrame:
    """Tokenise and pack whole documents; ``with_ids`` keeps each piece's token ids in the result.

    A block then holds tokens as well, so blocks are counted by the number of pieces that the texts' bytes allow.
    ``place_col`` numbers the rows from 0 on; blocks then follow that order.
    """
    n_places = df.count() if place_col else None
    if with_ids:
        n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
        n += size // capacity
    else:
        n = df.count()
    pieces = token_pieces(df, id_col, text_col, capacity, with_ids=with_ids, place_col=place_col, **options)
    return pack_pieces(pieces, n, capacity, block_rows, n_places)


def op6_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
