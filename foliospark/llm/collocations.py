"""Phrase collocation mining: n-grams of word numbers counted in quotient filters, level by level.

Words that occur ``least`` times get numbers. A phrase of n + 1 words is the pair of the numbers of its first and of its last
n words, so each level packs two numbers into one key; a phrase can only reach ``least`` if both of its halves do, so only
pairs of numbered phrases are counted. Each block of about a million words (a shard) counts its pairs in a counting
quotient filter, which loses nothing; its parts go by the leading bits of the permuted keys to the tasks that merge the
sorted filters of all shards. Pairs that reach ``least`` get numbers, which go back to the blocks that hold them, and the
next level starts. Blocks keep only runs of numbered phrases, so they shrink from level to level.

Everything between the steps is a table in the shared folder. No word, phrase or block is broadcast or collected; a block
meets its answers in a cogroup, so an executor holds those of one block in a task and never a list of them by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stages import discard, scratch
from .common import slices, small_batches, table, written
from .quotient import QuotientFilter, permuted, restored

#: Words of a block; entries that a merging task is meant to hold; bytes of a text read at once.
BLOCK, ENTRIES, STRETCH = 1 << 20, 1 << 19, 1 << 20
LONGEST = 4
# Signs that end a piece of a text; blanks between words.
_ENDS, _BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _ENDS, bytes(range(97, 123)) + b" " + b"\n" * len(_ENDS))
_CUT = re.compile(b"[" + re.escape(_ENDS + _BLANKS) + b"]")


class _Numbers(dict):
    """Number of each word of a language in a block; 0 is the end of a piece."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self[b"\n"] = 0

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = k = len(self.words)
        return k


def stretches(text: bytes, most: int = STRETCH) -> Iterator[bytes]:
    """The text in stretches of about ``most`` bytes, cut in front of a blank or the end of a piece."""
    at = 0
    while len(text) - at > most and (cut := _CUT.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def encoded(df: DataFrame, text_col: str, lang_col: str, block_words: int = BLOCK) -> DataFrame:
    """Blocks of texts: ``seq`` (numbers of the words in order, 0 at ends of pieces), ``old`` (leading words that the block
    before has counted), and the words by number (from 1 on) with language and count.

    A block that ends inside a text hands its last words on, so that no phrase is lost at the cut.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    schema = "block long, seq binary, old int, words array<struct<word: string, lang: string, n: long>>"
    kind = pa.list_(pa.field("element", pa.struct([("word", pa.string()), ("lang", pa.string()), ("n", pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        words: list[bytes] = []
        langs: list[str] = []
        by_lang: dict[str, _Numbers] = {}
        held: list[np.ndarray] = []
        size = old = 0

        def add(lang: str, found: list[bytes]) -> None:
            nonlocal size
            if not found:
                return
            numbers = by_lang.get(lang) or by_lang.setdefault(lang, _Numbers(words))
            held.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
            langs.extend([lang] * (len(words) - len(langs)))
            size += len(found)

        def flush() -> pa.RecordBatch:
            nonlocal block, size, old
            seq = np.concatenate(held)
            counts = np.bincount(seq[old:], minlength=len(words) + 1)[1:]
            parts = [pa.array([x.decode("utf-8", "replace") for x in words], pa.string()), pa.array(langs, pa.string()), pa.array(counts, pa.int64())]
            listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind.value_type)))
            out = pa.RecordBatch.from_arrays([pa.array([block]), _binary([seq]), pa.array([old], pa.int32()), listed], ["block", "seq", "old", "words"])
            for x in (words, langs, by_lang, held):
                x.clear()
            block, size, old = block + 1, 0, 0
            return out

        for batch in slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                for k, part in enumerate(stretches(text.as_py() or b"")):
                    found = [x for x in part.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ") if x]
                    if size >= block_words:
                        last: list[bytes] = []
                        if k:  # the text goes on: hand on its last words
                            tail = np.concatenate(held[-LONGEST:])[1 - LONGEST :].tolist()
                            while tail and (number := tail.pop()):
                                last.insert(0, words[number - 1])
                        yield flush()
                        add(lang, last)
                        old = len(last)
                    add(lang, found)
                add(lang, [b"\n"])
        if held:
            yield flush()

    return rows.mapInArrow(run, schema)


def compacted(level: np.ndarray, old: int) -> tuple[np.ndarray, int]:
    """The numbers that have a numbered neighbour, runs of them apart by one 0; and how many of the first are old."""
    some = level != 0
    near = some & (np.append(False, some[:-1]) | np.append(some[1:], False))
    starts = near & ~np.append(False, near[:-1])
    keep = np.flatnonzero(near)
    out = np.insert(level[keep], np.flatnonzero(starts[keep]), 0)
    places = np.insert(keep, np.flatnonzero(starts[keep]), keep[starts[keep]])
    return out, int(np.searchsorted(places, old))


def paired(level: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where two numbered phrases follow each other, and the key of both."""
    at = np.flatnonzero((level[:-1] != 0) & (level[1:] != 0))
    return at, (level[at].astype(np.uint64) << np.uint64(bits // 2)) | level[at + 1].astype(np.uint64)


def _advance(bits: int, prefix: int, numbered):
    """A function of a block and its answers: the block's runs of numbers, and the parts of its filter of pairs.

    ``numbered(seq, answers)`` gives the numbers at this level. ``bits`` are those of a key, ``prefix`` those that choose the
    task of a part. A block without an answer has no pair and goes.
    """

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        if not state.num_rows or not answers.num_rows:
            return _KIND.empty_table()
        block, old = state.column("block")[0].as_py(), state.column("old")[0].as_py()
        seq = np.frombuffer(state.column("seq")[0].as_py(), np.uint32)
        level = numbered(seq, answers)
        level, old = compacted(level, max(0, old - (len(seq) - len(level))))  # of two old words one pair is old
        at, keys = paired(level, bits)
        if not len(at):
            return _KIND.empty_table()
        parts = QuotientFilter.of(keys, at + 1 >= old, bits).parts(prefix)
        n = len(parts)
        columns = [
            [block] * (n + 1), [level.tobytes(), *[None] * n], [old, *[None] * n],
            [None, *[p for p, _ in parts]], [None, *[f.to_bytes() for _, f in parts]],
        ]
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, _KIND, strict=True)], schema=_KIND)

    return run


_STATE = "block long, seq binary, old int, part int, filter binary"
_KIND = pa.schema([("block", pa.int64()), ("seq", pa.binary()), ("old", pa.int32()), ("part", pa.int32()), ("filter", pa.binary())])


def _word_numbers(seq: np.ndarray, answers: pa.Table) -> np.ndarray:
    out = np.zeros(int(seq.max(initial=0)) + 1, np.uint32)
    out[np.asarray(answers.column("at"))] = np.asarray(answers.column("id"))
    return out[seq]


def _phrase_numbers(bits: int):
    def numbered(seq: np.ndarray, answers: pa.Table) -> np.ndarray:
        out = np.zeros(max(len(seq) - 1, 0), np.uint32)
        if not len(out):
            return out
        values = np.concatenate([np.frombuffer(x, np.uint64) for x in answers.column("values").to_pylist()])
        ids = np.concatenate([np.frombuffer(x, np.uint32) for x in answers.column("ids").to_pylist()])
        order = np.argsort(values)
        values, ids = values[order], ids[order]
        at, keys = paired(seq, bits)
        keys = permuted(keys, bits)
        where = np.minimum(np.searchsorted(values, keys), len(values) - 1)
        out[at] = np.where(values[where] == keys, ids[where], 0)
        return out

    return numbered


_MERGED = "block long, values binary, ids binary, id array<long>, first array<long>, second array<long>, n array<long>"


def _merge(least: int, bits: int, prefix: int):
    """A function of the parts of all blocks with one prefix: their merged filter's pairs that reach ``least``, numbered,
    and for each block the permuted keys among its own that have a number."""

    def run(part: pa.Table) -> pa.Table:
        blocks = part.column("block").to_pylist()
        filters = [QuotientFilter.from_bytes(x) for x in part.column("filter").to_pylist()]
        merged = QuotientFilter.merged(filters)
        often = merged.counts >= least
        values, counts = merged.values[often], merged.counts[often]
        place = part.column("part")[0].as_py()
        ids = ((np.arange(1, len(values) + 1) << prefix) | place).astype(np.int64)
        if len(ids) and ids[-1] >> 32:
            raise OverflowError("over 2^32 numbered phrases of one length")
        keys = restored(values, bits)
        half = np.uint64(bits // 2)
        rows = {"block": [None], "values": [None], "ids": [None], "id": [ids], "first": [(keys >> half).astype(np.int64)], "second": [(keys & np.uint64((1 << bits // 2) - 1)).astype(np.int64)], "n": [counts]}
        for block, own in zip(blocks, filters, strict=True):
            where = np.minimum(np.searchsorted(values, own.values), max(len(values) - 1, 0))
            found = values[where] == own.values if len(values) else np.zeros(len(own.values), bool)
            if found.any():
                rows["block"].append(block)
                rows["values"].append(own.values[found].tobytes())
                rows["ids"].append(ids[where[found]].astype(np.uint32).tobytes())
                for x in ("id", "first", "second", "n"):
                    rows[x].append(None)
        kinds = {"block": pa.int64(), "values": pa.binary(), "ids": pa.binary()}
        return pa.table({k: pa.array(x, kinds.get(k, pa.list_(pa.int64()))) for k, x in rows.items()})

    return run


def _prefix(entries: int, per_task: int) -> int:
    return max(0, -(-entries // per_task) - 1).bit_length()


def mine_collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int | None = 2000,
    block_words: int = BLOCK, per_task: int = ENTRIES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases (all if None) of each language.

    A-Z are lower-cased; ``. , ; : ! ?`` and line ends cut a text into pieces, blanks and tabs a piece into words. A phrase of
    2 to 4 words that occurs ``a`` >= ``least`` times in pieces of a language is a candidate; ``n`` are all words of the language.
    Of the cuts into two parts that occur ``l`` and ``r`` times the one with the lowest floor(2,000,000 a / (l + r)) counts,
    ties to the earliest. A phrase inside a longer candidate that occurs at least 0.8 times as often is left out.
    Order: score, a (both falling), phrase by its bytes. A null language is ``und``, a null text empty; repeated rows
    count again; no rows give no phrases; extra columns are not read. A language without a phrase is not returned.
    A text is read in stretches of about 1 MB. At most 2^32 words or phrases of one length get numbers, else it raises.

    The steps run as this is called; what is returned reads small tables of phrases in the shared folder.
    """
    spark = df.sparkSession
    folder = scratch(spark)
    blocks = written(encoded(df, text_col, lang_col, block_words), f"{folder}/blocks")
    held = blocks.select("block", F.posexplode("words").alias("at", "w")).select("block", (F.col("at") + 1).alias("at"), "w.word", "w.lang", "w.n")
    totals = written(held.groupBy("lang").agg(F.sum("n").alias("n")), f"{folder}/totals")
    size = totals.agg(F.sum("n")).first()[0] or 0
    prefix = _prefix(size // least, per_task)
    bucket = F.xxhash64("lang", "word").bitwiseAND((1 << prefix) - 1)
    counts = held.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least).withColumn("bucket", bucket)
    number = F.shiftleft(F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word")).cast("long"), prefix)
    words = written(counts.select(number.bitwiseOR(F.col("bucket")).alias("id"), "lang", "word", "a"), f"{folder}/words")
    answers = held.join(words, ["lang", "word"]).select(F.col("block").alias("of"), "at", "id")
    numbered, state, last = _word_numbers, blocks, f"{folder}/blocks"
    most, occurrences = words.agg(F.max("id"), F.sum("a")).first()
    level = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("a").alias("heads"), F.array("a").alias("tails"), "a")
    found: list[DataFrame] = []
    pairs: list[DataFrame] = []
    for length in range(2, LONGEST + 1):
        if not most:
            break
        if most >> 32:
            raise OverflowError("over 2^32 numbered words or phrases of one length")
        bits = 2 * int(most).bit_length()
        prefix = min(_prefix(occurrences, per_task), bits)
        joined = state.select("block", "seq", "old").groupBy("block").cogroup(answers.groupBy("of"))
        path = f"{folder}/state{length}"
        now = written(joined.applyInArrow(_advance(bits, prefix, numbered), _STATE), path)
        discard(spark, last)
        merged = now.where("part IS NOT NULL").select("part", "block", "filter").groupBy("part").applyInArrow(_merge(least, bits, prefix), _MERGED)
        merged = written(merged, f"{folder}/merged{length}")
        pair = merged.where("block IS NULL").select(F.explode(F.arrays_zip("id", "first", "second", "n")).alias("x")).select("x.*")
        most, occurrences = pair.agg(F.max("id"), F.sum("n")).first()
        answers = merged.where("block IS NOT NULL").select(F.col("block").alias("of"), "values", "ids")
        numbered, state, last = _phrase_numbers(bits), now.where("part IS NULL").select("block", "seq", "old"), path
        level = written(_longer(pair, level), f"{folder}/phrases{length}")
        found.append(level)
        pairs.append(pair)
    discard(spark, last)
    if not found:
        return _ranked(level.where("false"), totals, top)
    kept = [_uncovered(x, pairs[k + 1]) if k + 1 < len(pairs) else x for k, x in enumerate(found)]
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    return _ranked(out, totals, top)


def _longer(pair: DataFrame, level: DataFrame) -> DataFrame:
    """Phrases of one word more, from pairs of numbers: counts of their first words (``heads``, 1 word, 2 words, ...) and of
    their last words (``tails``, all of them, all but the first, ...)."""
    first = level.select(F.col("id").alias("first"), "lang", "phrase", "heads")
    second = level.select(F.col("id").alias("second"), "last", "tails")
    a = F.array(F.col("n"))
    return pair.join(first, "first").join(second, "second").select(
        "id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last",
        F.concat("heads", a).alias("heads"), F.concat(a, "tails").alias("tails"), F.col("n").alias("a"),
    )


def _uncovered(level: DataFrame, longer: DataFrame) -> DataFrame:
    """Phrases without a longer one that holds them and occurs at least 0.8 times as often.

    Phrases of one word more are enough: those between a phrase and a longer one occur as often as the longer one.
    """
    around = longer.select(F.col("first").alias("id"), "n").unionByName(longer.select(F.col("second").alias("id"), "n"))
    around = around.groupBy("id").agg(F.max("n").alias("around"))
    exact = "decimal(20,0)"
    covered = F.col("around").cast(exact) * 100 >= F.col("a").cast(exact) * 80
    return level.join(around, "id", "left").where(~F.coalesce(covered, F.lit(False))).drop("around")


def _ranked(phrases: DataFrame, totals: DataFrame, top: int | None) -> DataFrame:
    cuts = F.expr("transform(sequence(1, size(heads) - 1), k -> struct(CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(heads[k - 1] AS DECIMAL(20,0)) + CAST(tails[k] AS DECIMAL(20,0))) AS LONG) AS score, k AS k, heads[k - 1] AS l, tails[k] AS r))")
    phrases = phrases.where("size(heads) > 1").withColumn("cut", F.array_min(cuts)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    phrases = phrases.withColumn("rank", F.row_number().over(order))
    if top is not None:
        phrases = phrases.where(F.col("rank") <= top)
    return phrases.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    return mine_collocations(table(spark, sf_dir, "documents").select("text", "lang"))
