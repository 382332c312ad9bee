"""Near-dedup with SetSketch registers: banding, likelihood estimates, and verification on full sets.

A document's set is sketched into registers: each register's hash gives every element an exponential value, and the
register holds floor(1 - log_b(smallest value)), truncated to 16 bits. Registers of a union are the larger of the
two, so sketches merge; and two sets agree in a register with a probability close to their similarity, so equal
registers can be banded.

1. One pass over the texts gives each document its set's size, 128-bit digest and registers. Documents with equal sets
   are one class from here on; sets that share the first 64 bits alone are told apart.
2. Bands of registers put classes in buckets; buckets with one class go. In a bucket, pairs whose joint likelihood
   (given both exact sizes) peaks under the threshold less five standard deviations are dropped.
3. First each class proposes its likeliest partner in each bucket; pairs proposed are checked on the full sets, and
   components follow from the links found. Then each component proposes its ``few`` likeliest pairs with other
   components. Buckets in which more were possible get their classes' full sets in one task and check every pair
   between parts that are still apart. So a group of thousands of near copies gives about one pair per class, not
   all pairs, and no cap decides a result.
   Buckets of different bands with the same classes are one. The documents read for a check are found by broadcast
   of at most ``broadcast_rows`` ids (counted first), by an ordinary join beyond that.
4. Buckets over ``chunk`` classes (or ``chunk_items`` shingles) are split by a hash; a star around one class joins the
   parts. Where such a bucket still holds two components then, the classes outside its largest one are compared with
   all its parts and with each other, in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mixed, ready_checkpoints, slices, small_batches, spaced, table, text_bytes, words_of
from .components import components

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 2**64, REGISTERS, np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, REGISTERS, np.uint64)
_LOWER = np.array(
    [32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8
)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each row, one row after another, and where each row starts."""
    n_rows = len(offsets) - 1
    text, starts = spaced(data, offsets, _LOWER)
    first, _, words = words_of(text)
    row = np.searchsorted(starts, first, "right") - 1 if n_rows > 1 else np.zeros(len(words), np.int8)
    del first, text
    at = np.searchsorted(row, np.arange(n_rows + 1))
    count = np.diff(at)
    full = len(words) - size + 1
    shingles, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if full > 0:
        same = row[:full] == row[size - 1 :]
        shingles = np.full(full, np.uint64(size), np.uint64)
        for k in range(size):
            shingles = mixed(shingles * np.uint64(0xD6E8FEB86659FD93) + words[k : full + k])
        shingles, of = shingles[same], row[:full][same]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = count[short].astype(np.uint64)
        for k in range(size - 1):
            more = count[short] > k
            extra[more] = mixed(extra[more] * np.uint64(0xD6E8FEB86659FD93) + words[at[short][more] + k])
        shingles, of = np.concatenate([shingles, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        shingles, of = shingles[order], of[order]
    bounds = np.searchsorted(of, np.arange(n_rows + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        shingles[a:b].sort()
    if len(shingles):
        new = np.ones(len(shingles), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (of[1:] != of[:-1])
        shingles, of = shingles[new], of[new]
    return shingles, np.searchsorted(of, np.arange(n_rows + 1))


def registers(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers (rows x REGISTERS, 16 bits) of sets that are not empty."""
    out = np.zeros((len(bounds) - 1, REGISTERS), np.uint64)
    for j in range(REGISTERS):
        out[:, j] = np.minimum.reduceat(shingles * _MUL[j] + _ADD[j], bounds[:-1])
    smallest = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(smallest, 1e-300)) / np.log(BASE)), 0, 65535).astype(np.uint16)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether the joint likelihood of two sketches peaks at a similarity of ``least`` or more; equal registers.

    The log-likelihood of the similarity J, given both sizes, is D+ log p(u - vJ) + D- log p(v - uJ) +
    D0 log(1 - p(u - vJ) - p(v - uJ)), with p(x) = -log_b(1 - x (b - 1) / b), u and v the shares of both sizes, and
    D+, D-, D0 how many registers are larger, smaller, equal. It is concave, so the sign of its slope at ``least``
    tells on which side it peaks.
    """
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u
    c, log_b = (BASE - 1) / BASE, np.log(BASE)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * c) / log_b

    def slope(x: np.ndarray) -> np.ndarray:
        return c / ((1 - x * c) * log_b)

    x, y = np.maximum(u - v * least, 1e-9), np.maximum(v - u * least, 1e-9)
    px, py = p(x), p(y)
    rise = same * (slope(x) * v + slope(y) * u) / np.maximum(1 - px - py, 1e-9)
    return rise - up * slope(x) * v / px - down * slope(y) * u / py >= 0, same


def signatures(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``doc_id, n_shingles``, ``rep, other`` (both halves of a digest of the set, null if empty) and ``sketch``."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            counts, reps, sketches = [], [], []
            for first, last in blocks(offsets):
                shingles, bounds = shingle_sets(data, offsets[first : last + 1], size)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                drawn = registers(shingles, np.append(bounds[some], len(shingles))) if len(some) else None
                where = np.full(len(n), -1)
                where[some] = np.arange(len(some))
                counts += n.tolist()
                for k in range(len(n)):
                    if n[k]:
                        reps.append(_digest(shingles[bounds[k] : bounds[k + 1]]))
                        sketches.append(drawn[where[k]].tobytes())
                    else:
                        reps.append((None, None))
                        sketches.append(None)
            halves = [pa.array([x[k] for x in reps], pa.int64()) for k in range(2)]
            arrays = [batch.column(0), pa.array(counts, pa.int64()), *halves, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "rep", "other", "sketch"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, rep long, other long, sketch binary")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, sketch, n -> rep, bucket, n: one row for each band."""
    for batch in batches:
        if not batch.num_rows:
            continue
        drawn = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), drawn.shape[:2]).copy()
        for k in range(ROWS):
            h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + drawn[:, :, k].astype(np.uint64))
        reps = np.repeat(batch.column(0).to_numpy(), BANDS)
        sizes = np.repeat(batch.column(2).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(h.ravel().view(np.int64)), pa.array(sizes)], ["rep", "bucket", "n"])


def _linked(x: np.ndarray, y: np.ndarray, bound: tuple[int, int]) -> bool:
    """Whether two sorted sets are as similar as asked."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    both = int((y[at] == x).sum()) if len(x) else 0
    return both > 0 and bound[1] * both >= bound[0] * (len(x) + len(y) - both)


def _proposals(limit: int | None, first_round: bool, least: float, bound: tuple[int, int]):
    """Over rows sorted by group (group, side, rep, comp, n, sketch): pairs that may be links, a > b.

    In the first round each row proposes its ``limit`` likeliest partners among the rows before it in its group;
    later each component proposes its ``limit`` likeliest pairs with other components in each group. A row (group,
    0, true) names a group of which pairs were left out. Without a limit the rows also hold ``items``: pairs are
    checked where they are, likeliest first and only between parts not yet linked, and the links found come out.
    """

    def pairs_of(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (later, earlier) in each group, in slices of bounded size."""
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        earlier = np.arange(len(starts)) - starts
        ends = np.cumsum(earlier)
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - earlier[first] + 50_000, "right")))
            n = earlier[first:last]
            later = np.repeat(np.arange(first, last), n)
            yield later, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[first:last], n)
            first = last

    def groups(rows: pa.Table) -> pa.RecordBatch | None:
        key = rows.column("group").combine_chunks()
        code = pa.compute.run_end_encode(key).run_ends.to_numpy() if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(code, prepend=0)
        group_of = np.repeat(np.arange(len(sizes)), sizes)
        side, rep, comp = (rows.column(c).to_numpy() for c in ("side", "rep", "comp"))
        n = rows.column("n").to_numpy().astype(np.float64)
        drawn = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        later, before, score = [], [], []
        for x, y in pairs_of(sizes):
            ok = (comp[x] != comp[y]) & ((side[x] != side[y]) | (side[x] < 0))
            ok &= np.minimum(n[x], n[y]) * bound[1] >= np.maximum(n[x], n[y]) * bound[0]
            x, y = x[ok], y[ok]
            if len(x):
                ok, same = likely(drawn[x], drawn[y], n[x], n[y], least)
                later.append(x[ok])
                before.append(y[ok])
                score.append(same[ok])
        if not later:
            return None
        x, y, s = np.concatenate(later), np.concatenate(before), np.concatenate(score)
        left_out = np.zeros(0, np.int64)
        if limit is None:
            items = rows.column("items").combine_chunks()
            label: dict[tuple[int, int], tuple[int, int]] = {}

            def root(k: tuple[int, int]) -> tuple[int, int]:
                while (up := label.get(k, k)) != k:
                    label[k] = label.get(up, up)
                    k = up
                return k

            kept = []
            for k in np.argsort(-s, kind="stable").tolist():
                i, j = int(x[k]), int(y[k])
                p, q = root((int(group_of[i]), int(comp[i]))), root((int(group_of[j]), int(comp[j])))
                if p != q and _linked(*(np.frombuffer(items[m].as_buffer(), np.uint64) for m in (i, j)), bound):
                    label[p] = q
                    kept.append(k)
            x, y = x[kept], y[kept]
        elif len(x):
            if first_round:
                owner, pair = x, np.arange(len(x))
            else:  # each pair stands in the lists of both components, in its own group
                _, owner = np.unique(np.stack([np.tile(group_of[x], 2), np.append(comp[x], comp[y])], 1), axis=0, return_inverse=True)
                pair = np.tile(np.arange(len(x)), 2)
            order = np.lexsort((pair, -s[pair], owner))
            owner, pair = owner[order], pair[order]
            kept = np.unique(pair[np.arange(len(owner)) - np.searchsorted(owner, owner) < limit])
            lost = np.ones(len(x), bool)
            lost[kept] = False
            left_out = np.unique(key.to_numpy()[x[lost]])
            x, y = x[kept], y[kept]
        a, b = np.maximum(rep[x], rep[y]), np.minimum(rep[x], rep[y])
        flags = np.append(np.zeros(len(a), bool), np.ones(len(left_out), bool))
        arrays = [pa.array(np.append(a, left_out)), pa.array(np.append(b, np.zeros_like(left_out))), pa.array(flags)]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key = held.column("group").combine_chunks().to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
            if cut:
                if (out := groups(held.slice(0, cut))) is not None:
                    yield out
                held = held.slice(cut)
        if held is not None and held.num_rows and (out := groups(held)) is not None:
            yield out

    return run


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two longs."""
    import xxhash

    digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
    low, high = digest & ((1 << 64) - 1), digest >> 64
    return (low - (1 << 64) if low >> 63 else low), (high - (1 << 64) if high >> 63 else high)


def _sets(size: int):
    """rep, text -> rep, items: the text's set, if it is the one that rep is the digest of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, offsets = text_bytes(batch.column(1))
            shingles, bounds = shingle_sets(data, offsets, size)
            sets = [shingles[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            rows = []
            for rep, x in zip(batch.column(0).to_pylist(), sets):
                low, high = _digest(x)
                if rep in (low, low ^ high):
                    rows.append((rep, x.tobytes()))
            arrays = [pa.array([r for r, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["rep", "items"])

    return run


def _verified(bound: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in (2, 3))
            ok = [_linked(x, y, bound) for x, y in zip(*sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


def near_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85, chunk: int = 2048,
    chunk_items: int = 4_000_000, few: int = 8, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if 100 * intersection >= percent * union of their sets of ``size``-word shingles (words
    between white space, A-Z lower-cased; a text with fewer words is one shingle). ``component_id`` is the smallest
    id that links reach. A null, empty or blank text has no shingles and is linked with nothing. Rows that repeat
    an id are linked like any others with equal texts; an id whose rows differ gets a row for each. A null id
    counts only where a component has no other (component_id null, kept). Other columns are not read. Texts of any
    length count with all their shingles. An empty table stays empty.
    """
    spark = df.sparkSession
    ready_checkpoints(spark)
    small_batches(spark)
    bound = (percent, 100)
    share = percent / 100
    least = max(0.05, share - 5 * (share * (1 - share) / REGISTERS) ** 0.5)
    signed = signatures(df, id_col, text_col, size).checkpoint()

    def classed(rows: DataFrame) -> DataFrame:
        classes = rows.where("rep IS NOT NULL").groupBy("rep").agg(
            F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least_id"),
            F.min("other").alias("low"), F.max("other").alias("high"),
        )
        return classes.checkpoint()

    classes = classed(signed)
    alike = classes.where("low <> high").select("rep")
    if (n_alike := alike.count()):  # different sets that share 64 bits: both halves tell them apart
        alike = F.broadcast(alike) if n_alike <= broadcast_rows else alike
        split = signed.join(alike.withColumn("twice", F.lit(True)), "rep", "left")
        signed = split.withColumn("rep", F.when(F.col("twice"), F.col("rep").bitwiseXOR(F.col("other"))).otherwise(F.col("rep"))).drop("twice").checkpoint()
        classes = classed(signed)
    bands = classes.select("rep", "sketch", "n").mapInArrow(_buckets, "rep long, bucket long, n long")
    shared = bands.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("n").alias("items"),
        F.min("rep").alias("centre"),
        F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("__sum"),
    )
    # Bands in which the same classes meet make the same pairs: one of them is enough.
    shared = shared.where("c > 1").groupBy("c", "centre", "__sum", "items").agg(F.min("bucket").alias("bucket")).drop("__sum")
    parts = F.expr(f"CAST(least(c, greatest(ceil(c / {chunk}), ceil(items / {chunk_items}))) AS INT)")
    members = (
        bands.join(shared, "bucket")
        .select("bucket", "rep", "n", "centre", parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).alias("part"))
        .checkpoint()
    )
    hot = members.where("parts > 1")
    star = hot.where("rep <> centre").select(
        F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b"), F.lit(False).alias("more")
    )
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Rows of the buckets that hold more than one component, with the component of each class."""
        if labels is None:
            return rows.withColumn("comp", F.col("rep"))
        rows = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        rows = rows.withColumn("comp", F.coalesce("label", "rep")).drop("label")
        mixed = rows.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
        return rows.join(mixed.select("bucket"), "bucket", "left_semi")

    def proposed(rows: DataFrame, limit: int | None) -> DataFrame:
        """rows: group, side, rep, comp."""
        dealt = rows.select("group", "side", "rep", "comp").join(classes.select("rep", "n", "sketch"), "rep")
        columns = ["group", "side", "rep", "comp", "n", "sketch"]
        if limit is None:
            dealt, columns = dealt.join(sets_of(rows.select("rep").distinct()), "rep"), [*columns, "items"]
        dealt = dealt.select(*columns).repartition("group").sortWithinPartitions("group")
        return dealt.mapInArrow(_proposals(limit, labels is None, least, bound), "a long, b long, more boolean")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """rep, items of the classes wanted, each read from one document."""
        one = classes.join(wanted, "rep").select("rep", F.col("least_id").alias("__least")).checkpoint()
        if one.count() <= broadcast_rows:
            one = F.broadcast(one)
        sets = texts.join(one, F.col("doc_id").eqNullSafe(F.col("__least"))).select("rep", "text")
        sets = sets.mapInArrow(_sets(size), "rep long, items binary")
        return sets.groupBy("rep").agg(F.first("items").alias("items"))

    def check(pairs: DataFrame) -> DataFrame:
        """The pairs that are links on their full sets."""
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
        found = (
            pairs.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b")
            .select("a", "b", "x", "y")
            .mapInArrow(_verified(bound), "a long, b long, ok boolean")
        )
        return found.where("ok").select("a", "b")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"group": F.xxhash64("bucket", "part"), "side": F.lit(-1)})

    labels = links = None

    def add(found: DataFrame) -> None:
        nonlocal labels, links
        found = found.checkpoint()
        found = found.coalesce(max(1, -(-found.count() // 200_000)))
        links = found if links is None else links.unionByName(found)
        if labels is None or not found.isEmpty():
            labels = components(links).checkpoint()

    # Each class and its likeliest partner; and the stars that join the parts of large buckets.
    found = proposed(grouped(labelled(members, None)), 1).unionByName(star).distinct().checkpoint()
    left_out = not found.where("more").isEmpty()
    add(check(found.where("NOT more").select("a", "b")))
    if left_out:
        found = proposed(grouped(labelled(members, labels)), few).distinct().checkpoint()
        large = found.where("more").select(F.col("a").alias("group")).distinct()
        add(check(found.where("NOT more").select("a", "b")))
        if not large.isEmpty():
            rows = grouped(labelled(members, labels)).join(large, "group", "left_semi").checkpoint()
            add(proposed(rows, None).select("a", "b").distinct())
    if not hot.isEmpty():
        # In a bucket that still holds two components, pairs inside its largest one are no news: its classes stay in
        # their parts, and only the others go to all of these.
        rows = labelled(hot, labels).checkpoint()
        sizes = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("items"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("c", "comp", "items")).alias("m"), F.sum("c").alias("c"), F.sum("items").alias("items"))
        amount = lambda c, n: F.expr(f"CAST(greatest(1, ceil(({c}) / {chunk}), ceil(({n}) / {chunk_items})) AS INT)")
        main = main.select("bucket", F.col("m.comp").alias("main"), amount("m.c", "m.items").alias("mine"), amount("c - m.c", "items - m.items").alias("others")).checkpoint()
        rows = rows.join(F.broadcast(main) if main.count() <= broadcast_rows else main, "bucket").withColumn("inside", F.col("comp") == F.col("main"))
        own = F.pmod(F.xxhash64("rep"), F.when(F.col("inside"), F.col("mine")).otherwise(F.col("others"))).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        place = lambda side, a, b: F.struct(side.alias("side"), a.alias("a"), b.alias("b"))
        against = F.transform(every("mine"), lambda p: place(F.lit(1), p, F.col("own")))
        side = lambda q: F.when(q == F.col("own"), -1).otherwise((q < F.col("own")).cast("int"))
        among = F.transform(every("others"), lambda q: place(side(q), F.least(q, F.col("own")) - F.col("others"), F.greatest(q, F.col("own"))))
        held = F.transform(every("others"), lambda q: place(F.lit(0), F.col("own"), q))
        rows = rows.withColumn("own", own)
        rows = rows.withColumn("at", F.explode(F.when(F.col("inside"), held).otherwise(F.concat(against, among))))
        rows = rows.select("rep", "comp", F.xxhash64("bucket", "at.a", "at.b").alias("group"), "at.side").checkpoint()
        add(proposed(rows, None).select("a", "b").distinct())
    reached = classes.select("rep", "least_id").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    reached = reached.withColumn("label", F.coalesce("label", "rep"))
    smallest = reached.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_rep = reached.join(smallest, "label").select("rep", "component_id")
    full = signed.select("doc_id", "n_shingles", "rep").join(by_rep, "rep", "left")
    own = F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return full.select(
        "doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
    )


def op8_setsketch_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"))
