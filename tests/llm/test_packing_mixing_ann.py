import sys
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import public_tokenizers
from foliospark.llm import ann
from foliospark.llm.ann import nearest, op10_graph_search
from foliospark.llm.mixing import in_mixture_order, mix, quotas, schedule
from foliospark.llm.packing import best_fit, complete_bins, fillings, lower_bound, op6_best_fit_packing, pack, pack_documents
from tokenizers import Tokenizer


def test_ids_are_those_of_the_tokenizer(spark):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op6_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc, text in docs.items():
        ids = np.array(reference.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        got = sorted(pieces[doc], key=lambda r: r["piece"])
        assert sum(r["length"] for r in got) == len(ids) and all(r["length"] == 2048 for r in got[1:])
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0] + [n for _, n in spans])[:-1]) and sum(n for _, n in spans) <= 2048
    assert len(used) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_packing_edges(odd, none):
    got = pack_documents(odd, with_ids=True).collect()
    assert {len(r["ids"]) == r["length"] for r in got} == {True} and pack_documents(none).count() == 0
    assert sum(r["piece"] == 0 for r in got) == odd.count()
    special = [r for r in got if r["doc_id"] == 9 and 50256 in r["ids"]]
    assert len(special) == 1


def test_a_long_run_of_blanks_is_packed(spark):
    text = "a" + " " * 1_200_000 + "b"
    got = pack_documents(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), with_ids=True).collect()
    ids = [i for r in sorted((r for r in got if r["doc_id"] == 1), key=lambda r: r["start"]) for i in r["ids"]]
    assert ids == Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids + [0]


def _fewest(sizes, capacity):
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k]:
                place(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        place(k + 1, rooms + [capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_bin_completion_reaches_the_optimum():
    rng = np.random.default_rng(5)
    for _ in range(25):
        sizes = np.sort(rng.integers(15, 70, 9))[::-1]
        number, _ = pack(sizes, 100)
        assert number.max() + 1 == _fewest(sizes.tolist(), 100) >= lower_bound(sizes, 100)
    sizes = np.array([60, 50, 30, 20, 20, 20])
    assert complete_bins(sizes, 100, len(best_fit(sizes, 100)) + 1, 500) is not None


def test_bin_completion_of_a_block_of_many_sequences():
    sizes = np.tile([60, 50, 30, 20, 20, 20], 900)
    assert len(best_fit(sizes, 100)) > 1800
    number, offset = pack(sizes, 100)
    assert number.max() + 1 == lower_bound(sizes, 100) == 1800
    assert np.bincount(number, sizes).max() <= 100 and (offset + sizes).max() <= 100


def _plain_fillings(counts, room, waste, most):
    """All multisets to which no piece can be added that is as small as their smallest one, without those that another one dominates."""
    stock = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
    sets = {x for n in range(len(stock) + 1) for x in combinations(stock, n) if sum(x) <= room}

    def closed(a):
        return not any(s <= min(a, default=s) and s <= room - sum(a) for s in Counter(stock) - Counter(a))

    def dominates(b, a):
        return a != b and (len(a) == len(b) and all(x <= y for x, y in zip(a, b)) or len(b) == 1 and sum(a) <= b[0])

    ends = [a for a in sets if room - sum(a) <= waste and closed(a)]
    kept = [a for a in ends if not any(dominates(b, a) for b in ends)]
    return sorted(kept, key=lambda a: (-sum(a), len(a), a))[:most]


def test_fillings_are_all_undominated_ones_in_order():
    rng = np.random.default_rng(8)
    for _ in range(300):
        values, amounts = np.unique(rng.integers(3, 30, rng.integers(0, 8)), return_counts=True)
        counts, room, waste = dict(zip(values.tolist(), amounts.tolist())), int(rng.integers(0, 60)), int(rng.integers(0, 15))
        got = list(fillings(counts, values.tolist(), room, waste))
        assert got == _plain_fillings(counts, room, waste, 32)


def test_a_search_that_finds_nothing_better_is_cheap():
    sizes, calls = np.sort(np.random.default_rng(3).integers(400, 800, 200)), [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        number, _ = pack(sizes, 2048)
    finally:
        sys.setprofile(None)
    assert number.max() + 1 == 59 and len(best_fit(sizes, 2048)) == 62
    assert calls[0] < 500_000


def test_a_search_among_many_pieces_of_one_token():
    sizes = np.array([1] * 1500 + [700] * 1000)
    number, offset = pack(sizes, 2048)
    assert number.max() + 1 == 500 and np.bincount(number, sizes).max() <= 2048 and (offset + sizes).max() <= 2048


def _plain_schedule(weights, slots):
    """Earliest deadline first over exact fractions, slot by slot and without a period: (source, block) of each slot."""
    total = sum(Fraction(str(w)) for w in weights.values())
    share = {s: Fraction(str(w)) / total for s, w in weights.items()}
    done, out = dict.fromkeys(share, 0), []
    for t in range(slots):
        ready = [s for s in share if done[s] / share[s] // 1 <= t]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) / share[s] // 1), -share[s], s))
        out.append((s, done[s]))
        done[s] += 1
        assert all(abs(done[x] - share[x] * (t + 1)) < 1 for x in share)
    return out


def test_schedule_stays_within_a_block():
    many = ({"a": 5, "b": 3, "c": 2}, {str(k): k + 1 for k in range(40)}, {"a": 0.98, "b": 0.01, "c": 0.01}, {str(k): 1 for k in range(7)}, {"a": 0.9999, "b": 0.0001})
    for weights in many:
        quota = quotas(weights)
        period = schedule(quota)
        total = sum(weights.values())
        assert all(abs(quota[s] / len(period) - w / total) < 1e-12 for s, w in weights.items())
        slots = min(4 * len(period), 3000)
        seen, got = dict.fromkeys(quota, 0), []
        for t in range(slots):
            s = period[t % len(period)]
            got.append((s, seen[s]))
            seen[s] += 1
        assert got == _plain_schedule(weights, slots)
    rounded = quotas({"a": 1.0, "b": 2**0.5, "c": 1e-9}, 1 << 10)
    assert sum(rounded.values()) == 1 << 10 and rounded["c"] == 1
    assert sum(quotas({str(k): 1 + k % 3 for k in range(3000)}, 1 << 10).values()) >= 3000


def test_mixing_by_brute_force(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    weights = {"src0": 3.0, "src1": 1.0}
    rows = mix(docs, weights, block_rows=4, bucket_rows=20, group_buckets=2).collect()
    every = {f"src{k}": weights.get(f"src{k}", 2.0) for k in range(20)}
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    slots = {(s, b): t for t, (s, b) in enumerate(_plain_schedule(every, 40 * (2 + max(len(x) for x in by.values()) // 4)))}
    assert len(rows) == docs.count()
    for s, group in by.items():
        taken = sorted((r["mix_block"], r["mix_row"]) for r in group)
        assert taken == [(k // 4, k % 4) for k in range(len(group))]
        for r in group:
            assert r["mix_slot"] == slots[s, r["mix_block"]] and r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
    mixed = mix(odd)
    assert mixed.count() == odd.count() and mixed.columns[: len(odd.columns)] == [c for c in odd.columns if c != "mix_slot"] + ["mix_source"]
    assert mix(none).count() == 0 and in_mixture_order(mix(docs)).count() == docs.count()


def test_mixing_of_many_sources_and_rows_without_id(spark):
    rows = spark.range(6000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('s', id % 1500) AS source", "CAST(id AS STRING) AS text")
    got = mix(rows, bucket_rows=2).collect()
    assert len({(r["mix_slot"], r["mix_row"]) for r in got}) == 6000 and {r["mix_block"] for r in got} == {0}


def _recall(got, vectors, queries, k):
    ids = np.array(sorted(vectors))
    table = np.array([vectors[i] for i in ids])
    hit = total = 0
    for q in queries:
        score = table @ vectors[q]
        order = [ids[j] for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        found = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        hit, total = hit + len(set(order) & set(found)), total + len(order)
    return hit / total


def test_search_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    got = op10_graph_search(spark, "/root/testdata/sf0.01").collect()
    assert _recall(got, vectors, [i for i in vectors if i % 20 == 0], 20) >= 0.9
    rng = np.random.default_rng(1)
    made = {int(i): rng.normal(size=16) * rng.uniform(0.2, 3) for i in range(3000)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in made.items()], "vec_id long, embedding array<double>")
    got = nearest(frame, frame.where("vec_id % 50 = 0"), shard_rows=1000, k=10).collect()
    assert _recall(got, made, [i for i in made if i % 50 == 0], 10) >= 0.9


def test_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(0, [1.0] + [0.0] * 15)]
    for i in range(1, 41):
        rest = rng.integers(-4, 5, 15) / 8
        rows.append((i, [1.0, *rest.tolist()]))
    rows += [(i, [0.5, *(rng.integers(-4, 5, 15) / 8).tolist()]) for i in range(41, 200)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = nearest(frame, frame.where("vec_id = 0"), k=20).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 1.0) for i in range(1, 21)]


def test_search_edges(spark):
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 1.0]), (103, [float("nan"), 1.0, 1.0]),
            (104, [float("inf"), 1.0, 1.0]), (None, same), (105, [1.0, 1.0]), (0, same), (106, [-1.0, 0.0, 0.0]), (107, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "vec_id AS rank", "vec_id AS score")
    got = [r for r in nearest(frame, frame.where("vec_id % 20 = 0 OR vec_id = 105"), k=20).collect()]
    first = sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in first] == list(range(1, 21)) and first[0]["score"] == 5.25
    assert not [r for r in got if r["query_id"] in (100, 105)]
    assert nearest(frame.limit(0), frame).count() == 0 and nearest(frame, frame.limit(0)).count() == 0


def _found(x, k=20, asked=100):
    """Recall of each of some queries in a graph made and searched as a shard's is."""
    rng, scaled = np.random.default_rng(2), x / np.abs(x).max()
    square = (scaled**2).sum(1)
    lifted = np.concatenate([scaled, np.sqrt(square.max() - square)[:, None]], 1).astype(np.float32)
    graph, start = ann.build_graph(lifted, float(square.max()))
    start = ann.spread_starts(lifted, start)
    graph = ann.connected(lifted, graph, start)
    beam = ann.enough_beam(lifted, scaled, graph, start, 128, k + 1, 0.93)
    some = rng.choice(len(x), asked, replace=False)
    ids, _ = ann.beam_search(lifted, graph, start, np.concatenate([scaled[some], np.zeros((asked, 1))], 1).astype(np.float32), beam)
    true = np.argsort(-(scaled[some] @ scaled.T), axis=1)[:, :k]
    return np.array([len(set(a) & set(b)) / k for a, b in zip(ids.tolist(), true.tolist())])


def test_recall_without_structure_and_on_tight_clusters():
    rng = np.random.default_rng(1)
    assert _found(rng.normal(size=(2500, 64))).mean() >= 0.9
    long = rng.normal(size=(2500, 32))
    long[:20] *= 30
    assert _found(long).mean() >= 0.9
    tight = rng.normal(size=(60, 64))[rng.integers(0, 60, 4000)] + 0.01 * rng.normal(size=(4000, 64))
    got = _found(tight)
    assert got.mean() >= 0.9 and got.min() > 0


def test_points_without_a_way_to_them_get_links():
    points = np.eye(6, dtype=np.float32)
    graph = np.array([[1, -1], [0, -1], [3, -1], [2, -1], [-1, -1], [-1, -1]], np.int64)
    linked = ann.connected(points, graph, np.array([0]))
    reached, front = {0}, [0]
    while front:
        front = [int(y) for x in front for y in linked[x] if y >= 0 and y not in reached]
        reached |= set(front)
    assert reached == set(range(6)) and (linked[:, :2] == graph).all()
