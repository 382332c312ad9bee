import re
from collections import defaultdict

import numpy as np
import pytest
from foliospark.llm.components import components
from foliospark.llm.line_dedup import line_chunks, line_dedup
from foliospark.llm.near_dedup import near_dedup, shingle_sets


def _chunks(text):
    """Chunks of a text, written anew line by line: (bytes, takes part)."""
    import xxhash

    out, held, before = [], [], 0
    for line in text.split(b"\n"):
        h = xxhash.xxh64_intdigest(line)
        turned = ((before << 7) | (before >> 57)) % 2**64
        rolled = h ^ (turned * 0x9E3779B97F4A7C15 % 2**64)
        rolled ^= rolled >> 29
        before = h
        if len(line.split()) >= 50:
            out += [held] if held else []
            out.append([line])
            held = []
            continue
        held.append(line)
        if ((rolled * 0xBF58476D1CE4E5B9 % 2**64) >> 32) % 2 == 0 and len(held) >= 2:
            out.append(held)
            held = []
    out += [held] if held else []
    return [(b"\n".join(x), sum(bool(y.strip()) for y in x) >= 2 or len(x[0].split()) >= 50) for x in out]


def _expected(rows):
    seen = defaultdict(list)
    for doc, text in rows:
        for no, (chunk, used) in enumerate(_chunks((text or "").encode())):
            if used:
                seen[chunk].append((doc, no))
    out = {}
    for doc, text in rows:
        chunks = _chunks((text or "").encode())
        keep = [c for no, (c, used) in enumerate(chunks) if not (used and len({d for d, _ in seen[c]}) > 1 and min(seen[c]) != (doc, no))]
        out[doc] = b"\n".join(keep).decode()
    return out


def test_line_dedup_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    passage = "\n".join(f"line {i} of a passage that comes again" for i in range(9))
    rows += [(10_000 + i, f"start {i}\n{passage}\nend {i} of it") for i in range(5)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    result = {r["doc_id"]: r for r in got.collect()}
    assert {k: r["text"] for k, r in result.items()} == _expected(rows)
    assert sum(r["chunks_removed"] > 0 for r in result.values() if r["doc_id"] > 10_000) == 4


def test_passages_of_few_lines_go_whole(spark):
    rows, want = [], {}
    for n in (1, 2, 3, 4, 6, 9):
        for case in range(8):
            words = [f"p{n}x{case}w{k}" for k in range(55)]
            lines = [" ".join(x) for x in np.array_split(words, n)]
            for copy in range(2):
                doc = n * 1000 + case * 10 + copy
                around = [f"line {k} of {doc} alone" for k in range(6)]
                rows.append((doc, "\n".join(around[:3] + lines + around[3:])))
                want[doc] = "\n".join(around) if copy else rows[-1][1]
    same = "\n".join(["again and again"] * 60)
    rows += [(1, same), (2, same), (3, "a\nb\nc\n" + " ".join(["w"] * 49))]
    want |= {1: "\n".join(["again and again"] * 17), 2: "", 3: rows[-1][1]}
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), passages=True).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all((r["chunks_removed"] > 0) == (r["bytes_removed"] > 0) for r in got)


def test_chunk_bounds_resist_shifts():
    lines = [f"row {i} {i * i}" for i in range(200)]
    a = set(line_chunks("\n".join(lines).encode()))
    b = set(line_chunks("\n".join(["new line here"] + lines[:50] + ["another"] + lines[50:]).encode()))
    assert len(a & b) >= 0.8 * len(a)
    assert b"\n".join(line_chunks(b"a\n\n\nb\n")) == b"a\n\n\nb\n"


def test_line_dedup_edges(odd, none):
    got = line_dedup(odd)
    assert got.count() == odd.count() and line_dedup(none).count() == 0
    texts = {(r["doc_id"], r["lang"]): r["text"] for r in got.collect()}
    assert texts[(3, "en")] is None and texts[(4, None)] == "" and texts[(7, "en")] == ""
    assert len(texts[(6, "en")]) > 10_000


def _sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 3:
        return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return frozenset([tuple(words)]) if words else frozenset()


def _components(rows):
    sets = [(i, _sets(t)) for i, t in rows]
    label = list(range(len(sets)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min([v for v in (least.get(root(k)), i) if v is not None], default=None)
    return [(i, len(s), least[root(k)] if s else i) for k, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("chunk", [2048, 8])
def test_near_dedup_by_brute_force(spark, chunk):
    rng = np.random.default_rng(3)
    words = [f"t{k}" for k in range(500)]
    rows = []
    for family in range(6):
        base = list(rng.choice(words, 120))
        for copy in range(25):
            text = list(base)
            for _ in range(int(rng.integers(0, 6))):
                text[int(rng.integers(0, len(text)))] = str(rng.choice(words))
            rows.append((family * 100 + copy, " ".join(text)))
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(_components(rows))


def test_a_bucket_of_many_components_in_parts(spark):
    rng = np.random.default_rng(8)
    base = [f"c{k}" for k in range(400)]
    rows = []
    for i in range(90):  # near enough to share bands, mostly not near enough to be linked
        text = list(base)
        for k in rng.choice(400, int(rng.integers(1, 26)), replace=False):
            text[k] = f"x{i}y{k}"
        rows.append((i, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(_components(rows))
    for chunk in (4, 16):
        got = near_dedup(frame, chunk=chunk, few=1).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    got = near_dedup(frame, chunk_items=3000, few=1).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_components_of_a_star_in_many_tasks(spark):
    links = spark.range(1, 5000).selectExpr("id AS a", "0L AS b").unionByName(spark.range(1, 50).selectExpr("id + 10000 AS a", "id AS b"))
    got = components(links, part_rows=500)
    assert got.count() == 5049 and got.where("label = 0").count() == 5049


def test_near_dedup_edges(odd, none):
    got = near_dedup(odd)
    assert near_dedup(none).count() == 0
    want = _components([(r["doc_id"], r["text"]) for r in odd.collect()])
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_shingles_do_not_cross_rows():
    data = np.frombuffer(b"a b c d" + b"A  b\tc d" + b"c d" + b"", np.uint8)
    s, bounds = shingle_sets(data, np.array([0, 7, 15, 18, 18]))
    assert np.diff(bounds).tolist() == [2, 2, 1, 0] and (s[:2] == s[2:4]).all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 200), (5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert all(got[k] == 1 for k in range(1, 61)) and got[200] == 100
    assert components(links.limit(0)).count() == 0
