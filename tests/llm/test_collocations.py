"""Collocations against counts over plain Python lists; quotient filters against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import collocations
from foliospark.llm.collocations import compacted, mine_collocations, op11_collocations, stretches
from foliospark.llm.quotient import QuotientFilter, permuted, restored


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words) if lang is None or lang else 0
            for size in range(1, 5):
                counts[lang or "und"].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    if 100 * a >= 80 * f[p[k : k + size]]:
                        covered.add(p[k : k + size])
        rated = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


def made(n, seed=2):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "new", "york", "city", "é", "x\x00y", "in", "#1"]
    phrases = ["new york city hall", "as soon as", "a a a a a a", "of the"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]
    texts = ["".join(rng.choice(words + phrases) + rng.choice(ends) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [(t, rng.choice(["en", "en", "de", None])) for t in texts] + [(None, "en"), ("", "fr"), (" . ", None)]


@pytest.mark.parametrize("least,top,block,task", [(3, 50, 1 << 20, 1 << 19), (5, 2000, 100, 64), (2, None, 7, 16)])
def test_equals_counts_in_python(spark, least, top, block, task):
    rows = made(120)
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert rows_of(mine_collocations(frame, least=least, top=top, block_words=block, per_task=task)) == brute(rows, least, top)


def test_texts_cut_over_blocks(spark):
    text = " ".join(random.Random(4).choice("abc") for _ in range(400_000)) + " " * 3_000_000 + "a b c"
    rows = [(text, "en")] * 3
    frame = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert rows_of(mine_collocations(frame, block_words=30_000)) == brute(rows, 30, 2000)


def test_query_equals_counts_in_python(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{path}/documents.parquet").select("text", "lang").collect()]
    got = rows_of(op11_collocations(spark, path))
    assert len(got) > 100 and got == brute(rows, 30, 2000)


def test_odd_rows(spark, odd, none):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert rows_of(mine_collocations(odd.withColumn("phrase", odd["text"]), least=2)) == brute(rows, 2, 2000)
    assert mine_collocations(none).count() == 0
    assert mine_collocations(spark.createDataFrame([("a b",)] * 29, "text string").selectExpr("text", "CAST(NULL AS STRING) AS lang")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**20 - 1), max_size=60), st.integers(1, 64).filter(lambda b: b % 2 == 0 and b >= 20), st.integers(0, 6))
def test_filters_lose_nothing(keys, bits, prefix):
    counted = np.arange(len(keys)) % 3 != 0
    array = np.array(keys, np.uint64)
    assert (restored(permuted(array, bits), bits) == array).all()
    made = QuotientFilter.of(array, counted, bits)
    parts = [QuotientFilter.from_bytes(f.to_bytes()) for _, f in made.parts(prefix)]
    expected = Counter({k: 0 for k in keys})
    for k, c in zip(keys, counted, strict=True):
        expected[k] += int(c)
    assert {k: n for f in parts for k, n in zip(f.keys().tolist(), f.counts.tolist(), strict=True)} == dict(expected)
    for f in parts:
        twice = QuotientFilter.merged([f, f])
        assert (twice.values == f.values).all() and (twice.counts == 2 * f.counts).all()


def test_large_counts_and_whole_width():
    keys = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    made = QuotientFilter(np.sort(permuted(keys, 64)), np.array([0, 254, 255, 2**40]), 64)
    again = QuotientFilter.from_bytes(made.to_bytes())
    assert (again.values == made.values).all() and (again.counts == made.counts).all()
    assert sorted(again.keys().tolist()) == sorted(keys.tolist())


def test_runs_and_cuts_by_hand():
    level, old = compacted(np.array([5, 0, 6, 7, 0, 8, 0, 0, 1, 2, 3], np.uint32), 4)
    assert level.tolist() == [0, 6, 7, 0, 1, 2, 3] and old == 3
    assert b"".join(stretches(b"ab cd,ef" * 9, 4)) == b"ab cd,ef" * 9
    assert all(not x[1:].startswith(b" ") for x in stretches(b"ab cd,ef" * 9, 4))


def test_stored_blocks_stand_in_small_row_groups(spark, monkeypatch, tmp_path):
    """Whoever writes or reads stored blocks holds a row group: with 20 blocks in a task it must not be all of them."""
    monkeypatch.setattr(collocations, "scratch", lambda spark: str(tmp_path))
    monkeypatch.setattr(collocations, "discard", lambda spark, path: None)
    rng = np.random.default_rng(5)
    rows = [(" ".join(map(str, rng.integers(0, 1 << 40, 100_000).tolist())), "en") for _ in range(20)]
    mine_collocations(spark.createDataFrame(rows, "text string, lang string").coalesce(1), block_words=100_000)
    sizes = [f.row_group(k).total_byte_size for p in tmp_path.glob("blocks/*.parquet") for f in [pq.ParquetFile(p).metadata] for k in range(f.num_row_groups)]
    assert sum(sizes) > 30 << 20 and max(sizes) < 16 << 20


def test_answers_are_not_gathered_in_lists(spark, monkeypatch):
    """A block's answers stream into its cogroup; lists of them by block filled an executor's heap."""
    plans = []
    real = collocations.written
    monkeypatch.setattr(collocations, "written", lambda df, path: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, path))
    rows = made(120)
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(mine_collocations(frame, least=3, top=50, block_words=100)) == brute(rows, 3, 50)
    assert any("CoGroup" in x for x in plans) and not any("collect_list" in x for x in plans)
