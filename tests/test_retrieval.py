"""The stored inverted index: against sums over plain lists, in a later session, and what a search skips."""

import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest

from foliospark.functions.udfs import ratio_from
from foliospark.operators.inverted import read_index, search_index, write_index


def brute(docs, asked, k, k1=1.5, b=0.75):
    tokens = {c: re.findall(r"\w+", (t or "").lower()) for c, t in docs}
    n, avgdl = len(docs), sum(map(len, tokens.values())) / max(1, len(docs))
    df = Counter(t for x in tokens.values() for t in set(x))
    raw = {t: math.log(n - v + 0.5) - math.log(v + 0.5) for t, v in df.items()}
    mean = sum(raw.values()) / max(1, len(raw))
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    out = []
    for q, text in asked:
        words = Counter(re.findall(r"\w+", text.lower()))
        if not words:
            continue
        scores = {}
        for c, x in tokens.items():
            tf = Counter(x)
            scores[c] = sum(m * idf[t] * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(x) / avgdl)) for t, m in words.items() if tf[t])
        order = sorted(scores, key=lambda c: (-round(scores[c], 9), c))[:k]
        out += [(q, r, c, round(scores[c], 6)) for r, c in enumerate(order, 1)]
    return sorted(out)


def rows_of(frame):
    return sorted((r["question_id"], r["rank"], r["chunk_id"], round(r["score"], 6) + 0.0) for r in frame.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = []
    for c in range(700):
        words = [rng.choice(vocabulary[: rng.choice([3, 30, 300])]) for _ in range(rng.randint(0, 40))]
        docs.append((c, " ".join(words) or None))
    asked = [(q, " ".join(rng.sample(vocabulary, 4) + ["w0", "w1"])) for q in range(30)] + [(90, "nothing known"), (91, "!!"), (92, "w0"), (93, "w299 w299")]
    return docs, asked, spark.createDataFrame(docs, "chunk_id int, text string").repartition(5), spark.createDataFrame(asked, "question_id int, query string")


@pytest.mark.parametrize("k,block_rows,narrow", [(5, 16, 10**6), (50, 64, 0), (700, 4096, 10**6)])
def test_equals_sums_over_lists(spark, corpus, tmp_path, k, block_rows, narrow):
    docs, asked, chunks, queries = corpus
    index = write_index(chunks, str(tmp_path / "index"), block_rows=block_rows)
    found, visits = search_index(index, queries, k, broadcast_rows=narrow)
    assert rows_of(found) == brute(docs, asked, k)
    counts = {r["question_id"]: (r["blocks"], r["scored"]) for r in visits.collect()}
    assert all(a >= b for a, b in counts.values())
    if block_rows == 16:
        assert sum(b for _, b in counts.values()) < 0.9 * sum(a for a, _ in counts.values())


def test_negative_scores_come_behind_chunks_without_a_match(spark, tmp_path):
    docs = [(c, "aa") for c in range(10)] + [(10, "")]
    chunks = spark.createDataFrame(docs, "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "aa")], "question_id int, query string")
    index = write_index(chunks, str(tmp_path / "index"), block_rows=3)
    got = rows_of(search_index(index, queries, 5)[0])
    assert got == brute(docs, [(1, "aa")], 5) and got[0][2:] == (10, 0.0) and got[1][3] < 0


def test_later_session_reads_without_a_shuffle_of_postings(spark, corpus, tmp_path):
    docs, asked, chunks, queries = corpus
    write_index(chunks, str(tmp_path / "index"), block_rows=32, buckets=4)
    later = spark.newSession()
    index = read_index(later, str(tmp_path / "index"))
    again = later.createDataFrame(queries.toPandas(), "question_id int, query string")
    found, _ = search_index(index, again, 5)
    assert rows_of(found) == brute(docs, asked, 5)
    blocks = index.postings.select("block", "postings").groupBy("block")
    plan = blocks.cogroup(later.createDataFrame([(1,)], "block int").groupBy("block")).applyInArrow(lambda a, b: b, "block int")
    text = plan._jdf.queryExecution().executedPlan().toString()
    scan = text[text.index("Scan parquet") - 400 : text.index("Scan parquet")]
    assert "Bucketed: true" in text and "Exchange" not in scan.rsplit("FlatMapCoGroups", 1)[-1]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "aa")], "question_id int, query string")
    assert search_index(write_index(none, str(tmp_path / "index")), queries, 5)[0].count() == 0
    some = spark.createDataFrame([(1, "x")], "chunk_id int, text string")
    assert search_index(write_index(some, str(tmp_path / "some")), queries.where("false"), 5)[0].count() == 0


def test_similarity_compares_only_likely_pairs(spark):
    from difflib import SequenceMatcher

    from foliospark.operators.grounding import gold_similarity, similar_pairs

    rng = random.Random(4)
    words = ["bail", "Act", "Ünder", "138", "court", "the", "of", "x", "é"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    asked = [(q, q % 5, text(rng.randint(0, 12))) for q in range(40)] + [(90, 1, None), (91, 2, "")]
    held = [(f"c{k}", k % 5, text(rng.randint(0, 60))) for k in range(60)] + [("n", 1, None), ("e", 2, "")]
    items = spark.createDataFrame(asked, "question_id int, cnr int, supporting_text string")
    chunks = spark.createDataFrame(held, "chunk_id string, cnr int, text string")
    scores = {(q, c): SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio() for q, n, a in asked for c, m, b in held if n == m}
    pairs = {(r["question_id"], r["chunk_id"]): r["bound"] for r in similar_pairs(items, chunks).collect()}
    assert set(pairs) == set(scores) and all(pairs[k] >= s - 1e-12 for k, s in scores.items())
    assert sum(b >= 0.5 for b in pairs.values()) < 0.8 * len(pairs)
    expected = []
    for q, _, _ in asked:
        best = sorted((-s, c) for (p, c), s in scores.items() if p == q and s >= 0.5)[:2]
        expected += [(q, k, c, -s) for k, (s, c) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in gold_similarity(items, chunks, 0.5, 2).collect()) == sorted(expected)


def test_ratio_is_that_of_difflib_from_the_least_on():
    rng = random.Random(6)
    words = ["court", "of", "appeal", "the", "x", "zq", "é", "\U0001d11e", "7"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))[: rng.randint(0, 6 * n + 1)]

    pairs = [("", ""), ("", "a"), ("a", "")]
    for _ in range(300):
        b = text(rng.choice([3, 30, 45, 60, 200]))
        at = rng.randint(0, len(b))
        pairs.append((rng.choice([text(40), b[at : at + 150], text(5) + b[at : at + 90] + text(9), "".join(rng.choice("ab ") for _ in range(80))]), b))
    for a, b in pairs:
        whole = SequenceMatcher(None, a, b).ratio()
        assert ratio_from(a, b) == whole
        for least in (0.1, 0.3, 0.5, whole):
            assert ratio_from(a, b, least) == (whole if whole >= least else 0.0)


def test_pairs_that_cannot_reach_the_least_end_early():
    """By the signs looked at: these two share less than half of their signs."""
    looked = []

    class Text(str):
        def __getitem__(self, k):
            looked.append(k)
            return str.__getitem__(self, k)

    rng = random.Random(7)
    a, b = ("".join(chr(200 + rng.randrange(200)) for _ in range(n)) for n in (420, 1200))
    ratio_from(Text(a), b)
    every = len(looked)
    looked.clear()
    assert ratio_from(Text(a), b, 0.5) == 0.0 and len(looked) < every / 10
