"""Token alignment against whole texts read at once by both libraries and groups found by walking over all bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliospark.llm import alignment
from foliospark.llm.alignment import Pieces, align_tokenizers, aligned, default_vocabularies, links, op12_token_alignment, read_block, tokenizers


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_level():
    """Byte of each sign of the byte-level alphabet."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(libraries, rows):
    first, second = libraries
    signs, out, held = byte_level(), [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a_ids, b_ids = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            a = [bytes(signs[c] for c in first.id_to_token(x)) for x in a_ids]
            b = [bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b_ids]
            if b"".join(a) == b"".join(b) == (" " + text).encode():
                i = j = at_a = at_b = p = q = 0
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        at_a, i = at_a + len(a[i]), i + 1
                    else:
                        at_b, j = at_b + len(b[j]), j + 1
                    if at_a == at_b:
                        groups.append((a_ids[p:i], b_ids[q:j]))
                        p, q = i, j
        pairs = Counter((x, y) for s, t in groups for x in s for y in t)
        held.update(pairs.keys())
        out.append((doc_id, groups, pairs))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    result = []
    for doc_id, groups, pairs in out:
        said = ";".join(",".join(map(str, s)) + "|" + ",".join(map(str, t)) for s, t in groups)
        result.append(
            (doc_id, sum(len(s) for s, _ in groups), sum(len(t) for _, t in groups), len(groups), sum(pairs.values()),
             sum(n for p, n in pairs.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in pairs.items()),
             hashlib.sha256(said.encode()).hexdigest() if groups else "")
        )
    return sorted(result, key=str)


def odd_texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " \n ", "a", "the", "'s", "don't", "é", "漢字", "😀", "▁", "<s>", "<|endoftext|>", "<0x41>", "12345", "...", " ", " ", "\x1c", "\x00", "word", "Größe", "!", "     ", "x²", "²", ".", "II", "Ⅻ", ",", "_", "-", "'", "¹.", "a.b", "ö,", "́"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    return [*made, " ", "a ", " a", "  ", "\n", "x" * 300, None, "", " " * 40 + "end", "á b"]


def rows_of(frame):
    order = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in order) for r in frame.collect()), key=str)


def test_odd_texts_equal_whole_reading(spark, libraries, monkeypatch):
    rows = list(enumerate(odd_texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(align_tokenizers(frame)) == brute(libraries, rows)


def test_query_equals_brute_force(spark, libraries):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert rows_of(op12_token_alignment(spark, path)) == brute(libraries, rows)


def test_small_blocks_and_stretches_give_the_same(monkeypatch):
    texts = odd_texts()[:200] + [" ".join(odd_texts()[200:400])]
    both = tokenizers(*default_vocabularies())
    whole = read_block(Pieces(both), texts)
    short = alignment.stretches
    monkeypatch.setattr(alignment, "stretches", lambda text, place: short(text, place, 16))
    cut = read_block(Pieces(both), texts)
    assert cut["digests"] == whole["digests"] and all((cut[k] == whole[k]).all() for k in ("sizes", "pairs", "held", "ends", "links", "times"))


def test_groups_and_links_by_hand():
    assert aligned([2, 3, 6, 7], [3, 5, 7]) == ([2, 4], [1, 3])
    assert aligned([], []) == ([], [])
    keys, times, slices = links(np.array([5, 5, 1]), np.array([6, 6, 7, 9]), np.array([2, 3]), np.array([3, 4]))
    assert sorted(zip(keys.tolist(), times.tolist(), slices.tolist())) == sorted([(1 << 32 | 9, 1, 1), *[(5 << 32 | y, 1, 0) for y in (6, 6, 7)] * 2])
    a, b = np.arange(300) % 7, np.arange(200) % 3
    keys, times, _ = links(a, b, np.array([300]), np.array([200]))
    expected = Counter(int(x) << 32 | int(y) for x in a for y in b)
    assert dict(zip(keys.tolist(), times.tolist())) == dict(expected)


def test_odd_rows(spark, odd, none, libraries):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(align_tokenizers(odd)) == brute(libraries, rows)
    assert align_tokenizers(none).count() == 0
    assert align_tokenizers(odd, id_col="source").columns[0] == "source"


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    """By pieces and by bytes; what it forgets and reads again gives the same numbers."""
    both_of = tokenizers(*default_vocabularies())
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "of", "a.", "word%d" % rng.randrange(4000), "ab" * rng.randrange(1, 400)]) for _ in range(200)) for _ in range(40)]
    expected = [read_block(Pieces(both_of), [t]) for t in texts]
    for pieces, size in ((300, 1 << 26), (10**6, 100_000)):
        monkeypatch.setattr(alignment, "REMEMBERED", pieces)
        monkeypatch.setattr(alignment, "BYTES", size)
        known, forgotten = Pieces(both_of), 0
        for text, whole in zip(texts, expected, strict=True):
            if known.full():
                known, forgotten = known.forget(), forgotten + 1
                assert len(known) <= pieces // 2 and known.held + 16 * len(known.keys) <= size // 2 and " the" in known
            got = read_block(known, [text])
            assert all(np.array_equal(got[x], whole[x]) for x in whole)
        assert forgotten > 5


def test_counts_are_not_gathered_in_lists(spark):
    """A block's counts stream into its cogroup; lists of them by block would stand on an executor's heap."""
    got = align_tokenizers(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "collect_list" not in plan
    assert sorted((r.doc_id, r.n_groups > 0) for r in got.collect()) == [(1, True), (2, False)]
