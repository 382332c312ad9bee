import math
import random
import resource

import numpy as np
from pyspark.sql import functions as F
from foliospark.llm.language_id import LanguageModel, fit_language_model, identify, op4_language_id, shuffled_letters
from foliospark.llm.licenses import evaluate, scan, scan_licenses, to_postfix
from foliospark.llm.near_dedup import shingle_sets
from foliospark.llm.quality import Neighbours, features, fit_neighbours, op7_quality_knn, score_quality


def test_licence_expressions():
    assert to_postfix("MIT OR Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0") == [
        "mit", "apache-2.0", "gpl-2.0-only", "classpath-exception-2.0", "with", "and", "or",
    ]
    assert evaluate(to_postfix("(MIT OR GPL-3.0) AND Apache-2.0")) == ({"mit", "gpl", "apache"}, 0.15)
    assert to_postfix("MIT */ rest") == ["mit"]
    assert to_postfix("MIT AND") == ["mit"] and to_postfix("(MIT OR") == ["mit"] and to_postfix("") == [] and to_postfix("and MIT") == []


def test_scan_matches_plain_search():
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    texts = ["CC-BY cc by CC/by", "All rights, reserved. all RIGHTS reserved", "", "général public license", "accc by by cc by", "x" * 5000 + " cc by",
             "GNU Lesser General Public License cc cc by"]
    for text in texts:
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        hits = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        got = scan(text.encode())
        assert got[:4] == (len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None)
        assert got[4] == ",".join(sorted({x for _, x in hits}))
    several = {
        b"SPDX-License-Identifier: MIT; SPDX-License-Identifier: GPL-2.0-only": ("gpl,mit", 0.8),
        b"/* SPDX-License-Identifier: (MIT OR GPL-2.0-only) SPDX-License-Identifier: Apache-2.0 SPDX license identifier ISC */ x": ("apache,gpl,isc,mit", 0.15),
        b"spdx SPDX-License-Identifier: SPDX-License-Identifier: Zlib\nGPL-2.0": ("zlib", 0.5),
        b"SPDX-License-Identifier: see the file": ("", 0.0),
        b"\xc3\xa9 SPDX-License-Identifier: LicenseRef-Own": ("licenseref-own", 0.5),
        b"SPDX-License-Identifier:": ("", 0.0),
        b"no tag at all": ("", 0.0),
        b"": ("", 0.0),
    }
    for text, (labels, strength) in several.items():
        assert scan(text)[5:] == (labels, strength), text
    got = scan(b"// SPDX-License-Identifier: MIT OR BSD-3-Clause\ncode")
    assert got[5] == "bsd,mit" and got[6] == 0.1


def test_scan_table_edges(odd, none):
    got = scan_licenses(odd)
    assert got.count() == odd.count() and got.where("text IS NULL").first()["n_words"] == 0
    assert scan_licenses(none).count() == 0


def test_language_model_by_brute_force(spark, odd, none):
    assert fit_language_model(none) is None
    assert identify(odd, None).where("lang_pred = 'und' AND rejected").count() == odd.count()
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(80)]
    model = fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in identify(odd.where("doc_id IN (3, 4, 5, 10, 11)"), model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["rejected"] for k in (3, 4, 5, 10))
    assert got[11]["lang_pred"] in ("en", "de") and "lang" in got[11]
    data, offsets = np.frombuffer(b"the dogder hund", np.uint8), np.array([0, 7, 15])
    (best, score), (_, alone) = model.judge(data, offsets), model.judge(data[:7], np.array([0, 7]))
    assert np.allclose(score[0], alone[0]) and isinstance(model, LanguageModel)
    assert [model.languages[k] for k in best] == ["en", "de"]


def _bucket(gram, bits=12):
    h = (gram[0] + len(gram) * 0x9E37) % 2**32
    for c in gram[1:]:
        h = (h * 0x01000193 % 2**32) ^ c
    h = h * 0x85EBCA6B % 2**32
    h = (h ^ (h >> 15)) * 0xC2B2AE35 % 2**32
    return h >> (32 - bits)


def _plain_score(model, text):
    """Look-ups gram by gram: 2 to 4 bytes, with a blank at most at either end. Number of the language, and score."""
    data = b" " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()) + b" "
    found = []
    for size in (2, 3, 4):
        for k in range(len(data) - size + 1):
            gram = data[k : k + size]
            if 32 not in gram[1:-1] and (gram[0] != 32 or gram[-1] != 32):
                found.append(_bucket(gram))
    p = model.confidence((model.scores[found].astype(float).mean(0) + model.bias)[None, :])[0]
    usual = float(model.usual[found, p.argmax()].astype(float).mean())
    return int(p.argmax()), p.max() / (1 + math.exp(min(50, -model.curve[0] * (usual - model.curve[1]))))


def test_predictions_by_plain_look_ups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_language_model(docs)
    rows = docs.orderBy("doc_id").limit(40).collect()
    long = " ".join(r["text"] for r in rows if r["lang"] == "de")
    long = long * (1 + 2_500_000 // len(long))
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows] + [(-1, long), (-2, long[:2000] + "é" * 1_500_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in identify(frame, model).collect()}
    for doc, text in [(r["doc_id"], r["text"]) for r in rows] + [(-1, long)]:
        best, score = _plain_score(model, text)
        assert got[doc]["lang_pred"] == model.languages[best] and abs(got[doc]["score"] - score) < 1e-5
        assert got[doc]["rejected"] == bool(score < model.threshold)
    assert got[-1]["lang_pred"] == "de" and 0 < got[-2]["score"] < 1


def test_text_unlike_the_training_rows_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = fit_language_model(docs.where("crc32(CAST(doc_id AS STRING)) % 3 <> 1"))
    assert 2.0**-6 < model.temperature < 2.0**10 and 0 < model.threshold < 0.5
    held = docs.where("crc32(CAST(doc_id AS STRING)) % 3 = 1")
    assert identify(held, model).where("rejected").count() <= 0.01 * held.count()
    rng = random.Random(5)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(80)) for _ in range(20)]
    keys = [" ".join("".join(rng.choice("qwertasdfgzxcvb") for _ in range(rng.randint(4, 9))) for _ in range(8)) for _ in range(20)]
    other = ["これは日本語の文章です。今日は天気がいい。", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina"]
    mixed = [shuffled_letters(r["text"]) for r in held.where("length(text) > 200").limit(50).collect()]
    frame = spark.createDataFrame([(t,) for t in hexes + keys + other + mixed], "text string")
    assert identify(frame, model).where("rejected").count() >= 0.95 * frame.count()
    assert sorted(shuffled_letters("ab, cd é!")) == sorted("ab, cd é!") and shuffled_letters("") == ""


def test_any_number_of_languages(spark):
    rows = [(70 * i + k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}q" for x in "abcdefgh"), f"l{k:02}") for k in range(70) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(frame)
    assert len(model.languages) == 70 and identify(frame, model).count() == len(rows)
    few = fit_language_model(frame, most_languages=3, most_rows=12)
    assert few.languages == ("l00", "l01", "l02")


def test_language_held_out_accuracy(spark):
    got = op4_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.98 * held.count()
    assert got.where("rejected").count() <= 0.01 * got.count()


def test_quality_held_out_accuracy_and_edges(spark, odd, none):
    got = op7_quality_knn(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id")
    assert held.where("quality = 1 AND predicted = 1").count() >= 0.98 * held.where("quality = 1").count()
    assert held.where("quality = 0 AND predicted = 0").count() >= 0.5 * held.where("quality = 0").count()  # 19 rows
    pairs = held.where("quality = 1").select(F.col("score").alias("a")).join(held.where("quality = 0").select(F.col("score").alias("b")))
    assert pairs.agg(F.avg((F.col("a") > F.col("b")).cast("int") + (F.col("a") == F.col("b")).cast("int") / 2)).first()[0] >= 0.95
    model = fit_neighbours(odd, labels.limit(0))
    assert model is None and score_quality(odd, model).where("score = 0.5").count() == odd.count()
    assert score_quality(none, None).count() == 0


def test_votes_by_plain_cosines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = fit_neighbours(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = docs.orderBy("doc_id").limit(60).collect()
    got = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect()}
    for r in rows:
        data = np.frombuffer(r["text"].encode(), np.uint8)
        x = features(data, np.array([0, len(data)]))[0] @ model.space
        votes = []
        for k, v in enumerate(model.vectors):
            votes.append((-float(x @ v) / max(float(np.linalg.norm(x)), 1e-9), k))
        near = sorted(votes)[: model.k]
        weight = [max(-s, 0) * model.weights[k] for s, k in near]
        want = sum(w * model.labels[k] for w, (_, k) in zip(weight, near)) / sum(weight)
        assert abs(got[r["doc_id"]] - want) < 1e-4


def test_long_rows_in_stretches():
    rng = np.random.default_rng(3)
    words = ["a", "bb", "é", "ccc", "a a", "\n", "  ", "dddd."]
    text = " ".join(words[k] for k in rng.integers(0, len(words), 4000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    for most in (7, 64, 1000):
        assert np.allclose(features(data, offsets, most), features(data, offsets), atol=1e-6)
    long = np.frombuffer(b"word again again " * 6_000_000, np.uint8)  # 102 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert features(long, np.array([0, len(long)])).shape == (1, 4097)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    long = np.frombuffer("".join(f"w{k * 7919 % 9_999_991} " for k in range(11_000_000)).encode(), np.uint8)  # 98 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    sets, bounds = shingle_sets(long, np.array([0, len(long)]))
    assert len(sets) == bounds[1] > 9_000_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_tied_neighbours_are_the_first_ones():
    vectors = np.array([[1.0, 0.0]] * 40, np.float32)
    labels = np.array([1.0] * 5 + [0.0] * 35)
    model = Neighbours(np.eye(2, dtype=np.float32), vectors, labels, np.ones(40), 0.5, 10)
    assert np.allclose(model.scores(np.array([[1.0, 0.0], [2.0, 0.0]], np.float32)), 0.5)


def test_scan_of_many_notices_takes_time_in_proportion():
    import time

    def seconds(n):
        began = time.process_time()
        got = scan(b"all rights reserved cc by " * n)
        assert got[1:4] == (2 * n, 0, 5 * n - 2)
        return time.process_time() - began

    seconds(100)
    assert seconds(80_000) < 12 * max(seconds(20_000), 0.01)
