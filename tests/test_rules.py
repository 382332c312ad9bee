"""Rules on small fixtures: references, dates, repeats, fingerprints, cleaning, citations, replies, statistics."""

import hashlib
import json

import numpy as np
import pytest
from foliospark.functions import answers, caseref, dates, textops, udfs
from foliospark.functions.stats_exprs import wilson
from foliospark.operators import chunks, corpus, retrieval, stats
from pyspark.sql import functions as F

TODAY = "2026-11-02"


def one(spark, values, rule, kind="string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in frame.orderBy("k").select(rule(F.col("v"))).collect()]


def test_case_references(spark):
    titles = ["WP/1519/2000", "Ram v. State  CRWP / 12 / 2015 decided", "WP(L)/45/2019", "CR. MISC./57199/2022 of A Vs B",
              "CR. MISC. APPLN./12/2019", "A B C D/9/2001", "12/2015", "", None, "Order in WP/5/2001", "WP/5/20011"]
    got = one(spark, titles, caseref.parse_case_reference)
    assert [r and r["code"] for r in got] == ["WP", "CRWP", "WP(L)", "CRMISC", "CRMISCAPPLN", "D", None, None, None, "WP", None]
    assert (got[0]["number"], got[0]["year"]) == ("1519", "2000")


def test_dates(spark):
    assert [str(x) for x in one(spark, ["2015-06-01T10:00:00", "2015-13-01", "not a date", None], dates.parse_iso_date)] == ["2015-06-01", "None", "None", "None"]
    status = one(spark, ["2015-06-01", " ", None, "x", "1850-01-01", "3021-03-24"], lambda c: dates.date_status(c, TODAY))
    assert status == ["ok", "missing", "missing", "unparseable", "implausible", "implausible"]
    assert one(spark, ["A_1_2015-01-01", "A_1_", "A_1", None], dates.cnr_date_text) == ["2015-01-01", "", None, None]
    frame = spark.createDataFrame([("2015-06-01", "X_1_2015-06-03")], "d string, c string")
    got = {r: frame.select(dates.resolve_date("d", "c", TODAY, r).alias("x")).first()["x"] for r in dates.RULES}
    assert (got["prefer_decision"]["judgment_date"], got["prefer_cnr"]["judgment_date"], got["agree_only"]["judgment_date"]) == ("2015-06-01", "2015-06-03", None)
    assert got["prefer_cnr"]["date_conflict"] and not got["prefer_cnr"]["year_conflict"]


@pytest.mark.parametrize("copies", [3, 20])
def test_repeats_collapse_to_one(copies):
    unit = "CORAM: A B SHARMA, J."
    text, removed = udfs.without_repeats(" ".join([unit] * copies) + " judgment follows")
    assert text == unit + " judgment follows" and removed == (copies - 1) * (len(unit) + 1)


def _plainly(words, low=3, high=60):
    """Word by word: at each place the shortest phrase that stands there twice loses its further copies."""
    out, at = [], 0
    while at < len(words):
        for p in range(low, high + 1):
            unit, copies = words[at : at + p], 1
            while words[at + copies * p : at + (copies + 1) * p] == unit and len(unit) == p:
                copies += 1
            if copies > 1:
                out, at = out + unit, at + copies * p
                break
        else:
            out, at = out + [words[at]], at + 1
    return out


def test_repeats_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        words = []
        while len(words) < 60:
            phrase = list(rng.choice(["a", "b", "c", "d"], int(rng.integers(1, 9))))
            words += phrase * int(rng.integers(1, 5))
        text = " ".join(words)
        got, removed = udfs.without_repeats(text)
        assert got.split() == _plainly(words) and removed == len(text) - len(got)


def test_repeats_left_alone():
    for text in ("that that", "- - - - - - - -", "one two three x one two three", "", "a b"):
        assert udfs.without_repeats(text) == (text, 0)
    tail = "x " * 2000
    assert udfs.without_repeats(tail + "a b c a b c")[0].endswith("a b c a b c")


def test_repeats_in_spark_match_the_helper(spark):
    texts = ["a b c A, b c. rest", "p q r " * 900, None, "no repeats here at all", "w" * 5000 + " x y z x y z"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").withColumn("n", F.lit(0).cast("long"))
    got = udfs.collapse_repeats(frame, "text", "n").orderBy("k").collect()
    for row, text in zip(got, texts):
        if text is not None:
            assert (row["text"], row["n"]) == udfs.without_repeats(text)


def test_text_rules(spark):
    assert one(spark, ["Judgment\x00\x08Text\x0bwith\x1fcontrols\x7f.", None], textops.clean_text) == ["Judgment Text with controls .", ""]
    assert one(spark, ["A" * 100 + "\x00" * 10, "A" * 100, "", None, "A" * 99 + "\x01"], textops.is_corrupted) == [True, False, True, True, False]
    a, b, c, d = one(spark, ["The Court, held.", "the  court held", "x" * 3000 + "a", "x" * 3000 + "b"], textops.fingerprint)
    assert a == b and c == d
    e, f, g = one(spark, ["x" * 3000 + "a", "x" * 3000 + "b", ""], lambda t: textops.fingerprint(t, "exact"))
    assert e != f and g == hashlib.sha1(b"").hexdigest()
    assert one(spark, ["Élan 12_a, ß!"], textops.tokenize) == [["élan", "12_a", "ß"]]
    assert one(spark, ["a b c d " * 3 + "e", "a b c d", None], textops.has_repeated_4gram) == [True, False, False]
    assert one(spark, ["Def xyZ!"], textops.caesar_decode) == ["Abc uvW!"]
    flags = one(spark, ["The court held that the appeal is allowed.", "t h e c o u r t h e l d " * 5, "bcdfg hjklm npqrs " * 9, "§§ ### $$$ ***", "�" * 9, "न्यायालय का निर्णय"],
                lambda t: textops.ocr_flags(textops.ocr_metrics(t))["suspect"])
    assert flags == [False, True, True, True, True, True]


def test_citations_and_refusals(spark):
    texts = ["see [Chunk ID: a1] and [chunk id: b2 | Court: X | Date: Y] and [Chunk ID: a1]", "none [Chunk: a]", None,
             "It does not contain sufficient information.", "It does not contain sufficient information [Chunk ID: z]"]
    assert one(spark, texts, answers.extract_citations) == [["a1", "b2"], [], [], [], ["z"]]
    assert one(spark, texts, answers.is_refusal) == [False, False, False, True, False]
    assert one(spark, ["Qwen/Qwen3.8-27B", "", None], answers.model_family) == ["qwen", "", ""]


def test_judge_replies(spark):
    good = {"answer_relevance": 4, "faithfulness": "3", "citation_correctness": 2.0, "overall_score": 1, "unsupported_claim_rate": 0.25, "hallucination": "False", "rationale": "r" * 600}
    cases = [(json.dumps(good), None), ("<think>{}</think>```json\n" + json.dumps(good) + "\n```", None), ("no", "no object"), ("{bad}", "not JSON"),
             (json.dumps(good | {"faithfulness": True}), "out of range: faithfulness"), (json.dumps(good | {"overall_score": 5}), "out of range: overall_score"),
             (json.dumps(good | {"unsupported_claim_rate": "0.1"}), "out of range: unsupported_claim_rate"), ("{}", "lacking: "), (None, "no object"), (json.dumps(good | {"hallucination": 1}), "out of range: hallucination"), (json.dumps(good | {"faithfulness": 2.5}), "out of range: faithfulness")]
    frame = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, reply string")
    for row, (_, error) in zip(udfs.parse_judge_reply(frame, "reply").orderBy("k").collect(), cases):
        v = row["verdict"]
        assert (v["status"] == "ok") == (error is None) and (error is None or v["error"].startswith(error))
        if error is None:
            assert (v["faithfulness"], v["hallucination"], len(v["rationale"])) == (3, False, 500)


def test_chunks(spark):
    text = ("word " * 300).strip() + "\n\n" + ("other " * 300).strip()
    frame = spark.createDataFrame([("A", text), ("B", "short text of 26 characters"), ("C", None)], "cnr string, text string")
    got = chunks.chunk_documents(frame).orderBy("chunk_index").collect()
    assert got[0]["chunk_id"] == "A_chunk_0" and {r["cnr"] for r in got} == {"A"} and len(got) >= 3
    assert all(100 <= len(r["text"]) <= 1200 and r["text"] in text for r in got)
    assert udfs.split_chunks("x" * 3000)[0] == "x" * 1200


def test_fusion_and_bm25(spark):
    lists = spark.createDataFrame([(1, "x", 0, k + 1, c) for k, c in enumerate("ABC")] + [(1, "y", 1, k + 1, c) for k, c in enumerate("BDA")],
                                  "question_id int, system string, list int, rank int, chunk_id string")
    got = retrieval.rrf_fuse(lists).orderBy("rank").collect()
    assert got[0]["chunk_id"] == "B" and abs(got[0]["score"] - (1 / 62 + 1 / 61)) < 1e-12
    docs = spark.createDataFrame([("chunk_ni_act", "cheque bounce under section 138 of the act"), ("b", "bail under section 437"), ("c", "land dispute")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "cheque bounce under section 138"), (2, "!!!")], "question_id int, query string")
    got = retrieval.bm25_search(asked, docs, k=2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got][0] == "chunk_ni_act" and len(got) == 2 and {r["question_id"] for r in got} == {1}


def test_statistics(spark):
    got = spark.createDataFrame([(8, 10), (0, 10), (10, 10), (0, 0)], "k int, n int").select(wilson("k", "n").alias("w")).collect()
    assert round(got[0]["w"]["low"], 4) == 0.4902 and round(got[0]["w"]["high"], 4) == 0.9433
    assert got[1]["w"]["low"] == 0.0 and got[2]["w"]["high"] == 1.0 and got[3]["w"] is None
    assert udfs.mcnemar_p(0, 0) == 1.0 and abs(udfs.mcnemar_p(1, 9) - 0.021484375) < 1e-12 and udfs.mcnemar_p(900, 1300) < 1e-15
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p double").withColumn("f", F.lit(1))
    assert [round(r["holm_p"], 6) for r in stats.holm_adjust(p, "p", ["f"], ["t"]).orderBy("t").collect()] == [0.03, 0.06, 0.06]
    pairs = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "a int, b int").withColumn("g", F.lit("x"))
    assert round(stats.cohens_kappa(pairs, ["g"], "a", "b").first()["kappa"], 6) == 0.4
    assert stats.cohens_kappa(pairs.where("a = 1 AND b = 1"), ["g"], "a", "b").first()["kappa"] is None


def test_bootstrap_repeats_for_any_partitioning(spark):
    rows = spark.range(400).selectExpr("'m' AS metric", "concat('c', id % 37) AS cl", "CAST(id % 3 = 0 AS DOUBLE) AS value")
    a = stats.cluster_bootstrap(rows.repartition(1), ["metric"], "cl", 500).first()
    b = stats.cluster_bootstrap(rows.repartition(7), ["metric"], "cl", 500).first()
    assert a == b and a["low"] < a["estimate"] < a["high"]
    same = stats.cluster_bootstrap(rows.withColumn("value", F.lit(1.0)), ["metric"], "cl", 200).first()
    assert same["low"] == same["high"] == 1.0
    assert np.isclose(a["estimate"], 134 / 400)


def _records(spark, rows):
    base = {"court_code": "27_1", "bench": "newas", "year": 2015, "title": "WP/1519/2000", "judge": "A B Sharma", "petitioner": "Ram", "respondent": "State",
            "decision_date": "2015-06-01", "disposal_nature_normalized": "allowed", "case_type": "", "source_config": "high_courts"}
    schema = "d long, cnr string, full_text string, court_code string, bench string, year int, title string, judge string, petitioner string, respondent string, decision_date string, disposal_nature_normalized string, case_type string, source_config string"
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], schema)


def test_build_fixture(spark):
    text = " ".join(f"word{k}" for k in range(120))
    rows = [
        {"d": 1, "cnr": "HCBM01_1_2015-06-01", "full_text": text},
        {"d": 2, "cnr": "HCBM01_2_2015-06-02", "full_text": text.upper()},
        {"d": 3, "cnr": "HCBM01_3_2015-06-01", "full_text": "Short order."},
        {"d": 4, "cnr": "HCBM01_4_2015-06-01", "full_text": "   "},
        {"d": 5, "cnr": "HCBM01_5_2016-07-01", "full_text": "other " + text},
        {"d": 6, "cnr": "HCBM01_6_2015-06-01", "full_text": text, "court_code": "10_8"},
    ]
    build = corpus.Build(today=TODAY, min_chars=200)
    labelled = corpus.label_records(_records(spark, rows), build)
    assert [r[0] for r in labelled.orderBy("d").select("outcome_label").collect()] == [
        "kept_search", "near_duplicate", "kept_lookup_only", "empty_text", "kept_search", "court_not_selected",
    ]
    kept, links = corpus.build_corpus(_records(spark, rows), build)
    assert [tuple(r)[:2] for r in links.collect()] == [("HCBM01_2_2015-06-02", "HCBM01_1_2015-06-01")]
    assert kept.columns == corpus.OUTPUT and kept.where("date_conflict").first()["cnr"] == "HCBM01_5_2016-07-01"
    assert all(r["scanned"] == r["dropped"] + r["kept"] for r in corpus.identity_check(labelled).collect())


def test_drop_reasons(spark):
    text = " ".join(f"word{k}" for k in range(120))
    rows = [{"d": 1, "cnr": "A_1_2015-06-01", "full_text": text, "court_code": None}, {"d": 2, "cnr": " ", "full_text": text},
            {"d": 3, "cnr": "B_1_2015-06-01", "full_text": ""}, {"d": 4, "cnr": "B_1_2015-06-01", "full_text": text},
            {"d": 5, "cnr": "C_1_2015-06-01", "full_text": None}, {"d": 6, "cnr": "D_1_2015-06-01", "full_text": "\x01" * 50 + "a" * 100}]
    got = corpus.label_records(_records(spark, rows), corpus.Build(today=TODAY, min_chars=200)).orderBy("d")
    assert [r["outcome_label"] for r in got.collect()] == ["court_not_selected", "missing_cnr", "empty_text", "duplicate_cnr", "empty_text", "corrupted_text"]


def test_large_groups_are_drawn_where_their_clusters_are(spark):
    rows = spark.range(6000).selectExpr("IF(id % 2 = 0, 'm', NULL) AS metric", "concat('c', id % 1500) AS cl", "CAST(pmod(hash(id), 10) < 3 AS DOUBLE) AS value")
    small = {r["metric"]: r for r in stats.cluster_bootstrap(rows, ["metric"], "cl", 4000).collect()}
    large = {r["metric"]: r for r in stats.cluster_bootstrap(rows.repartition(5), ["metric"], "cl", 4000, one_task=100).collect()}
    again = {r["metric"]: r for r in stats.cluster_bootstrap(rows.repartition(2), ["metric"], "cl", 4000, one_task=100).collect()}
    assert set(small) == set(large) == {"m", None}
    for key, r in small.items():
        width = r["high"] - r["low"]
        assert large[key]["n"] == r["n"] and np.isclose(large[key]["estimate"], r["estimate"])
        assert all(abs(large[key][x] - r[x]) < 0.06 * width and np.isclose(large[key][x], again[key][x]) for x in ("low", "high"))
    gaps = rows.withColumn("value", F.expr("value - 0.31"))
    a = {r["metric"]: r for r in stats.paired_bootstrap(gaps, ["metric"], "cl", 4000).collect()}
    b = {r["metric"]: r for r in stats.paired_bootstrap(gaps, ["metric"], "cl", 4000, one_task=100).collect()}
    assert all(abs(a[k]["p_value"] - b[k]["p_value"]) < 0.08 and a[k]["verdict"] == b[k]["verdict"] for k in a)
    times = stats.poisson_times(np.arange(300) * 77, np.arange(300))
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.03 and abs(np.mean(times == 0) - np.exp(-1)) < 0.01
