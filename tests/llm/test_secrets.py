"""Secret scans against Python's regular expressions, and the automata against them too."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm.automata import compiled, parse
from foliospark.llm.secret_scan import BASE, RULES, Rule, Scanner, op13_secret_scan, redacted, row_spans, scan_secrets

# the contract's patterns, and the least length of the group (0: of the match)
PLAIN = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def brute(text):
    found = []
    for k, (pattern, group, least) in enumerate(PLAIN.values()):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


@pytest.fixture(scope="module")
def scanner():
    return Scanner.of(RULES)


def spans(scanner, texts, **more):
    data = [x.encode() for x in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    return row_spans(scanner, np.frombuffer(b"".join(data), np.uint8), offsets, **more)


def made_texts(n, seed=5):
    rng = random.Random(seed)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "APIkey", "AKIA", "AKIAAKIA", ":", "=", ": ", " = ", "'", '"', "é", "ſ", "\n", " ", ",", "ab12", "0123456789abcdef", "deadbeef", "ABCDEFGH12", "x", "/+_", "==", "token=", "ghp_", "漢"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most", [1 << 20, 64])
def test_base_kinds_equal_plain_patterns(scanner, most):
    texts = made_texts(3000) + ["token=token:abcdefgh", "password" + " " * 5000 + "= abcdef", "a1" * 3000, "token=abcdef " * 400]
    got = spans(scanner, texts, most=most)
    for text, row in zip(texts, got, strict=True):
        assert [x for x in row if x[1] < len(BASE)] == brute(text), text


def test_further_kinds_and_order(scanner):
    text = "see ghp_" + "a" * 36 + " and -----BEGIN RSA PRIVATE KEY----- at https://me:pw1234@host AKIA" + "B" * 16
    row = spans(scanner, [text])[0]
    assert [(RULES[k].kind, text[a:b]) for a, k, b in row] == [
        ("github", "ghp_" + "a" * 36), ("hex", "a" * 36), ("pem", "-----BEGIN RSA PRIVATE KEY-----"), ("login", "://me:pw1234@"), ("access", "AKIA" + "B" * 16),
    ]


@pytest.mark.parametrize("pattern", ["a|ab|abc", "(ab?c){2,3}", "[^a-c\\n]+x", "a{2}b*", "(a|b)*abb", "a?b?c?d", ".b{0,2}\\.", "a{2,}"])
def test_automata_against_re(pattern):
    tree, plain = parse(pattern), re.compile(pattern.encode())
    one, back = compiled([tree], anchored=True), compiled([tree], anchored=False, backwards=True)
    rng = random.Random(1)
    for _ in range(400):
        data = bytes(rng.choice(b"abcdx.\n") for _ in range(rng.randint(0, 14)))
        ends = [max((e for e in range(s, len(data) + 1) if plain.fullmatch(data, s, e)), default=-1) for s in range(len(data))]
        assert [one.longest(data, s) for s in range(len(data))] == ends
        assert back.starts(data) == [s for s, e in enumerate(ends) if e > s or (e == s and back.ends[0])]


def test_minimal_has_no_equal_states():
    made = compiled([parse("(a|b)*abb"), parse("abb")], anchored=True)
    assert len(made.ends) == 9  # of the product of both, by hand
    with pytest.raises(ValueError):
        parse("a)")
    with pytest.raises(ValueError):
        parse("*a")


def test_lanes_run_like_one_row(scanner):
    texts = made_texts(300, 9)
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    whole = scanner.search.states(data, np.zeros(1, np.int64), lane=1 << 30)
    assert (scanner.search.states(data, np.zeros(1, np.int64), lane=32) == whole).all()


def test_query_on_given_documents(spark):
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    rows = op13_secret_scan(spark, path).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows) > 0
    names = list(PLAIN)
    for r in rows:
        expected = brute(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in expected) for j in range(3)]
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in expected)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_odd_rows_empty_table_and_redaction(spark, odd, none):
    odd = odd.withColumn("Secrets", F.lit(1))
    got = scan_secrets(odd)
    assert got.count() == odd.count() and got.columns[-1] == "secrets" and "Secrets" not in got.columns
    assert scan_secrets(none).count() == 0
    text = "é token: abc123x, key=1 " + "0a" * 20 + "!"
    frame = spark.createDataFrame([(text,), (None,), ("",), ("x" * 3_000_000 + " token=abcdef",)], "text string")
    rows = scan_secrets(frame).withColumn("clear", redacted(F.col("text"), F.col("secrets"))).collect()
    assert rows[0].clear == "é <assign>, key=1 <hex>!"
    assert rows[1].secrets == [] and rows[1].clear is None and rows[2].clear == ""
    assert [(x.start, x.end) for x in rows[3].secrets] == [(3_000_001, 3_000_013)]


def test_own_rules(spark):
    frame = spark.createDataFrame([("id-123 id-9",)], "text string")
    assert [tuple(x) for x in scan_secrets(frame, rules=(Rule("id", "id-", "[0-9]", 2),)).first().secrets] == [("id", 0, 6)]
