"""Licence scans: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

One automaton holds all notice phrases and the words of the identifier tag. It runs over each text's words,
lower-cased and joined by single spaces, so a phrase matches only where its words stand consecutively. Behind each place
where it finds the tag ``SPDX-License-Identifier:``, up to the end of the line or the next tag, an expression is parsed
into postfix form and evaluated: ``or`` lets the reader choose (the least restrictive side counts), ``and`` binds to both (the most
restrictive counts), ``with`` attaches an exception that eases the licence before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, slices, small_batches, table

# Base phrases and their labels, as the contract gives them.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases (words only) and their labels.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "released into the public domain": "public-domain",
    "isc license": "isc",
    "boost software license": "boost",
}
TAG = "spdx license identifier"
_SPAN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: What may stand between the tag and its expression, and the expression.
_LINE = re.compile(rb"[ \t]*:?[ \t]*([^\r\n]*)")
#: How much each label restricts reuse, 0 to 1; labels that are not listed count as UNKNOWN.
RESTRICTS = {
    "public-domain": 0.05, "cc0": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "boost": 0.1, "apache": 0.15,
    "cc-by": 0.3, "mpl": 0.5, "epl": 0.5, "cc-by-sa": 0.55, "lgpl": 0.6, "cc-by-nd": 0.7, "cc-by-nc": 0.7,
    "gpl": 0.8, "agpl": 0.9, "reserved": 1.0,
}
UNKNOWN = 0.5
_FAMILY = re.compile(r"^(agpl|lgpl|gpl|apache|bsd|mit|mpl|epl|isc|cc0|cc-by-nc|cc-by-sa|cc-by-nd|cc-by)(?![a-z0-9])")
# Identifiers without a digit or a hyphen, besides the families.
_PLAIN = set("beerware curl intel libpng naist ncsa openssl php postgresql python qhull ruby saxpath sleepycat unlicense vim w3c wtfpl xerox xnet zed zend zlib".split())
_RANK = {"or": 1, "and": 2, "with": 3}
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def family(identifier: str) -> str:
    """Label of an identifier: its family if that is known, else the identifier itself; empty for a plain word.

    Identifiers have a digit or a hyphen, but for some known ones, so words of a sentence behind a tag are none.
    """
    found = _FAMILY.match(identifier)
    return found[1] if found else identifier if identifier in _PLAIN or re.search(r"[0-9]|[a-z]-[a-z]", identifier) else ""


def to_postfix(expression: str) -> list[str]:
    """Tokens of a licence expression in postfix order (Dijkstra's shunting yard).

    Identifiers and operators in any case; ``with`` binds before ``and``, ``and`` before ``or``, all to the left.
    Reading stops at the first token that cannot follow (text behind the expression); what was read until then
    counts. Unclosed brackets are closed at the end, and an operator without a right side is left out.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for token in re.findall(r"[()]|[a-z0-9.+:-]+", expression.lower()):
        if token in _RANK:
            if not operand:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            if name := token.strip(".:-"):
                out.append(name)
                operand = True
    if not operand:
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    out += [x for x in reversed(stack) if x != "("]
    return out


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels named in the expression, and how much it restricts reuse."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in _RANK and len(stack) >= 2:
            (right, b), (left, a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, a * 0.75))
            else:
                stack.append((left | right, min(a, b) if token == "or" else max(a, b)))
        elif token not in _RANK:
            label = family(token)
            stack.append(({label} - {""}, RESTRICTS.get(label, UNKNOWN) if label else 0.0))
    labels = set().union(*(x for x, _ in stack)) if stack else set()
    return labels, max((x for _, x in stack), default=0.0)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


def expressions(text: bytes, tags: list[int]) -> Iterator[str]:
    """What stands behind each tag on its line, up to the next tag; ``tags`` are the numbers of their last words."""
    spans, at, places = _SPAN.finditer(text), -1, []
    for number in tags:
        first = last = None
        while at < number:
            last, at = next(spans), at + 1
            if at == number - TAG.count(" "):
                first = last
        places.append((first.start(), last.end()))
    stops = [start for start, _ in places[1:]] + [len(text)]
    for (_, end), stop in zip(places, stops):  # no tag: nothing
        yield _LINE.match(text[end:stop])[1].decode("utf-8", "replace")


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """What the query returns for one text: words, base places, first and last start, labels, score."""
    words = text.translate(_WORDS).split()
    plain = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogateescape")
    base, own, tags, starts = set(), set(), [], []
    word = seen = 0  # matches come by their ends, so the words in front of each are counted on from the last one
    for end, phrase in _automaton().iter(plain):
        if phrase == TAG or phrase in BASE:
            word, seen = word + plain.count(" ", seen, end + 1), end + 1
        if phrase == TAG:
            tags.append(word - 2)
        elif phrase in BASE:
            base.add(BASE[phrase])
            starts.append(word - 1 - len(phrase.split()))
        if phrase in NOTICES:
            own.add(NOTICES[phrase])
    score = max((RESTRICTS[x] for x in base | own), default=0.0)
    for expression in expressions(text, tags):
        labels, strength = evaluate(to_postfix(expression))
        own |= {x for x in labels if "," not in x}
        score = max(score, strength)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | own)), score,
    )


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
]


def scan_licenses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of the table and what the scan finds in each whole text; one row per row, no shuffle.

    Null counts as empty: no words, no places (null starts), empty label lists, score 0. ``score`` says how much
    the strictest notice restricts reuse. Each row stands for itself, so repeated rows come out alike and an empty
    table stays empty. A text is scanned whole, in time in proportion to its length and its matches. Existing
    columns named like a result are replaced.
    """
    small_batches(df.sparkSession)
    kept, schema = add_columns(df, FIELDS)
    text, names = kept.columns.index(text_col), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in slices(batches, text):
            column = batch.column(text).fill_null("").cast(pa.binary())
            found = [scan(x.as_py()) for x in column]
            new = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)

    return kept.mapInArrow(run, schema)


def op5_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
