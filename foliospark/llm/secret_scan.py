"""Secret scans: the patterns of all rules in one minimised deterministic automaton, one pass over the bytes.

A rule is a pattern and the bytes that may follow it. All patterns are compiled together by subset construction and
minimisation into transition arrays (``automata``), which go over each byte once and tell where a pattern of any rule
ends. Only stretches with such a place, between two visits of the start state, are looked at again: the rule's pattern
run backwards marks where its matches start, and from the leftmost of them the longest match is taken, with all bytes
that may follow, then the next one behind it. All of that is linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automata import Automaton, compiled, parse
from .common import add_columns, blocks, slices, small_batches, table, text_bytes


@dataclass(frozen=True)
class Rule:
    """A match is ``head``, as long as it can be, and all bytes of the class ``tail`` behind it.

    With a ``least`` there must be such bytes; a match with fewer than ``least`` of them takes its place, but is dropped.
    """

    kind: str
    head: str
    tail: str = ""
    least: int = 0
    ignore_case: bool = False  #: in the head


# The three base kinds, as the contract gives them, in its order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 6, True),
    Rule("access", r"AKIA", r"[A-Z0-9]", 16),
    Rule("hex", r"[0-9a-f]{24}", r"[0-9a-f]"),
)
#: Further kinds: tokens with a known prefix, signed tokens, key blocks, passwords in addresses.
RULES = BASE + (
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]", 36),
    Rule("slack", r"xox[abopsr]-", r"[A-Za-z0-9-]", 10),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]", 35),
    Rule("stripe", r"[rs]k_live_", r"[A-Za-z0-9]", 16),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]", 8),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"://[A-Za-z0-9._%-]+:[A-Za-z0-9._%+!$&*-]+@"),
)


@dataclass(frozen=True)
class Scanner:
    """Compiled rules. ``found`` reads many rows at once, or one stretch of a row."""

    rules: tuple[Rule, ...]
    search: Automaton
    backwards: tuple[Automaton, ...]
    heads: tuple[Automaton, ...]
    tails: np.ndarray  #: rule x byte: whether it may follow
    breaks: np.ndarray  #: bytes that no match goes across

    @staticmethod
    def of(rules: tuple[Rule, ...]) -> Scanner:
        heads = [parse(r.head, r.ignore_case) for r in rules]
        search = compiled(heads, anchored=False)
        tails = np.array([[r.tail != "" and bool(parse(r.tail)[1][0][1] >> c & 1) for c in range(256)] for r in rules])
        return Scanner(
            rules,
            search,
            tuple(compiled([x], anchored=False, backwards=True) for x in heads),
            tuple(compiled([x], anchored=True) for x in heads),
            tails,
            search.resets() & ~tails.any(0),
        )

    def tail_end(self, k: int, body: np.ndarray, at: int) -> int:
        """End of the bytes from ``at`` on that may follow a match of rule k."""
        step = 64
        while at < len(body):
            other = np.flatnonzero(~self.tails[k][body[at : at + step]])
            if len(other):
                return at + int(other[0])
            at, step = at + step, min(2 * step, 1 << 20)
        return len(body)

    def found(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Row, start, rule and end (bytes of the row, end exclusive) of all matches in these rows, in that order."""
        base = int(offsets[0])
        body, starts = data[base : offsets[-1]], offsets[:-1] - base
        states = self.search.states(body, starts)
        ends = self.search.ends[states]
        hits = np.flatnonzero(ends)
        if not len(hits):
            return []
        # a head lies inside one row, between two visits of the start state
        rests = np.unique(np.concatenate([np.flatnonzero(states == 0) + 1, starts]))
        out, over = [], {}
        for p in np.unique(np.searchsorted(rests, hits, "right") - 1).tolist():
            first = int(rests[p])
            last = int(rests[p + 1]) if p + 1 < len(rests) else len(body)
            row = int(np.searchsorted(starts, first, "right")) - 1
            own, row_end = int(starts[row]), int(offsets[row + 1]) - base
            kinds = int(np.bitwise_or.reduce(ends[first:last]))
            piece = body[first:last].tobytes()
            for k, rule in enumerate(self.rules):
                if not kinds >> k & 1:
                    continue
                for start in self.backwards[k].starts(piece):
                    if first + start < over.get((row, k), 0):
                        continue
                    middle = first + self.heads[k].longest(piece, start)
                    end = self.tail_end(k, body[:row_end], middle) if rule.tail else middle
                    if rule.least and end == middle:
                        continue
                    over[row, k] = end
                    if end - middle >= rule.least:
                        out.append((row, first + start - own, k, end - own))
        return sorted(out)


def row_stretches(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row, and the offsets of pieces from it on: many short rows, or one stretch of a row of over ``most`` bytes.

    A long row is cut behind a byte of ``breaks``, which no match goes across; without such a byte a stretch goes on.
    """
    for first, last in blocks(offsets, most, 1 << 20):
        at, end = int(offsets[first]), int(offsets[last])
        while last == first + 1 and end - at > most:
            cut = at + most
            while cut < end and not len(gap := np.flatnonzero(breaks[data[cut : min(end, cut + most)]])):
                cut += most
            cut = cut + int(gap[0]) + 1 if cut < end else end
            yield first, np.array([at, cut])
            at = cut
        yield first, np.concatenate([[at], offsets[first + 1 : last + 1]])


def row_spans(scanner: Scanner, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> list[list[tuple[int, int, int]]]:
    """For each row: start, rule and end of its matches, in code points."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    row_before, points = -1, 0  # code points of the stretches of a row in front of this one
    for first, ends in row_stretches(data, offsets, scanner.breaks, most):
        points = points if first == row_before else 0
        found = scanner.found(data, ends)
        goes_on = len(ends) == 2
        if found or goes_on:
            total = np.concatenate([[0], np.cumsum((data[ends[0] : ends[-1]] & 0xC0) != 0x80)])
            for row, start, k, end in found:
                at = int(ends[row] - ends[0])
                before = points - int(total[at])
                out[first + row].append((before + int(total[at + start]), k, before + int(total[at + end])))
            points += int(total[-1])
        row_before = first if goes_on else -1
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = [T.StructField("secrets", T.ArrayType(SPAN, False))]


def scan_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of the table and ``secrets``: kind, start and end (code points, end exclusive) of each match; no shuffle.

    Matches of one kind are the leftmost ones that do not overlap; those of different kinds may. They come by start,
    then by the order of the rules. Null and empty texts have none, repeated rows come out alike, an empty table stays
    empty. Texts are read whole, in stretches of about 1 MB that end behind a byte that no match goes across (a longer run without one is one stretch). An existing
    column ``secrets`` is replaced. The compiled rules go to the executors once; their size depends on the rules alone.
    """
    small_batches(df.sparkSession)
    kept, schema = add_columns(df, FIELDS)
    text, names = kept.columns.index(text_col), schema.fieldNames()
    shared = df.sparkSession.sparkContext.broadcast(Scanner.of(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.field("element", pa.struct([pa.field("kind", pa.string()), pa.field("start", pa.int64()), pa.field("end", pa.int64())]), False))
        for batch in slices(batches, text):
            found = row_spans(shared.value, *text_bytes(batch.column(text)))
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in row] for row in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names)

    return kept.mapInArrow(run, schema)


def redacted(text: Column, secrets: Column) -> Column:
    """The text with each stretch that secrets cover replaced by the kind of its first one in angle brackets."""
    length = F.char_length(text)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        clear = x["start"] >= acc["at"]
        more = F.concat(acc["done"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(F.when(clear, more).otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], x["end"]).alias("at"))

    return F.aggregate(secrets, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, length)))


def _of(secrets: str, kinds: list[str]) -> Column:
    return F.filter(secrets, lambda x: x["kind"].isin(kinds))


def _joined(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op13_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in BASE]
    counts = [F.size(_of("secrets", [k])).cast("long").alias(f"n_{k}") for k in kinds]
    base = _of("secrets", kinds)
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
