"""Deterministic automata over bytes: a small pattern language, subset construction, minimisation, lockstep runs.

Patterns hold literals, ``\\xHH``, ``\\n \\r \\t`` and escapes of single signs, ``.`` (any byte but a line end), classes with ranges and
``^``, groups, ``|``, and the repeats ``? * + {m} {m,} {m,n}``. A pattern becomes a tree, the tree a nondeterministic
automaton (backwards too), any number of those one deterministic automaton whose states carry a bit for each pattern
that ends there. Bytes that all states treat alike share a class, so the transition array has a column per class.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_TOKEN = re.compile(r"\\x[0-9a-fA-F]{2}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{\d+(?:,\d*)?\}|.", re.S)
_ITEM = re.compile(r"\\x[0-9a-fA-F]{2}|\\.|.", re.S)


_NAMED = {"\\n": 10, "\\r": 13, "\\t": 9}


def _sign(token: str) -> int:
    if token.startswith("\\x") and len(token) == 4:
        return int(token[2:], 16)
    if token in _NAMED:
        return _NAMED[token]
    code = ord(token[-1])
    if code > 127:
        raise ValueError(f"write {token!r} as bytes")
    return code


def _class(token: str) -> int:
    """Bytes of a bracketed class, as a number with a bit for each of them."""
    inside, mask = token[1:-1], 0
    negated = inside.startswith("^")
    items = _ITEM.findall(inside[negated:])
    k = 0
    while k < len(items):
        low = high = _sign(items[k])
        if k + 2 < len(items) and items[k + 1] == "-":
            high, k = _sign(items[k + 2]), k + 2
        for c in range(low, high + 1):
            mask |= 1 << c
        k += 1
    return ((1 << 256) - 1) ^ mask if negated else mask


def parse(pattern: str, ignore_case: bool = False) -> tuple:
    """Tree of a pattern: ("set", bytes), ("cat", trees), ("alt", trees) or ("rep", tree, least, most)."""
    tokens, at = _TOKEN.findall(pattern), 0

    def either(mask: int) -> tuple:
        if ignore_case:
            for c in range(97, 123):
                if mask >> c & 1 or mask >> (c - 32) & 1:
                    mask |= 1 << c | 1 << (c - 32)
        return ("set", mask)

    def branch() -> tuple:
        nonlocal at
        parts: list[tuple] = []
        while at < len(tokens) and tokens[at] not in "|)":
            token = tokens[at]
            at += 1
            if token in ("?", "*", "+") or (token[0] == "{" and len(token) > 1):
                if not parts:
                    raise ValueError(f"nothing to repeat in {pattern!r}")
                if token[0] == "{":
                    low, comma, high = token[1:-1].partition(",")
                    bounds = (int(low), int(high or 0) if high else None if comma else int(low))
                else:
                    bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[token]
                parts.append(("rep", parts.pop(), *bounds))
            elif token == "(":
                parts.append(choice())
                if at >= len(tokens) or tokens[at] != ")":
                    raise ValueError(f"unclosed group in {pattern!r}")
                at += 1
            elif token[0] == "[" and len(token) > 1:
                parts.append(either(_class(token)))
            elif token == ".":
                parts.append(("set", ((1 << 256) - 1) ^ (1 << 10)))
            else:
                parts.append(either(1 << _sign(token)))
        return ("cat", parts)

    def choice() -> tuple:
        nonlocal at
        branches = [branch()]
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            branches.append(branch())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    tree = choice()
    if at < len(tokens):
        raise ValueError(f"unopened group in {pattern!r}")
    return tree


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.move: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.move.append(None)
        return len(self.empty) - 1

    def add(self, tree: tuple, start: int, backwards: bool) -> int:
        """Attach the tree behind ``start``; the state behind it."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.move[start] = (tree[1], end)
            after = self.state()  # so that no state has both a move and a further use
            self.empty[end].append(after)
            return after
        if kind == "cat":
            for part in reversed(tree[1]) if backwards else tree[1]:
                start = self.add(part, start, backwards)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.empty[start].append(own := self.state())
                self.empty[self.add(part, own, backwards)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start, backwards)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[loop] += [own := self.state(), end]
            self.empty[self.add(part, own, backwards)].append(loop)
            return end
        end = self.state()
        for _ in range(most - least):
            self.empty[start] += [own := self.state(), end]
            start = self.add(part, own, backwards)
        self.empty[start].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """State 0 is the start. ``table[state, class]`` is the next state; ``ends`` has a bit per pattern that ends there."""

    table: np.ndarray
    classes: np.ndarray
    ends: np.ndarray
    live: np.ndarray  #: patterns that can still end from a state on; none: it is dead

    def resets(self) -> np.ndarray:
        """For each byte, whether every state goes to the start on it."""
        return (self.table == 0).all(0)[self.classes]

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that starts at ``at``, or -1."""
        table, classes, ends, live = self._lists()
        state, found = 0, at if ends[0] else -1
        for k in range(at, len(data)):
            state = table[state][classes[data[k]]]
            if not live[state]:
                break
            if ends[state]:
                found = k + 1
        return found

    def _lists(self) -> tuple:
        if "kept" not in self.__dict__:
            self.__dict__["kept"] = (self.table.tolist(), self.classes.tolist(), self.ends.tolist(), self.live.tolist())
        return self.__dict__["kept"]

    def starts(self, data: bytes) -> list[int]:
        """For an automaton of a pattern read backwards: where in ``data`` a match starts, ascending. One pass."""
        table, classes, ends, _ = self._lists()
        state, found = 0, []
        for k in range(len(data) - 1, -1, -1):
            state = table[state][classes[data[k]]]
            if ends[state]:
                found.append(k)
        return found[::-1]

    def states(self, data: np.ndarray, starts: np.ndarray, lane: int = 512) -> np.ndarray:
        """State after each byte, every row (they start at ``starts``) from the start on; one pass over the bytes.

        Rows are cut behind bytes on which every state goes to the start, and the pieces run side by side, a byte
        of each at a time; what is left of a few long ones runs alone.
        """
        n = len(data)
        out = np.zeros(n, np.int32)
        if not n:
            return out
        resets = np.flatnonzero(self.resets()[data])
        at = np.searchsorted(resets, np.arange(lane, n, lane))
        cuts = np.unique(np.concatenate([[0], starts[starts < n], resets[at[at < len(resets)]] + 1]))
        cuts = cuts[cuts < n]
        lengths = np.diff(np.append(cuts, n))
        order = np.argsort(-lengths, kind="stable")
        first, lengths = cuts[order], lengths[order]
        width = self.table.shape[1]
        flat = (self.table * width).astype(np.int32).ravel()
        kinds = self.classes[data]
        side_by_side = int(lengths[min(15, len(lengths) - 1)]) if len(lengths) > 15 else 0
        active = np.searchsorted(-lengths, -np.arange(side_by_side), "left")
        state = np.zeros(len(first), np.int32)
        for t in range(side_by_side):
            k = int(active[t])
            place = first[:k] + t
            state[:k] = now = flat[state[:k] + kinds[place]]
            out[place] = now
        table, _, _, _ = self._lists()
        for k in np.flatnonzero(lengths > side_by_side).tolist():
            now, here = int(state[k]) // width, int(first[k]) + side_by_side
            end = int(first[k] + lengths[k])
            alone = []
            for c in kinds[here:end].tolist():
                now = table[now][c]
                alone.append(now)
            out[here:end] = np.array(alone, np.int32) * width
        out //= width
        return out


def compiled(trees: list[tuple], anchored: bool, backwards: bool = False) -> Automaton:
    """One automaton for all patterns (bit k: pattern k): subset construction, then minimisation."""
    nfa = _Nfa()
    firsts, lasts = [], {}
    for k, tree in enumerate(trees):
        first = nfa.state()
        firsts.append(first)
        lasts[nfa.add(tree, first, backwards)] = k
    masks = sorted({m[0] for m in nfa.move if m})
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(m >> c & 1 for m in masks), len(kinds)) for c in range(256)], np.uint8)
    sample = [int(np.flatnonzero(classes == k)[0]) for k in range(len(kinds))]

    def closed(states: list[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.move[x] or x in lasts)

    start = closed(firsts)
    numbers, todo, rows = {start: 0}, [start], []
    after: dict[tuple[int, int], frozenset] = {}
    for state in todo:
        row = []
        for k, c in enumerate(sample):
            found: set[int] = set()
            for x in state:
                if (move := nfa.move[x]) and move[0] >> c & 1:
                    if (move[1], 0) not in after:
                        after[move[1], 0] = closed([move[1]])
                    found |= after[move[1], 0]
            following = frozenset(found) if anchored else frozenset(found) | start
            if following not in numbers:
                numbers[following] = len(numbers)
                todo.append(following)
            row.append(numbers[following])
        rows.append(row)
    ends = np.array([sum(1 << lasts[x] for x in state if x in lasts) for state in todo], np.int64)
    return minimal(np.array(rows, np.int64), classes, ends)


def minimal(table: np.ndarray, classes: np.ndarray, ends: np.ndarray) -> Automaton:
    """Merge states that no text tells apart (Moore): blocks are split by where their states go until none splits."""
    block = np.unique(ends, return_inverse=True)[1].ravel()
    while True:
        told = np.column_stack([block, block[table]])
        finer = np.unique(told, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    rank = np.argsort(np.argsort(first, kind="stable"), kind="stable")  # the start keeps the number 0
    block, chosen = rank[block], np.sort(first)
    table, ends = block[table[chosen]], ends[chosen]
    live = ends.copy()
    while True:
        more = live | np.bitwise_or.reduce(live[table], axis=1)
        if (more == live).all():
            return Automaton(table.astype(np.int32), classes, ends, live)
        live = more
