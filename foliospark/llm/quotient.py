"""Counting quotient filters that lose nothing: a key is permuted and split into a quotient and its whole remainder.

A filter holds 64-bit keys of a known width with their counts. An invertible permutation spreads the keys over the range;
the upper bits of a permuted key are its quotient, of which only one bit is kept per possible value, the rest is its
remainder. Entries stand in ascending order, those of a quotient as a run whose last one is marked. As the remainder is
whole, two keys never share an entry and every key can be read back. Filters are built from sorted batches, so no
entry is ever shifted; filters of several shards are merged as sorted lists.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_ROUNDS = 2


def _half(bits: int) -> np.uint64:
    return np.uint64(-(-bits // 2))


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permuted(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys of ``bits`` bits, each sent to another one: odd products modulo 2^bits and shifts over half the width."""
    x = keys.astype(np.uint64)
    for _ in range(_ROUNDS):
        x = (x * np.uint64(_ODD)) & _mask(bits)
        x ^= x >> _half(bits)
    return x


def restored(values: np.ndarray, bits: int) -> np.ndarray:
    """The keys that ``permuted`` sent to these values."""
    inverse = np.uint64(pow(_ODD, -1, 1 << 64))
    x = values.astype(np.uint64)
    for _ in range(_ROUNDS):
        x = x ^ (x >> _half(bits))
        x = (x * inverse) & _mask(bits)
    return x


@dataclass(frozen=True)
class QuotientFilter:
    """Permuted keys, ascending and different, that all start with the same bits, and their counts (0 is a count too)."""

    values: np.ndarray
    counts: np.ndarray
    bits: int  #: of a key
    prefix: int = 0  #: upper bits that all values of this filter share

    @staticmethod
    def of(keys: np.ndarray, counted: np.ndarray, bits: int) -> QuotientFilter:
        """Count keys that repeat; only those that are ``counted`` add one."""
        values, at = np.unique(permuted(keys, bits), return_inverse=True)
        return QuotientFilter(values, np.bincount(at.ravel()[counted], minlength=len(values)).astype(np.int64), bits)

    @staticmethod
    def merged(filters: list[QuotientFilter]) -> QuotientFilter:
        values, at = np.unique(np.concatenate([f.values for f in filters]), return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, at.ravel(), np.concatenate([f.counts for f in filters]))
        return QuotientFilter(values, counts, filters[0].bits, filters[0].prefix)

    def parts(self, prefix: int) -> list[tuple[int, QuotientFilter]]:
        """The filter by the first ``prefix`` bits of its values; parts without an entry are left out."""
        first = (self.values >> np.uint64(self.bits - prefix)).astype(np.int64) if prefix else np.zeros(len(self.values), np.int64)
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        ends = np.append(starts[1:], len(first))[: len(starts)]
        return [
            (int(first[a]), QuotientFilter(self.values[a:b], self.counts[a:b], self.bits, prefix))
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True)
        ]

    def keys(self) -> np.ndarray:
        return restored(self.values, self.bits)

    def to_bytes(self) -> bytes:
        """Head; a bit for each quotient that occurs; a bit for each entry that ends a run; remainders in whole bytes;
        counts of a byte, 255 standing for one of eight bytes at the end."""
        n, left = len(self.values), self.bits - self.prefix
        quotient = min(left, max(n - 1, 0).bit_length())
        width = left - quotient
        rest = self.values & _mask(left)
        of = (rest >> np.uint64(width)).astype(np.int64)
        occupied = np.zeros(1 << quotient, bool)
        occupied[of] = True
        ends = np.append(of[1:] != of[:-1], [True] * bool(n))
        size = -(-width // 8)
        remainders = (rest & _mask(width)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :size]
        small = np.minimum(self.counts, 255).astype(np.uint8)
        large = self.counts[self.counts >= 255].astype("<i8")
        shared = int(self.values[0] >> np.uint64(left)) if n and self.prefix else 0
        head = struct.pack("<BBBIQ", self.bits, self.prefix, quotient, n, shared)
        return b"".join([head, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainders.tobytes(), small.tobytes(), large.tobytes()])

    @staticmethod
    def from_bytes(data: bytes) -> QuotientFilter:
        bits, prefix, quotient, n, shared = struct.unpack_from("<BBBIQ", data)
        at = struct.calcsize("<BBBIQ")
        left = bits - prefix
        width = left - quotient

        def take(count: int, kind: str = "u1") -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << quotient) // 8)), count=1 << quotient))
        ends = np.unpackbits(take(-(-n // 8)), count=n).astype(np.int64)
        size = -(-width // 8)
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :size] = take(n * size).reshape(n, size)
        of = occupied[np.cumsum(ends) - ends] if n else np.zeros(0, np.int64)
        values = (of.astype(np.uint64) << np.uint64(width)) | remainders.view("<u8").ravel()
        if prefix:
            values |= np.uint64(shared << left)
        counts = take(n).astype(np.int64)
        counts[counts == 255] = take(int((counts == 255).sum()), "<i8")
        return QuotientFilter(values, counts, bits, prefix)
