"""Vectorised hashes of all words of many texts at once, and a fixed-size Bloom filter."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * K2
    h = (h ^ (h >> np.uint64(27))) * K3
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """An odd pseudo-random factor for each place in a word."""
    global _powers
    if len(_powers) < n:
        _powers = mix(np.arange(1, max(n, 64) + 1, dtype=np.uint64) * K1) | np.uint64(1)
    return _powers


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] of them, then those of the next."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


#: Bytes hashed at once: the arrays of one step take some 60 times as much.
BLOCK = 1 << 20


def run_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run ``a[start:end]``, a block of whole runs at a time."""
    h = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        h[at:to] = _block_hashes(a, starts[at:to], ends[at:to])
        at = to
    return h


class Lookup:
    """A fixed map from 64-bit keys to integers, looked up for whole arrays; ``missing`` where a key is not held."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self.key, self.value = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, missing, np.int64)
        self.used = np.zeros(1 << self.bits, bool)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            # of those that want one free slot the first gets it, the others look at the next slot
            _, first = np.unique(slot[left], return_index=True)
            got = left[first][~self.used[slot[left[first]]]]
            self.key[slot[got]], self.value[slot[got]], self.used[slot[got]] = keys[got], values[got], True
            left = np.setdiff1d(left, got, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * K3) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.value[slot]
        # a free slot holds the missing value, so a lookup that ends there is done
        left = np.flatnonzero((self.key[slot] != keys) & self.used[slot])
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = slot[left]
            out[left] = self.value[at]
            left = left[(self.key[at] != keys[left]) & self.used[at]]
        return out


def _block_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(offsets, sizes)
    at = place + np.repeat(starts, sizes)
    return mix(np.add.reduceat((a[at].astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[place], offsets))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hash, start and end of each word in the joined texts, each text's first word, the joined bytes."""
    data = b" ".join(texts).translate(WORD_TABLE)
    a = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(a) + 2, bool)
    np.not_equal(a, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return run_hashes(a, starts, ends), starts, ends, first, data


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one; one shorter than ``h``."""
    return mix(h[:-1] * K1 + h[1:]) if len(h) else h


class Bloom:
    """A filter of ``2**bits`` bits: lookups may err only towards yes."""

    def __init__(self, bits: int = 24, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), np.uint64) if words is None else words

    @classmethod
    def of(cls, df: DataFrame, column: str, most_bits: int = 27) -> Bloom:
        """From a column of 64-bit hashes, 16 bits for each; what reaches the driver is the filter's own size at most."""
        bits = min(most_bits, max(16, math.ceil(math.log2(16 * df.count() + 1))))
        place = F.array(*(F.shiftrightunsigned(column, s).bitwiseAND(F.lit((1 << bits) - 1)) for s in (0, 32)))
        rows = (
            df.select(F.explode(place).alias("bit"))
            .select(F.shiftright("bit", 6).alias("word"),
                F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int")).alias("mask"))
            .groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        )
        out = cls(bits)
        out.words[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
        return out

    def holds(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for s in (0, 32):
            bit = (h >> np.uint64(s)) & np.uint64((1 << self.bits) - 1)
            ok &= ((self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
        return ok
