"""Vectorised hashes of words and of runs of words or characters, for many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd 64-bit multipliers of the polynomial and mixing hashes (fixed values).
BASE = U(0x9E3779B97F4A7C15)
STEP = U(0xD6E8FEB86659FD93)
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class Powers:
    """Powers of BASE and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            ones = np.full(size, BASE, U)
            ones[0] = 1
            self.up = np.multiply.accumulate(ones)
            ones = np.full(size, U(_inverse(int(BASE))), U)
            ones[0] = 1
            self.down = np.multiply.accumulate(ones)
        return self.up[:n], self.down[:n]


class Words:
    """The words of many texts: hashes, byte positions and the text each is in.

    Texts are joined with a separator; a word's hash is a polynomial of its bytes taken from running
    sums, then mixed with its length.
    """

    def __init__(self, texts: list[bytes], powers: Powers):
        joined = b" ".join(texts) + b" "
        self.data = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths)])[:-1] if len(texts) else np.zeros(0, np.int64)
        space = _SPACE[self.data]
        word = ~space
        first = word.copy()
        first[1:] &= space[:-1]
        self.start = np.flatnonzero(first)
        last = word
        last[:-1] &= space[1:]
        self.end = np.flatnonzero(last) + 1
        up, down = powers.get(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((self.data.astype(U) + U(1)) * up[: len(self.data)], out=sums[1:])
            raw = (sums[self.end] - sums[self.start]) * down[self.start]
            self.hash = mix(raw + (self.end - self.start).astype(U) * STEP)
        self.text = np.searchsorted(self.text_start, self.start, "right") - 1
        self.first_word = np.searchsorted(self.start, np.append(self.text_start, len(self.data)))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hash of each run of k values."""
    n = max(0, len(hashes) - k + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U)
        for j in range(k):
            out = out * BASE + hashes[j : j + n]
        return mix(out)


def grams(values: np.ndarray, k: int, kind=U) -> np.ndarray:
    """Mixed polynomial hash of each run of k values, by doubling (as ``windows``, with fewer steps for long runs).

    kind is the width of the hash: 64 bits to tell runs apart, 32 for MinHash values.
    """
    base = int(BASE) >> (64 - np.iinfo(kind).bits) | 1
    power = lambda w: kind(pow(base, w, 1 << np.iinfo(kind).bits))
    with np.errstate(over="ignore"):
        part, width = values.astype(kind) + kind(1), 1  # runs of a power of two
        out, have = None, 0
        while True:
            if k & width:
                out = part if out is None else out[: max(0, len(part) - have)] * power(width) + part[have : have + len(out)]
                have += width
            if 2 * width > k:
                break
            part = part[:-width] * power(width) + part[width:] if len(part) > width else part[:0]
            width *= 2
        out = out[: max(0, len(values) - k + 1)]
        if kind is U:
            return mix(out)
        out = (out ^ (out >> kind(16))) * kind(0x85EBCA6B)
        out = (out ^ (out >> kind(13))) * kind(0xC2B2AE35)
        return out ^ (out >> kind(16))


def minhash(values: np.ndarray, starts: np.ndarray, multipliers: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """(len(starts), len(multipliers)) least products of the 32-bit values of each non-empty segment, block by block in cache."""
    small = values if values.dtype == np.uint32 else (values >> U(32)).astype(np.uint32)
    out = np.zeros((len(starts), len(multipliers)), np.uint32)
    ends = np.append(starts[1:], len(values))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + block, "right")))
        part = small[starts[a] : ends[b - 1]]
        at = starts[a:b] - starts[a]
        room = np.empty_like(part)
        for j, m in enumerate(multipliers):
            out[a:b, j] = np.minimum.reduceat(np.multiply(part, m, out=room), at)
        a = b
    return out
