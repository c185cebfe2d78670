"""Hashes of all words or word windows of a text at once, the same on every machine."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class SpanHashes:
    """Hashes of spans of words: polynomials over the bytes of the words joined by
    spaces, from differences of one running sum."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b" ".join(words), np.uint8)
        n = len(data)
        _grow(n + 1)
        self.run = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=self.run[1:])
        gaps = np.flatnonzero(data == 32)
        self.begins = np.r_[0, gaps + 1]
        self.ends = np.r_[gaps, n]

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the spans from word ``first`` to word ``last``, both included."""
        return self.bytes_from(self.begins[first], self.ends[last])

    def bytes_from(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``begin`` to before ``end``."""
        return mix((self.run[end] - self.run[begin]) * _powers[1][begin])

    def word_sums(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Other hashes of the spans from word ``first`` to word ``last``: polynomials over the hashes of their words."""
        n = len(self.begins)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.windows(1) + np.uint64(0x2545F4914F6CDD1D)) * _powers[0][:n], out=run[1:])
        return mix((run[last + 1] - run[first]) * _powers[1][first] + np.uint64(1))

    def windows(self, k: int) -> np.ndarray:
        k = min(k, len(self.begins))
        first = np.arange(len(self.begins) - k + 1)
        return self.spans(first, first + k - 1)


def window_hashes(words: list[bytes], k: int) -> np.ndarray:
    """One hash per window of k words (of all words, if there are fewer)."""
    return SpanHashes(words).windows(k) if words else np.zeros(0, np.uint64)


def occurrence_numbers(h: np.ndarray) -> np.ndarray:
    """For each value, how often it has occurred before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty(len(h), np.uint64)
    out[order] = (np.arange(len(s)) - start).astype(np.uint64)
    return out


def word_hashes(words: list[bytes], at_once: int = 100_000) -> np.ndarray:
    """One hash per word, of any number of words."""
    if not words:
        return np.zeros(0, np.int64)
    return np.concatenate([SpanHashes(words[s : s + at_once]).windows(1) for s in range(0, len(words), at_once)]).view(np.int64)


class CodeTable:
    """A hash table of codes with one number each, for arrays of codes at once."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(codes)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits)
        left, slot = np.arange(len(codes)), self.slots(codes)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = codes[left[free]]
            got = self.keys[slot] == codes[left]
            self.values[slot[got]] = values[left[got]]
            left, slot = left[~got], (slot[~got] + 1) & ((1 << self.bits) - 1)

    def slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 for absent codes) and which codes are present."""
        slot = self.slots(codes)
        found = self.keys[slot] == codes
        value = self.values[slot]
        open_ = np.flatnonzero(~found)
        value[open_] = 0
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            key = self.keys[slot]
            hit = key == codes[open_]
            found[open_[hit]] = True
            value[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (key != -1)
            open_, slot = open_[on], slot[on]
        return value, found
