"""Ratios of ``difflib`` for many pairs of texts and questions at once."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: From this length on, ``difflib`` leaves frequent characters of the second text out; such pairs are its own.
LONG = 200
#: Characters that are looked at together.
CHARACTERS = 1 << 18


def points(texts: list[str]) -> np.ndarray:
    """The code points of all texts, one after another."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _longest(a, b, alo, ahi, blo, bhi):
    """Size, start in a and start in b of the longest common stretch of each interval, the first in a, then in b; intervals go by falling length in b."""
    sizes = ahi - alo + 1  # and a character that equals none
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at = np.arange(ends[-1]) - np.repeat(starts - alo, sizes)
    x = a[at]
    x[ends - 1] = 0
    length = bhi - blo
    best, where, k = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    for j in range(length[0]):
        n = np.searchsorted(-length, -j)  # longer than j
        t = ends[n - 1]
        same = x[:t] == np.repeat(b[blo[:n] + j], sizes[:n])
        now = same.view(np.uint8).copy()
        now[1:] += k[: t - 1]
        now *= same
        better = now > best[:t]
        np.putmask(where[:t], better, j)
        np.maximum(best[:t], now, out=best[:t])
        k = now
    most = np.maximum.reduceat(best, starts)
    hits = np.flatnonzero(best == np.repeat(most, sizes))
    first = hits[np.searchsorted(hits, starts)]
    size = most.astype(np.int64)
    return size, at[first] - size + 1, blo + where[first] - size + 1


def ratios(texts: list[str], questions: list[str], t: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``SequenceMatcher(None, texts[t], questions[q]).ratio()`` of every pair of places in t and q.

    The longest common stretch of an interval and the intervals left and right of it are found for all pairs of a depth together."""
    t, q = np.asarray(t, np.int64), np.asarray(q, np.int64)
    at, bt = _offsets(np.array([len(x) for x in texts], np.int64)), _offsets(np.array([len(x) for x in questions], np.int64))
    asked = points(questions)
    kinds = np.unique(asked)
    code = np.zeros(int(kinds[-1]) + 2 if len(kinds) else 2, np.min_scalar_type(len(kinds) + 1))
    code[kinds] = np.arange(1, len(kinds) + 1)
    a = np.append(code[np.minimum(points(texts), len(code) - 1)], code[-1:])
    b = code[asked]
    matched = np.zeros(len(t), np.int64)
    for pair in np.flatnonzero(np.diff(bt)[q] >= LONG):
        matched[pair] = sum(m.size for m in SequenceMatcher(None, texts[t[pair]], questions[q[pair]]).get_matching_blocks())
    own = np.flatnonzero(np.diff(bt)[q] < LONG)
    items = np.array([own, at[t[own]], at[t[own] + 1], bt[q[own]], bt[q[own] + 1]])
    while items.shape[1]:
        items = items[:, (items[2] > items[1]) & (items[4] > items[3])]
        items = items[:, np.argsort(items[3] - items[4], kind="stable")]
        part = np.cumsum(items[2] - items[1] + 1) // CHARACTERS
        rest = []
        for some in np.split(items, np.flatnonzero(np.diff(part)) + 1, axis=1) if items.shape[1] else ():
            pair, alo, ahi, blo, bhi = some
            size, i, j = _longest(a, b, alo, ahi, blo, bhi)
            np.add.at(matched, pair, size)
            found = size > 0
            rest += [np.array([pair, alo, i, blo, j])[:, found], np.array([pair, i + size, ahi, j + size, bhi])[:, found]]
        items = np.concatenate(rest, axis=1) if rest else items[:, :0]
    total = np.diff(at)[t] + np.diff(bt)[q]
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)
