"""Runs against a plain scan of every period, and the query against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from enquira.llm import periodic_runs as P

from . import edge

DIR = "/root/testdata/sf0.001"


def plain_runs(w: list, least: int = 24) -> list[tuple[int, int, int]]:
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 3 * q):
                out.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_runs(letters):
    rnd = random.Random(letters)
    for _ in range(150):
        n = rnd.randint(0, 330)
        w = [rnd.randint(1, letters) for _ in range(n)]
        for _ in range(rnd.randint(0, 4) if n > 30 else 0):
            a, p = rnd.randrange(n), rnd.randint(1, 80)
            for i in range(a + p, min(n, a + rnd.randint(10, 300))):
                w[i] = w[i - p]
        assert [tuple(r) for r in P.find_runs(np.array(w, np.int32)).tolist()] == sorted(plain_runs(w), key=lambda r: (r[0], r[2]))


def test_extensions():
    rnd = np.random.default_rng(1)
    w = np.tile(rnd.integers(1, 4, 97), 9).astype(np.int32)
    w[500] = 9
    lce = P.Extensions(w)
    i = rnd.integers(0, len(w) - 1, 3000)
    j = rnd.integers(0, len(w), 3000)
    keep = i < j
    got = lce.lce(i[keep], j[keep])
    for a, b, x in zip(i[keep], j[keep], got):
        same = w[a : a + len(w) - b] == w[b:]
        assert x == (len(same) if same.all() else int(np.argmin(same)))
    assert len(lce.table) > 1


def test_grid_in_blocks(monkeypatch):
    w = np.tile(np.arange(1, 31), 2000).astype(np.int32)
    monkeypatch.setattr(P, "GRID", 1 << 14)
    assert P.find_runs(w).tolist() == [[0, 60_000, 30]]


def expected(doc, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = P.op11_periodic_runs(spark, DIR).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {d: expected(d, t) for d, t in texts.items()}
    assert sum(r.n_runs > 0 for r in rows) > 5


def test_edges(spark):
    rows = P.periodic_runs(edge.documents(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].collapsed == ""
    assert by[8].n_words == 60_000 and by[8].runs == []  # "otherN" never repeats
    assert by[11].collapsed.startswith("<|endoftext|> Ünïcode ß 中文")
    assert P.periodic_runs(edge.empty(spark)).count() == 0
    again = spark.createDataFrame([(1, "x\ty " * 40 + "end"), (1, "x\ty " * 40 + "end")], "doc_id long, text string")
    assert [(r.runs[0].asDict(), r.collapsed) for r in P.periodic_runs(again).collect()] == [({"start": 0, "length": 80, "period": 2}, "x y end")] * 2
