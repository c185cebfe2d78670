"""Values that many unrelated texts share: few rows, and no similar pair lost."""

from __future__ import annotations

import random

import numpy as np
import pytest

from enquira.llm import components, hashing, order_minhash


def test_hot_value_carries_few_rows(spark, monkeypatch):
    """Texts that share one passage and nothing else: their pairs are ruled out before any text is joined to them."""
    rng, written = random.Random(5), {}
    cut = components.cut

    def counted(df, label):
        out = cut(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(components, "cut", counted)
    passage = [f"p{i}" for i in range(20)]
    texts = [" ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(80)]) for _ in range(400)]
    texts += [" ".join([*texts[7].split()[:-10], "end"]), " ".join(["start", *texts[300].split()[5:]])]
    table = spark.createDataFrame([(i, [5], len(t.split()), t) for i, t in enumerate(texts)], "node long, sk array<long>, size long, text string")
    found = components.remaining_links(
        table.select("node", "sk", "size"), spark.createDataFrame([], "node long, component long"), spark.createDataFrame([], "value long"),
        lambda ends: table.select("node", "text").join(ends, "node"), order_minhash.labelled_words,
        lambda common, n, m: common >= np.maximum(n, m) - np.floor(0.2 * np.maximum(n, m) + 1e-9), lambda x, y: order_minhash.similar(x, y, 0.8),
        block=64, ratio=0.8,
    )
    assert {(r.a, r.b) for r in found.collect()} == {(7, 400), (300, 401)}
    assert written["open-waiting"] <= 8


@pytest.mark.parametrize("n", [3, 300, 3000, 30000])
def test_signatures_bound_common_features(n):
    rng = np.random.default_rng(n)
    hashes = hashing.mix(rng.integers(0, 1 << 62, 2 * n).astype(np.uint64))
    sets = [np.unique(hashes[rng.permutation(2 * n)[: n + k]]) for k in range(3)] + [np.unique(hashes[:1]), hashes[:0]]
    size, every = np.array([len(x) for x in sets]), np.arange(len(sets))
    most = components._most_common([components.signature(x) for x in sets], size, every, every)
    common = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    assert (most >= common).all() and (np.diag(most) == size).all()
