"""Order MinHash against planted pairs of every edit similarity, and against all pairs in runs of one value."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from enquira.llm import components, hashing, order_minhash

BANDS = (80, 82, 84, 86, 88, 90, 92)


def changed(rng: random.Random, words: list[str], edits: int, kind: str) -> list[str]:
    """``edits`` words exchanged, or taken out and put in elsewhere in turn; never more edits than that."""
    out = list(words)
    for n, at in enumerate(rng.sample(range(len(words)), edits)):
        if kind == "exchange":
            out[at] = f"z{rng.randrange(10**9)}"
        elif n % 2:
            out.insert(rng.randrange(len(out) + 1), f"z{rng.randrange(10**9)}")
        else:
            out.pop(rng.randrange(len(out)))
    return out


@pytest.mark.parametrize("kind", ["exchange", "move"])
def test_recall_by_edit_similarity(spark, kind):
    """Pairs of 200 words at edit similarities from 0.80 on: nine tenths or more of each band share a class; clean texts none."""
    rng, each = random.Random(7), 100
    rows, band = [], {}
    for b in BANDS:
        for _ in range(each):
            words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
            other = changed(rng, words, (100 - b) * 2, kind)
            band[len(rows)] = b
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
            n = max(len(words), len(other))
            assert order_minhash.similar(rows[-2][1], rows[-1][1], b / 100 - 1 / n)
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    together = Counter(b for i, b in band.items() if found[i] == found[i + 1])
    assert {b: together[b] / each for b in BANDS if together[b] < 0.9 * each} == {}
    assert all(found[i] // 2 == i // 2 for i in found)


def test_sketch_values_are_ordered_pairs_of_the_samples():
    h = hashing.window_hashes([b"w%d" % i for i in range(300)], 5)
    values = order_minhash.order_sketch(h)
    assert len(values) == order_minhash.FUNCTIONS * order_minhash.KEPT * (order_minhash.KEPT - 1) // 2
    turned = order_minhash.order_sketch(h[::-1].copy())  # the same windows in the other order
    assert not set(values.tolist()) & set(turned.tolist())
    assert [len(order_minhash.order_sketch(h[:n])) for n in (1, 2, 3)] == [1, order_minhash.FUNCTIONS, 3 * order_minhash.FUNCTIONS]


def test_lengths_inside_a_hot_value(spark):
    """Texts that share one value and differ in length: what is similar by brute force is linked, at the borders of the classes of sizes too."""
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(6)]
    texts = {}
    for n in (20, 24, 25, 30, 31, 32, 40):
        words = shared + [f"w{rng.randrange(10**6)}" for _ in range(n - 6)]
        texts[len(texts)] = words
        texts[len(texts)] = words[: -int(0.2 * n)]  # just similar
        texts[len(texts)] = words[: -int(0.2 * n) - 1]  # just not, to the whole text
    for _ in range(60):
        texts[len(texts)] = shared + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(14, 40))]
    rows = [(i, 7, [5], len(w), " ".join(w)) for i, w in texts.items()]
    table = spark.createDataFrame(rows, "node long, other long, sk array<long>, size long, text string")
    none = spark.createDataFrame([], "node long, component long")
    found = components.remaining_links(
        table.select("node", "sk", "size"), none, spark.createDataFrame([], "value long"), lambda ends: table.select("node", "text").join(ends, "node"),
        order_minhash.labelled_words, lambda common, n, m: common >= np.maximum(n, m) - np.floor(0.2 * np.maximum(n, m) + 1e-9),
        lambda x, y: order_minhash.similar(x, y, 0.8), block=16, ratio=0.8,
    )
    label = {r.node: r.component for r in components.components(found).collect()}
    ids = sorted(texts)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if order_minhash.similar(" ".join(texts[a]), " ".join(texts[b]), 0.8):
                root[top(a)] = top(b)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            assert (label.get(a, a) == label.get(b, b)) == (top(a) == top(b)), (a, b)
