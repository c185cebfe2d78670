"""Items that many documents hold, and items longer than a window."""

from __future__ import annotations

import random

from enquira.llm import latent_decontamination


def test_frequent_and_long_items(spark):
    rng = random.Random(8)
    frequent = " ".join(f"often{k}" for k in range(60))
    long_ = " ".join(f"long{k}" for k in range(600))
    changed = " ".join("other" if 200 <= k < 330 else f"long{k}" for k in range(600))

    def some(n):
        return " ".join(f"word{rng.randrange(3000)}" for _ in range(n))

    rows = [(n, f"{some(80)} {frequent} {some(80)}" if n % 3 == 0 else some(220)) for n in range(300)]
    rows += [(1000, f"{some(50)} {long_} {some(50)}"), (1001, f"{some(50)} {changed} {some(50)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(0, frequent), (1, long_), (2, some(50))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.lcs for r in latent_decontamination.find_leaks(docs, items).collect()}
    assert set(got) == {(n, 0) for n in range(0, 300, 3)} | {(1000, 1), (1001, 1)}
    assert got[1000, 1] == 1 and all(got[n, 0] == 1 for n in range(0, 300, 3))


def test_space_of_all_items(spark):
    """The space is fitted on the items, none left out, so inner products with them are exact while they are no more than its dimensions."""
    import numpy as np

    from enquira.llm import latent_decontamination as L

    items = [" ".join(f"w{i}x{k}" for k in range(40)) + " shared words here" for i in range(5)]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    held = spark.sparkContext.broadcast(L.Vocabulary(L.item_vocabulary(benchmark)))
    size = held.value.size
    idf = np.linspace(0.5, 3.0, size)
    vectors = L.latent_space(benchmark, held, idf, 8)
    rows = [held.value.rows(L.plain_words(t)) for t in items]
    window = np.r_[rows[0][:20], rows[3][10:30]]
    weights = [np.bincount(r, minlength=size) * idf for r in [window, *rows]]
    for r, w in zip(rows, weights[1:]):
        assert abs(vectors[window].sum(0) @ vectors[r].sum(0) - weights[0] @ w) < 1e-2 * (weights[0] @ weights[0])
