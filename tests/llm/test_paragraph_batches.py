"""Paragraphs of many texts cut and hashed at once."""

from __future__ import annotations

import random

import numpy as np

from enquira.llm import paragraph_dedup


def test_texts_cut_together_are_cut_alike():
    rng = random.Random(2)
    texts = [None, "", "\n\n", "one two three", "\n a b c d e f g\n", *(" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(200))).replace("w7", "\n") for _ in range(60))]
    kind, text, number, first, last, node, more, bands = paragraph_dedup.Cut(*texts).rows()
    together = {(k, t): [] for k in (0, 1) for t in range(len(texts))}
    for k, t, i, *row in zip(*(x.tolist() for x in (kind, text, number, first, last, node, more))):
        assert i == len(together[k, t])
        together[k, t].append(row)
    for t, x in enumerate(texts):
        alone = paragraph_dedup.Cut(x)
        for k, (a, b) in enumerate((alone.lines, alone.pieces)):
            expected = [] if not len(a) else np.column_stack([a, b, alone.hashes.spans(a, b).view(np.int64), alone.hashes.word_sums(a, b).view(np.int64)]).tolist()
            assert together[k, t] == expected
            if k == 0 and len(a):
                assert (bands[text[kind == 0] == t] == paragraph_dedup.band_values(alone.hashes, a, b).view(np.int64)).all()


def test_bands_are_exact_beside_pieces(spark):
    """The bands of lines are whole 64-bit values, also in a batch that holds pieces, which have none."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = paragraph_dedup.paragraph_table(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {r.kind for r in rows} == {0, 1}
    c = paragraph_dedup.Cut(text)
    expected = paragraph_dedup.band_values(c.hashes, *c.lines).view(np.int64)[0].tolist()
    assert [[r[f"b{k}"] for k in range(paragraph_dedup.BANDS)] for r in rows if r.kind == 0] == [expected]
    assert all(r.b0 is None for r in rows if r.kind == 1)
