"""Near-copied lines in runs of many colliding lines."""

from __future__ import annotations

import random

from enquira.llm import paragraph_dedup


def test_near_lines_among_many_colliding_lines(spark):
    """Pairs of near-copied lines in runs full of lines with the same frame."""
    rng = random.Random(6)
    frame = [f"f{k}" for k in range(60)]
    rows = []
    for n in range(300):  # about 0.6 between lines, 0.9 within a pair
        line = frame + [f"n{n}k{k}" for k in range(20)]
        other = list(line)
        other[-1] = f"z{n}"
        rows += [" ".join(line), " ".join(other)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = paragraph_dedup.repeated_passages(docs).where("kind = 'line'").collect()
    grams = [set(zip(*(t.split()[k:] for k in range(5)))) for t in rows]
    values = [set(paragraph_dedup.band_values(c.hashes, *c.lines)[0].tolist()) for c in map(paragraph_dedup.Cut, rows)]
    least = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if values[i] & values[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                least = [least[i] if x == least[j] else x for x in least] if least[i] < least[j] else [least[j] if x == least[i] else x for x in least]
    assert {r.doc_id: r.first_doc for r in found} == {i: x for i, x in enumerate(least) if least.count(x) > 1}
