"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import pytest

from enquira.llm import (
    chat_windows,
    curriculum,
    isolation_quality,
    latent_decontamination,
    order_minhash,
    ordinal_toxicity,
    paragraph_dedup,
    ppm,
    surrogates,
    token_blocks,
)

from . import edge

BENCH = "item_id long, text string"


def bench(spark):
    return spark.createDataFrame([(0, edge.PASSAGE), (1, None), (2, ""), (3, "quite unrelated item words"), (3, "quite unrelated item words")], BENCH)


OPERATORS = {
    "order_minhash": lambda s, d: order_minhash.near_duplicates(d),
    "deduplicate": lambda s, d: order_minhash.deduplicate(d),
    "ppm": lambda s, d: ppm.score_documents(d),
    "paragraph_dedup": lambda s, d: paragraph_dedup.repeated_passages(d),
    "token_blocks": lambda s, d: token_blocks.encode_documents(d),
    "curriculum": lambda s, d: curriculum.assign(d),
    "mix": lambda s, d: curriculum.mix(d),
    "toxicity": lambda s, d: ordinal_toxicity.score_documents(d, edge.labels(s)),
    "decontamination": lambda s, d: latent_decontamination.find_leaks(d, bench(s)),
    "quality": lambda s, d: isolation_quality.filter_quality(d, edge.labels(s)),
    "surrogates": lambda s, d: surrogates.replace_entities(d, "k"),
}
PER_ROW = {"order_minhash", "ppm", "token_blocks", "curriculum", "toxicity", "quality", "surrogates"}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    docs = edge.documents(spark)
    rows = OPERATORS[name](spark, docs).collect()
    if name in PER_ROW:
        assert len(rows) == docs.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, edge.empty(spark)).count() == 0


def test_classes(spark):
    rows = order_minhash.near_duplicates(edge.documents(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.class_id for i in (1, 2) for r in by[i]} == {1}
    assert by[7][0].class_id == 6 and by[6][0].keep and not by[7][0].keep
    assert [r.keep for i in (3, 4, 5) for r in by[i]] == [True] * 3
    kept = sorted(str(r.doc_id) for r in order_minhash.deduplicate(edge.documents(spark)).collect())
    assert kept == sorted(map(str, [1, 3, 4, 5, 6, None, 8, 9, 11]))  # 10 shares most of its windows with 9


def test_identical_rows_count_once(spark):
    rows = spark.createDataFrame([(5, "one two three four five six")] * 3, "doc_id long, text string")
    assert order_minhash.deduplicate(rows).count() == 1


def test_passage_inside_line(spark):
    rows = paragraph_dedup.repeated_passages(edge.documents(spark), run_words=25).collect()
    found = {r.doc_id: r for r in rows if r.doc_id in (9, 10)}
    assert set(found) == {9, 10}
    assert all(r.removed for r in rows if r.doc_id == 10) and not any(r.removed for r in rows if r.doc_id == 9)


def test_leaks(spark):
    rows = latent_decontamination.find_leaks(edge.documents(spark), bench(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(9, 0), (10, 0)}


def test_chat_edges(spark):
    rows = [(1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, 0, "system", "s"), (2, 0, "system", "only"), (3, 5, "assistant", "<turn a=\"b\">&amp;</turn>\n")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_windows.digest(chat_windows.format_windows(talk)).collect()}
    assert got[1].n_turns == 3 and got[None].n_turns == 1 and got[2].loss_chars == 0
    assert got[3].loss_chars == len(rows[-1][3])
    assert chat_windows.digest(chat_windows.format_windows(talk.limit(0))).count() == 0


def test_short_paragraphs_are_reported(spark):
    """An exact paragraph of twenty words in five documents; longer runs may be asked for."""
    same = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"line {i} of this one text\n{same}\nlast {i} has yet other words {i}") for i in range(5)] + [(9, None)], "doc_id long, text string")
    rows = [r for r in paragraph_dedup.repeated_passages(docs).collect() if r.kind == "line"]
    assert sorted((r.doc_id, r.first_word, r.last_word, r.first_doc, r.removed) for r in rows) == [(i, 6, 25, 0, i > 0) for i in range(5)]
    assert paragraph_dedup.repeated_passages(docs, run_words=25).count() == 0


def test_line_clusters_against_brute_force(spark):
    """All lines of sf0.001 and varied copies of some: clusters are the components of all pairs with Jaccard 0.8."""
    import random

    from enquira.llm.hashing import window_hashes

    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    lines = [x for t in texts for x in t.split("\n") if len(x.split()) >= 12][:300]
    for x in lines[:60]:
        w = x.split()
        w[rng.randrange(len(w))] = "changed"
        lines.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r.doc_id: r.first_doc for r in paragraph_dedup.repeated_passages(docs).where("kind = 'line'").collect()}
    sets = [set(window_hashes(x.lower().encode().split(), 5).tolist()) for x in lines]
    root = list(range(len(lines)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    members = [top(i) for i in range(len(lines))]
    expected = {i: m for i, m in enumerate(members) if members.count(m) > 1}
    hits = sum(found.get(i) == m for i, m in expected.items())
    assert len(expected) > 20 and hits >= 0.9 * len(expected) and set(found) <= set(expected)


def test_values_of_odd_rows(spark):
    """Null, blank, long, tied and repeated texts: the values that the docstrings state."""
    import zlib

    import numpy as np

    docs = edge.documents(spark)

    def by_id(rows):
        out = {}
        for r in rows:
            out.setdefault(r.doc_id, []).append(r)
        return out

    scored = by_id(ppm.score_documents(docs).collect())
    for i in (3, 4, 5):
        assert (scored[i][0].n_tokens, scored[i][0].n_known, scored[i][0].n_bytes) == (1, 1, 1)
    assert scored[8][0].n_tokens == len(edge.LONG.split()) + 1 and scored[6][0].score == scored[7][0].score
    assert len({(r.score, r.base_score) for i in (1, 2) for r in scored[i]}) == 1 and not scored[None][0].held_out

    coded = by_id(token_blocks.encode_documents(docs).collect())
    end = zlib.crc32(np.array([2], "<u4").tobytes())
    assert all((coded[i][0].n_tokens, coded[i][0].ids_crc32) == (1, end) for i in (3, 4)) and coded[None][0].start == 0
    order = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens) for rows in coded.values() for r in rows)
    assert [i for _, i, _ in order] == sorted(i for _, i, _ in order) and all(a[0] + a[2] == b[0] for a, b in zip(order, order[1:]))

    mixed = by_id(curriculum.assign(docs).collect())
    assert all((mixed[i][0].size, mixed[i][0].taken, mixed[i][0].takes) == (0, 0, []) for i in (3, 4, 5)) and mixed[8][0].size == len(edge.LONG.split())
    assert {r.source_size for r in mixed[3]} == {sum(r.size for i in (3, 10) for r in mixed[i])}  # null sources are one

    toxic = by_id(ordinal_toxicity.score_documents(docs, edge.labels(spark)).collect())
    assert all(toxic[i][0].severity == toxic[3][0].severity for i in (4, 5)) and toxic[6][0].p_toxic == toxic[7][0].p_toxic and toxic[1][0].rank == "clash"

    judged = by_id(isolation_quality.filter_quality(docs, edge.labels(spark)).collect())
    for i in (3, 4, 5):
        r = judged[i][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (0, 0, 0, 0, 0, True, False)
    assert judged[8][0].n_words == len(edge.LONG.split()) and not any(r.kept for rows in judged.values() for r in rows if r.base_failed)

    named = by_id(surrogates.replace_entities(docs, "k").collect())
    assert named[3][0].text is None and named[4][0].text == "" and named[8][0].text == edge.LONG and all(r.n_entities == 0 for rows in named.values() for r in rows)


def test_long_conversation_with_clashing_columns(spark):
    """A conversation of 500 turns and one long text; extra columns are not read."""
    turns = [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(500)] + [(2, 0, "assistant", edge.LONG)]
    talk = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for c in ("window", "tokens", "formatted", "n", "run"):
        talk = talk.withColumn(c, talk["role"])
    got = {r.conv_id: r for r in chat_windows.digest(chat_windows.format_windows(talk)).collect()}
    assert got[1].n_turns == 500 and got[1].loss_chars == sum(len(t[3]) for t in turns[:500] if t[2] == "assistant") and got[2].loss_chars == len(edge.LONG)
