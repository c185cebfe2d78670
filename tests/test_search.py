"""Search that skips common terms, and padding, against the plain search."""

from __future__ import annotations

import random

import pytest

from enquira.operators import retrieval as R


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, "everywhere often " * (1 + i % 2) + " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for i in range(300)]
    queries = [(i, " ".join(rnd.choices([*words, *["everywhere", "often"] * 8], k=rnd.randint(1, 6)))) for i in range(60)]
    queries += [(100, "everywhere"), (101, "everywhere often"), (102, "nothing known"), (103, "  "), (104, "w1 everywhere everywhere everywhere")]
    return R.tfidf_index(spark.createDataFrame(docs, "idx long, document string")), spark.createDataFrame(queries, "query_id long, query string")


@pytest.mark.parametrize("common", [0.0, 0.02, 0.5, 1.0])
def test_same_hits_without_common_terms(spark, corpus, common):
    (postings, idf), queries = corpus
    rows = lambda df: sorted((r.query_id, r["rank"], r.idx, round(r.cosine, 8)) for r in df.collect())
    assert rows(R.tfidf_search(queries, postings, idf, 3, common=common)) == rows(R.tfidf_search(queries, postings, idf, 3))


def test_common_postings_are_skipped(spark, corpus):
    """For queries that common terms cannot decide, fewer sums are made than documents hold them."""
    (postings, idf), queries = corpus
    some = queries.where("query_id < 60")
    q = R.query_vectors(some, idf)
    sums = R.skipping_scores(q, postings, R.term_impacts(postings), 300, 3, 0.5, "query_id", "idx")
    asked = q.where("term in ('everywhere', 'often')").select("query_id").distinct().count()
    assert 0 < sums.count() and asked > 5
    full = q.join(postings, "term").select("query_id", "idx").distinct()
    assert sums.count() < full.count()


def test_padding(spark, corpus):
    (postings, idf), queries = corpus
    got = {}
    for r in R.tfidf_search(queries.where("query_id >= 100"), postings, idf, 4, pad_zero=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.idx, r.cosine))
    assert got[102] == [(n + 1, n, 0.0) for n in range(4)] and 103 not in got and all(len(v) == 4 for v in got.values())
    few = postings.where("idx in (7, 9)")
    two = R.tfidf_search(queries.where("query_id = 100"), few, idf, 4, pad_zero=True)
    assert [r.idx for r in two.orderBy("rank").collect()] == [r.idx for r in R.tfidf_search(queries.where("query_id = 100"), few, idf, 4).orderBy("rank").collect()]
