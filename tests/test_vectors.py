"""Candidate search against the exact one."""

from __future__ import annotations

from pyspark.sql import functions as F

from enquira.operators import retrieval as R
from enquira.sources.shared import stored


def test_recall_and_plan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = rows.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.idx) for r in R.vector_search(queries, rows).collect()}
    found = R.vector_search(queries, rows, mode="candidates")
    got = {(r.query_id, r.idx): r.score for r in found.collect()}
    assert len(exact & got.keys()) >= 0.9 * len(exact)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    q = queries.select(F.col("vec_id").alias("query_id"), R.unit(F.col("embedding")).alias("qv"))
    d = rows.select(F.col("vec_id").alias("idx"), R.unit(F.col("embedding")).alias("dv"))
    assert stored(R.vector_candidates(q, d), "pairs").count() < 0.5 * queries.count() * rows.count()


def test_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.5, 0.25, 0.0]) for i in range(200)] + [(500, [0.9, 0.5, 0.3, 0.1]), (501, [0.0] * 4), (502, None), (503, [-1.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = table.where("vec_id in (0, 500, 501, 502)")
    got = {}
    for r in R.vector_search(queries, table, mode="candidates", directions=64, buckets=8, probes=8).collect():
        got.setdefault(r.query_id, []).append(r.idx)
    exact = {}
    for r in R.vector_search(queries, table).collect():
        exact.setdefault(r.query_id, []).append(r.idx)
    assert got == {0: [1, 2, 3, 4, 5], 500: [0, 1, 2, 3, 4]} and all(exact[k] == v for k, v in got.items())


def test_keywords_are_looked_up_by_their_beginning(spark):
    queries = spark.createDataFrame([(1, "a visa, VISAS and fees"), (2, ""), (3, "x"), (4, None), (5, "naïve café – fees")], "query_id long, text string").select("query_id", F.lower("text").alias("_q"))
    words = [(1, "Visa"), (1, "visa"), (2, "x"), (3, "fe"), (4, ""), (5, "café – FEES"), (6, "as and"), (7, "absent word"), (8, None)]
    keywords = spark.createDataFrame(words, "idx long, kw string")
    got = sorted(map(tuple, R.keyword_hits(queries, keywords).collect()))
    want = sorted((q.query_id, i) for q in queries.collect() for i, w in words if w and q._q and w.lower() in q._q)
    assert got == want and len(got) == 7
    found = R.keyword_hits(queries.hint("merge"), keywords)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in found and "Cartesian" not in found


def test_searches_make_no_table_of_pairs(spark):
    """Odd vectors and many ties against the plain product of all pairs; no join in either plan."""
    rows = [(i, [float((i * 7 + j * j) % 5 - 2) for j in range(4)]) for i in range(300)] + [(900, [0.0] * 4), (901, None), (902, [1.0, 2.0]), (903, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = table.where("vec_id % 20 = 0 or vec_id > 899")
    q = queries.select(F.col("vec_id").alias("query_id"), R.unit(F.col("embedding")).alias("qv"))
    d = table.select(F.col("vec_id").alias("idx"), R.unit(F.col("embedding")).alias("dv"))
    plain = R.top_k(d.join(q, F.col("idx") != F.col("query_id")).select("query_id", "idx", R.dot_score("dv", "qv").alias("score")), "query_id", "score", "idx", 5)
    found = R.vector_search(queries, table)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (found, R.vector_search(queries, table, mode="candidates"))):
        assert "Join" not in plan and "Cartesian" not in plan
