"""Line dedup against DuckDB and on edge cases."""

from __future__ import annotations

import duckdb
import pytest

from enquira.llm import line_dedup as L

from . import edge

DIR = "/root/testdata/sf0.001"


def test_query_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DIR}/documents.parquet')")
    found = c.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({L.ORACLE})").fetchall()
    ours = L.op12_line_dedup(spark, DIR).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, ours)) == sorted(found) and any(r.n_dropped for r in ours)


def test_threshold_counts_documents(spark):
    rows = [(i, f"Shared  line\nown {i}") for i in range(3)] + [(9, "  SHARED  LINE\t\nx\nshared  line\n\nİ LINE"), (9, "  SHARED  LINE\t\nx\nshared  line\n\nİ LINE"), (None, "İ line\nz"), (None, "z\nz")]
    out = L.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out if r.doc_id is not None) == [
        (False, 0, "own 0", 2, 1), (False, 1, "own 1", 2, 1), (False, 2, "own 2", 2, 1), (False, 9, "x\n\nİ LINE", 5, 2), (False, 9, "x\n\nİ LINE", 5, 2),
    ]
    two = L.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    # The dotted capital is no A-Z letter and keeps its case; rows without an id are told apart by their text.
    assert sorted(r.text for r in two if r.doc_id is None) == ["", ""]
    assert {r.text for r in two if r.doc_id == 9} == {"x\n"}


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    docs = edge.documents(spark, extra)
    if extra:
        from pyspark.sql import functions as F

        docs = docs.withColumn("n_lines", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("pos", F.lit(1)).withColumn("document", F.lit(1))
    out = L.drop_repeated_lines(docs, 2)
    assert out.columns == [*docs.columns, "_n_lines" if extra else "n_lines", "n_dropped"]
    by = {r.doc_id: r for r in out.collect()}
    assert out.count() == 13 and by[3].text == by[4].text == "" and by[5].text == "   \n\t " and by[6].text == ""
    assert by[8].text == edge.LONG and by[1].text == "" and by[1].n_dropped == 1
    assert L.drop_repeated_lines(edge.empty(spark)).count() == 0
