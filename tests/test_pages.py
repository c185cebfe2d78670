"""Lines and requirement fields of pages, with digits where an element's place was once trimmed off."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from enquira.operators import pages


def by_sql(name: str, table: str, column: str, rows: list[tuple]) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table} ({'doc_id' if column == 'text' else 'page_id'} BIGINT, {column} VARCHAR)")
    con.executemany(f"INSERT INTO {table} VALUES (?, ?)", rows)
    return sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def test_bullets_keep_digits(spark, tmp_path):
    rows = [(1, "0 none 0\n 1 one 1 •22·  \u00a03 three\u3000\n\n4"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = __spark_entry__.queries()["explode_bullets"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 0, "0 none 0"), (1, 1, "1 one 1"), (1, 2, "22"), (1, 3, "3 three"), (1, 4, "4")] == by_sql("explode_bullets", "documents", "text", rows)


def test_requirements_keep_digits(spark, tmp_path):
    rows = [(n, h) for n, h in enumerate(["0 MSc: a degree, 2:1", "<p>maé for 21</p> 0", "\u00a0contact a\u2028b@", "Kindly english level 10\u3000", "0", "", "tail 0", "master\x0bs degree"])]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = __spark_entry__.queries()["extract_requirements"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == by_sql("extract_requirements", "pages", "html", rows)
    assert spark.createDataFrame([("0 a 0\n 1 b 1 \n\nc",)], "t string").select(pages.one_line(F.col("t"))).first()[0] == "0 a 0 1 b 1 c"
