"""Sinks that count a batch once and show nothing of a failed job."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from enquira.operators import pages
from enquira.sources import exports, stores, upserts

SCHEMA = "seq long, title string, url string, institution string, data_type string, level string, tags array<string>"


def record(seq, title, url, institution="a", data_type="courses", level=None, tags=None):
    return (seq, title, url, institution, data_type, level, tags)


BATCHES = [
    [record(1, "one", "u1", level="BSc", tags=["x"]), record(2, "again", "u1"), record(3, None, "u3"), record(4, "none", None), record(5, "other", "u1", "b")],
    [record(6, "late", "u1"), record(7, "new", "u7"), record(8, "none", None), record(9, "room", "u1", "a", "accommodation")],
]


def kept(store):
    return sorted((r.batch, r.seq, r.source) for r in store.rows().collect())


WANTED = [(0, 1, "a_courses"), (0, 4, "a_courses"), (0, 5, "b_courses"), (1, 7, "a_courses"), (1, 8, "a_courses"), (1, 9, "a_accommodation")]


def test_batches_count_once(spark, tmp_path):
    store = upserts.UpsertStore(spark, str(tmp_path / "s"), 4)
    assert store.rows().count() == 0 and tuple(store.statistics().first()) == (0, 0, 0)
    for batch in (0, 1, 0, 1):
        store.upsert(spark.createDataFrame(BATCHES[batch], SCHEMA), batch)
    assert kept(store) == WANTED and tuple(store.statistics().first()) == (5, 1, 2)
    one = store.rows().where("seq = 1").first()
    assert one.extra == '{"level":"BSc","tags":["x"]}' and one.related_faqs == "[]" and one.scraped_at
    assert store.rows().where("seq = 5").first().extra == "{}"


def test_broken_batch(spark, tmp_path):
    """A batch that broke off before its ledger row is not seen, and its next try replaces what it left."""
    store = upserts.UpsertStore(spark, str(tmp_path / "s"), 4)
    store.upsert(spark.createDataFrame(BATCHES[0], SCHEMA), 0)
    left = store.prepared(spark.createDataFrame(BATCHES[1][:2], SCHEMA))
    left.write.partitionBy("source", "bucket").parquet(f"{tmp_path}/s/rows/batch=1")
    assert kept(store) == WANTED[:3]
    store.upsert(spark.createDataFrame(BATCHES[1], SCHEMA), 1)
    assert kept(store) == WANTED
    store.upsert(spark.createDataFrame([], SCHEMA), 2)
    assert kept(store) == WANTED and store.batches().count() == 3


def test_stream_of_batches(spark, tmp_path):
    for part in BATCHES:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = upserts.UpsertStore(spark, str(tmp_path / "s"), 4)
    for checkpoint in ("c1", "c2"):  # a lost checkpoint brings the same batches again
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(store.upsert).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert kept(store) == WANTED


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, ["a", None], dt.date(2026, 1, 2)), (2, "zwölf \n \"x\"", [], None)], "n long, said string, tags array<string>, day date").repartition(3)
    path = exports.export_json(rows, str(tmp_path), "inst", "courses", {"scraper_used": "s", "total_errors": 2}, "raw", "20260101_000000")
    assert path.endswith("/inst_courses_raw_20260101_000000")
    block = exports.export_metadata(spark, path)
    assert block["metadata"] == {"scraper_used": "s", "total_errors": 2} and block["rows"] == 2 == sum(p["rows"] for p in block["parts"])
    assert sorted(map(tuple, exports.read_export(spark, path).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "inst_courses_raw_20260101_000000" / "part-stray.json").write_text('{"n": 99}')  # a task whose twin counted
    assert exports.read_export(spark, path).count() == 2
    empty = exports.export_json(rows.limit(0), str(tmp_path), "inst", "rooms", {})
    assert exports.read_export(spark, empty).count() == 0 and exports.read_export(spark, empty).columns == rows.columns
    with pytest.raises(ValueError):
        exports.export_json(rows, str(tmp_path), "i", "c", {}, "other")


def test_failed_export_leaves_nothing(spark, tmp_path):
    rows = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("n"))
    with pytest.raises(Exception, match="no"):
        exports.export_json(rows, str(tmp_path), "i", "c", {}, stamp="x")
    assert not (tmp_path / "i_c_processed_x").exists()
    with pytest.raises(Exception):
        exports.read_export(spark, f"{tmp_path}/i_c_processed_x")


def test_csv_of_nested_and_of_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(2, None, ["a", 'b"'], {"k": 1}), (1, "x, \"y\"\nz", [], None)], "n long, said string, tags array<string>, more map<string,int>")
    stores.write_csv(rows, str(tmp_path / "c"))
    got = stores.read_csv(spark, str(tmp_path / "c"), rows.columns).orderBy("n").collect()
    assert [tuple(r) for r in got] == [("", "1", 'x, "y"\nz', "[]"), ('{"k":1}', "2", "", '["a","b\\""]')]
    stores.write_csv(rows.limit(0), str(tmp_path / "none"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "none")).collect()] == ["No data scraped"]
    assert stores.read_csv(spark, str(tmp_path / "none"), rows.columns).count() == 0


def test_sources_with_errors_are_passed_over(spark):
    text = "<p>" + "word " * 60 + "</p>"
    rows = [("a", 1, text, 404), ("a", 2, "<p>short</p>", 200), ("a", 3, text, 200), ("b", 1, text, None), ("c", 1, text, 500)]
    found = pages.first_good_source(spark.createDataFrame(rows, "host string, try_no int, html string, status int"), "host")
    assert {r.host: r.try_no for r in found.collect()} == {"a": 3, "b": 1}
