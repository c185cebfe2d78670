"""Queries against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from enquira.plans import adapters, registry

DIR = "/root/testdata/sf0.001"
CHECKED = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in adapters.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    ours = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
    at = [found.columns.index(c) for c in order]
    theirs = sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())
    assert ours == theirs


def test_flagship(spark):
    assert registry.queries()["tfidf_search"](spark, DIR).count() > 0
