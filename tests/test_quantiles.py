"""Exact quantiles against ``percentile`` and by hand."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from enquira.operators import quantiles


@pytest.mark.parametrize("p", [0.5, 0.025, 0.9, 0.0, 1.0])
def test_against_percentile(spark, monkeypatch, p):
    monkeypatch.setattr(quantiles, "COUNTERS", 64)  # few cells, so that every column takes several passes
    rng = random.Random(11)
    rows = [
        (rng.gauss(0, 1), 10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]), float(rng.randrange(3)), None if rng.random() < 0.5 else rng.random(), rng.randrange(10**9), 1.0 + n * 2.0**-50)
        for n in range(1001)
    ]
    df = spark.createDataFrame(rows, "normal double, wide double, few double, holes double, whole long, close double")
    want = df.agg(*(F.percentile(c, F.lit(p)).alias(c) for c in df.columns)).first().asDict()
    got = quantiles.exact_quantiles(df, df.columns, p)
    for c in df.columns:
        assert math.isclose(got[c], want[c], rel_tol=1e-12), (c, got[c], want[c])


def test_ends_by_hand(spark):
    big, inf, nan = 1.7e308, math.inf, math.nan
    columns = {
        "none": [None] * 4, "one": [None, None, None, 3.0], "even": [1.0, 2.0, 10.0, 20.0], "zeros": [0.0, -0.0, 0.0, -0.0], "ends": [-big, -1.0, 1.0, big],
        "infinite": [-inf, -inf, 5.0, inf], "nan": [1.0, nan, nan, nan], "tiny": [5e-324, 5e-324, 1e-323, 1e-323],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    got = quantiles.exact_quantiles(df, list(columns))
    assert math.isnan(got.pop("nan"))
    assert got["infinite"] == -inf and got["zeros"] == 0.0 and 5e-324 <= got["tiny"] <= 1e-323
    assert got["ends"] == 0.0 and got["even"] == 6.0 and got["one"] == 3.0 and got["none"] is None
    empty = quantiles.exact_quantiles(df.limit(0), ["even"])
    assert empty == {"even": None}
