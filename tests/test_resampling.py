"""Resampling of cells against the distributions it stands for and against resampling of rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from enquira.operators import evaluation as E
from enquira.operators import mltables as M
from enquira.operators import resampling as S


@pytest.mark.parametrize("n", [1, 3, 32, 37, 1000, 2_000_000_000_000])
def test_weights_are_poisson(spark, n):
    cells = spark.createDataFrame([("c", n)], "cell string, n long")
    rows = [r.w for r in S.weights(cells, 4000, "t").collect()]
    rows += [0] * (4000 - len(rows))
    mean = sum(rows) / 4000
    var = sum((x - mean) ** 2 for x in rows) / 4000
    assert abs(mean - n) < 5 * math.sqrt(n / 4000) and abs(var / n - 1) < 0.15
    if n == 1:
        assert abs(rows.count(0) / 4000 - math.exp(-1)) < 0.03 and abs(rows.count(2) / 4000 - math.exp(-1) / 2) < 0.03


def test_steps():
    for bit, steps in enumerate(S.STEPS):
        assert steps == sorted(steps) and steps[-1] < 2**32
        mean = sum(1 - s / 2**32 for s in steps)  # the sum of P(X > k)
        assert abs(mean - 2**bit) < 1e-5


def test_paired_modes_agree(spark):
    rows = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(5)) / 5).alias("a"), (F.pmod(F.xxhash64("id"), F.lit(7)) / 7).alias("b"))
    by_rows, by_cells = E.paired_bootstrap(rows, 300).first(), E.paired_bootstrap(rows, 1000, mode="cells").first()
    assert by_rows.n == by_cells.n == 3000 and abs(by_rows.delta - by_cells.delta) < 2e-6
    width = by_rows.high - by_rows.low
    assert abs(by_rows.low - by_cells.low) < 0.15 * width and abs(by_rows.high - by_cells.high) < 0.15 * width
    empty = E.paired_bootstrap(rows.limit(0), mode="cells").first()
    assert (empty.n, empty.delta, empty.low) == (0, None, None)


def test_f1_modes_agree(spark):
    rows = spark.range(2000).select("id", F.pmod(F.xxhash64("id"), F.lit(3)).cast("int").alias("label"))
    pred = rows.select("*", F.lit("real").alias("variant"), F.when(F.col("id") % 5 < 3, F.col("label")).otherwise(0).alias("pred")).unionByName(
        rows.select("*", F.lit("v1").alias("variant"), F.when(F.col("id") % 5 < 4, F.col("label")).otherwise(1).alias("pred"))
    )
    a = {(r.variant, r.metric): r for r in M.bootstrap_f1_ci(pred, 200).collect()}
    b = {(r.variant, r.metric): r for r in M.bootstrap_f1_ci(pred, 1000, mode="cells").collect()}
    assert a.keys() == b.keys()
    for k, x in a.items():
        y, width = b[k], x.high - x.low
        assert x.point == y.point and abs(x.low - y.low) < 0.25 * width and abs(x.high - y.high) < 0.25 * width


def test_gains_share_draws(spark):
    rows = [(q, s, q % 3 == 0 or s != "cold", True) for q in range(60) for s in ("cold", "full", "same")]
    table = spark.createDataFrame(rows, "query_id long, stage string, recall3 boolean, recall5 boolean")
    found = {(r.stage, r.metric): r for r in S.gain_cells(table, ("recall3", "recall5"), "cold").collect()}
    assert tuple(found["full", "recall3"])[2:] == tuple(found["same", "recall3"])[2:]
    assert found["full", "recall3"].low < 2 / 3 < found["full", "recall3"].high and found["full", "recall5"].high == 0
