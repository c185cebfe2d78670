"""The experiment grid against single runs and hand-computed sums."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from enquira.operators import experiments, mltables, models
from enquira.operators.matrix import build_matrix

from test_models import many


def rows_of(spark, n=150):
    return many(spark, n).withColumn("group_id", F.floor(F.col("row_id") / 3).cast("string"))


def test_grid(spark):
    real = rows_of(spark)
    grid = experiments.experiment_grid(real, {"made": lambda train, seed: many(spark, 60)}, [1, 2], kind="logreg", distill={"trees": 5, "depth": 5}, iterations=15)
    got = {(r.feature_set, r.variant, r.seed, r.metric): r for r in grid.collect()}
    assert len(got) == 2 * 3 * 2 * 4 and grid.columns == ["split", "feature_set", "variant", "seed", "metric", "score", "n_train", "n_holdout"]
    one = got["full", "real", 1, "macro_f1"]
    assert (one.n_train, one.n_holdout) == (120, 30)
    assert got["full", "made", 1, "macro_f1"].n_train == 180 and got["full", "distilled", 1, "macro_f1"].n_train == 4 * 120
    split = mltables.stratified_split(real, seed="split-1")
    matrix, names = build_matrix(split)
    model = models.train_model(matrix.where("not holdout"), names, "logreg", iterations=15)
    alone = {r.metric: r.score for r in models.fold_scores(models.predict_proba(model, matrix.where("holdout")).select("label", "pred")).collect()}
    assert all(abs(got["full", "real", 1, m].score - v) < 1e-9 for m, v in alone.items())
    wide = grid.where("metric = 'macro_f1'").select("feature_set", "variant", "seed", F.col("score").alias("macro_f1"))
    per = {(r.feature_set, r.variant): r for r in mltables.seed_robustness(wide, keys=("feature_set",)).collect()}
    assert set(per) == {(f, v) for f in ("full", "no-engagement") for v in ("made", "distilled")} and all(r.n == 2 for r in per.values())
    check = {(r.feature_set, r.seed): r for r in experiments.distill_check(wide, "made").collect()}
    for (f, s), r in check.items():
        a, b, base = (got[f, v, s, "macro_f1"].score for v in ("made", "distilled", "real"))
        assert r.increment == round(a - b, 6) and r.d_augmented == round(a - base, 6) and r.confirmed == (abs(a - b) < 0.02)


def test_held_out_sources_are_an_error(spark):
    real = rows_of(spark, 60)

    def leaky(train, seed):
        return many(spark, 10).withColumn("source_row_id", F.col("row_id"))

    with pytest.raises(AssertionError, match="held-out"):
        experiments.experiment_grid(real, {"leaky": leaky}, [1], kind="dummy")


def test_soft_rows(spark):
    train = spark.createDataFrame([(1, 0, 0.5), (2, 2, 1.5)], "row_id long, label int, x double")
    scored = spark.createDataFrame([(1, 0, 0.75, 0.25, 0.0), (2, 2, 0.0, 0.0, 0.0)], "row_id long, label int, p_cold double, p_warm double, p_hot double")
    got = sorted((r.row_id, r.label, r.x, round(r.weight, 6)) for r in experiments.soft_rows(train, scored).collect())
    # 8 rows: classes 0 and 2 three times, class 1 twice, balanced as n / (classes * rows of the class)
    a, b = 8 / 9, 8 / 6
    assert got == sorted([(1, 0, 0.5, round(a, 6)), (1, 0, 0.5, round(0.75 * a, 6)), (1, 1, 0.5, round(0.25 * b, 6)), (1, 2, 0.5, 0.0), (2, 0, 1.5, 0.0), (2, 1, 1.5, 0.0), (2, 2, 1.5, round(a, 6)), (2, 2, 1.5, round(a, 6))])


def test_union_and_splits(spark):
    real = rows_of(spark, 90)
    found = {r.metric: r.score for r in experiments.union_scores(real, many(spark, 60), "grouped", kind="logreg", iterations=15).collect()}
    assert set(found) == {"f1_0", "f1_1", "f1_2", "macro_f1"} and found["macro_f1"] > 0.8
    split = experiments.tagged(real, [3], "grouped")
    assert split.groupBy("group_id").agg(F.countDistinct("holdout_3").alias("n")).where("n > 1").count() == 0
    rows = [("full", v, s, x) for v, s, x in (("real", 1, 0.5), ("real", 2, 0.4), ("a", 1, 0.6), ("a", 2, 0.7), ("a", 3, 0.9))]
    table = spark.createDataFrame(rows, "feature_set string, variant string, seed int, macro_f1 double")
    both = experiments.split_comparison(table, table.where("seed = 2")).first()
    assert (both.n_seeds, both.rows_mean, both.grouped_most) == (1, 0.3, 0.3)


def test_no_table_of_rows_is_broadcast(spark, monkeypatch):
    """What a fit, a split or a check of sources reads by row id is not sent to the driver, however small its files are."""
    plans = []
    kept = experiments.stored

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def noted(df, label):
        plans.append(plan(df)) if label == "tagged" else None
        return kept(df, label)

    monkeypatch.setattr(experiments, "stored", noted)
    rows = noted(experiments.tagged(rows_of(spark), [1], "rows"), "tagged")
    cells = experiments.cells_of(rows, {}, [1], ["full"], {"trees": 2, "depth": 2})
    plans += [plan(c.train) for c in cells]
    assert len(cells) == 2 and not any("BroadcastHashJoin [row_id" in p for p in plans)
