"""Resampled rows are counted by cell right after they meet their draws."""

from __future__ import annotations

from enquira.operators import mltables as M


def test_draws_are_dealt_once(spark):
    rows = [(i, i % 3, v, (i + k * (i % 2)) % 3) for i in range(90) for k, v in enumerate(("real", "v1"))]
    pred = spark.createDataFrame(rows, "id long, label int, variant string, pred int")
    found = M._f1_rows(pred, 20, "f1")
    marks = {(r.b, r.variant): r.macro_f1 for r in found.collect()}
    assert len(marks) == 42 and all(marks[b, "real"] == 1.0 for b in range(-1, 20)) and marks[-1, "v1"] < 1.0
    # draws are not counted per row: no aggregate has their number as a key beside the resample
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [b#" in plan and not any("Aggregate [b#" in x and ", i#" in x.split("]")[0] for x in plan.splitlines())
