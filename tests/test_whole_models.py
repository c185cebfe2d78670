"""Registered model queries fit the sizes of the operators' defaults, which are the reference's."""

from __future__ import annotations

import pytest

import __spark_entry__
from enquira.operators import models

DATA = "/root/testdata/sf0.001"


def sizes_of(spark, monkeypatch, name, kind, size):
    """What ``size`` is in every fit of the query, by the class of pyspark.ml that it calls."""
    found, made = [], getattr(models, kind)
    monkeypatch.setattr(models, kind, lambda **options: found.append(options[size]) or made(**options))
    rows = __spark_entry__.queries()[name](spark, DATA).count()
    return rows, found


@pytest.mark.parametrize(("name", "fits"), [("exp_generalization", 2), ("predict_proba", 1)])
def test_regressions_may_converge(spark, monkeypatch, name, fits):
    rows, found = sizes_of(spark, monkeypatch, name, "LogisticRegression", "maxIter")
    assert rows and found == [5000] * fits


def test_topics_are_fitted_to_their_end(spark, monkeypatch):
    rows, found = sizes_of(spark, monkeypatch, "topic_cv", "LogisticRegression", "maxIter")
    assert rows and found == [1000] * 5


def test_folds_share_their_terms(spark, monkeypatch):
    """Terms are looked up once for all folds, and the predictions are those of a model of each fold's own vocabulary."""
    words = ["visa passport permit", "tuition price cost", "room flat housing"]
    data = [(i, f"{words[i % 3]} {words[i * 7 % 3]} extra{i % 11} only{i}" if i % 13 else " ", "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(data, "row_id long, text string, topic string")
    looked, made = [], models.CountVectorizer
    monkeypatch.setattr(models, "CountVectorizer", lambda **options: looked.append(options) or made(**options))
    got = {r.row_id: (r.fold, r.predicted) for r in models.topic_folds(docs, k=3, iterations=30, vocabulary=20).collect()}
    assert len(looked) == 1 and len(got) == 60
    held = spark.createDataFrame([(i, f) for i, (f, _) in got.items()], "row_id long, fold int")
    terms = models.topic_terms(docs.join(held, "row_id"))
    for fold in range(3):
        model = models.topic_train(terms.where(f"fold <> {fold}"), iterations=30, vocabulary=20)
        want = {r.row_id: (fold, r.predicted) for r in models.topic_predict(model, terms.where(f"fold = {fold}")).collect()}
        assert want == {i: x for i, x in got.items() if x[0] == fold}


def test_forest_has_all_trees(spark, monkeypatch):
    rows, found = sizes_of(spark, monkeypatch, "train_model", "RandomForestClassifier", "numTrees")
    assert rows == 9 and found == [500]
