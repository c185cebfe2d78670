"""Models over lead matrices and texts, with pyspark.ml, and experiments on them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, IDF, NGram, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from enquira.functions.text import STOPWORDS
from enquira.sources.shared import stored

from .matrix import build_matrix, with_columns
from .mltables import ENGAGEMENT, LABELS, class_weights, fold_assign, fold_groups, macro_f1_by
from .scoring import alpha_sweep, proba_to_score, rubric_score

PROBABILITIES = ["p_cold", "p_warm", "p_hot"]


class Model:
    """A fitted pipeline, its feature columns and, for the majority model, its only answer."""

    def __init__(self, names: list[str], fitted=None, majority: int | None = None):
        self.names, self.fitted, self.majority = names, fitted, majority


def with_weights(train: DataFrame) -> DataFrame:
    return train.join(F.broadcast(class_weights(train).select("label", "weight")), "label")  # one row per class


def cells_of(rows: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Rows with the same label and features (and ``keys``) as one: ``_n`` of them, and the sum of their ``weight`` if they have one.

    Matrices of flags and small numbers have few cells, whatever their rows; the loss of a regression over cells is that over rows."""
    weight = [F.sum("weight").alias("weight")] if "weight" in rows.columns else []
    return stored(rows.groupBy(*keys, "label", *names).agg(F.count("*").alias("_n"), *weight), "cells")


def _weighted(cells: DataFrame) -> DataFrame:
    """Cells with the balanced weight of their rows, unless they have weights."""
    if "weight" in cells.columns:
        return cells
    return cells.join(F.broadcast(class_weights(cells, "_n").select("label", "weight")), "label").withColumn("weight", F.col("weight") * F.col("_n"))  # one row per class


def _deviations(cells: DataFrame, names: list[str]) -> tuple[int, list[float]]:
    """Rows, and the sample deviation of every column over the rows; both passes read the cells."""
    n = F.col("_n")
    sums = cells.agg(F.sum(n).alias("rows"), *(F.sum(n * F.col(c)).alias(f"s{k}") for k, c in enumerate(names))).first()
    rows = sums["rows"] or 0
    if rows < 2 or not names:
        return rows, [0.0] * len(names)
    squares = cells.agg(*(F.sum(n * F.pow(F.col(c) - sums[f"s{k}"] / rows, 2)).alias(f"s{k}") for k, c in enumerate(names))).first()
    return rows, [(squares[f"s{k}"] / (rows - 1)) ** 0.5 for k in range(len(names))]


def train_model(train: DataFrame, names: list[str], kind: str = "rf", trees: int = 500, depth: int = 30, iterations: int = 5000) -> Model:
    """A balanced random forest ("rf", at least 3 rows in a leaf; Spark's trees end at depth 30), a balanced logistic
    regression on columns over their deviations ("logreg"), or the most frequent label ("dummy").  A ``weight`` column of the
    table replaces the balanced weights.

    The regression is fitted over ``cells_of`` the rows, which the table may be already.  The forest draws rows, so it reads them all; it
    keeps each row's node per tree from one depth to the next, so that a depth costs a step per row and not a walk from the root."""
    if kind == "dummy":
        return Model(names, majority=train.agg(F.mode("label", deterministic=True)).first()[0])
    assemble = VectorAssembler(inputCols=names, outputCol="raw_x")
    if kind == "rf":
        forest = RandomForestClassifier(
            featuresCol="raw_x", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=3, seed=42, maxMemoryInMB=1024, cacheNodeIds=True
        )
        rows = train if "weight" in train.columns else with_weights(train)
        return Model(names, Pipeline(stages=[assemble, forest]).fit(rows.select("label", "weight", *names)))
    if kind != "logreg":
        raise ValueError(f"unknown kind of model: {kind}")
    cells = train if "_n" in train.columns else cells_of(train, names)
    n, deviations = _deviations(cells, names)
    # the intercept takes up the means, and is not shrunk
    scale = ElementwiseProduct(scalingVec=Vectors.dense([1 / d if d > 0 else 0.0 for d in deviations]), inputCol="raw_x", outputCol="scaled_x")
    regression = LogisticRegression(featuresCol="scaled_x", labelCol="label", weightCol="weight", maxIter=iterations, regParam=1.0 / max(1, n))
    return Model(names, Pipeline(stages=[assemble, scale, regression]).fit(_weighted(cells).select("label", "weight", *names)))


def predict_proba(model: Model | None, matrix: DataFrame) -> DataFrame:
    """The table with pred, p_cold, p_warm and p_hot; without a model all are NULL.  Columns of the model that the table lacks are 0."""
    if model is None:
        return matrix.select("*", F.lit(None).cast("int").alias("pred"), *(F.lit(None).cast("double").alias(p) for p in PROBABILITIES))
    if model.majority is not None:
        return matrix.select("*", F.lit(model.majority).alias("pred"), *(F.lit(float(k == model.majority)).alias(p) for k, p in enumerate(PROBABILITIES)))
    found = model.fitted.transform(with_columns(matrix, model.names)).withColumn("all_p", vector_to_array("probability"))
    p = [F.coalesce(F.try_element_at("all_p", F.lit(k + 1)), F.lit(0.0)).alias(n) for k, n in enumerate(PROBABILITIES)]
    return found.select(*matrix.columns, F.col("prediction").cast("int").alias("pred"), *p)


def feature_importance(model: Model, spark: SparkSession) -> DataFrame:
    """Tree importances, or mean absolute coefficients, largest first; none for the majority model."""
    last = model.fitted.stages[-1] if model.fitted else None
    if last is None:
        values = []
    elif hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray().tolist()
    else:
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0).tolist()
    return spark.createDataFrame(list(zip(model.names, map(float, values))), "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def label_model(train: DataFrame, **options) -> Model:
    """P(label | profile) from training rows alone: a forest without the engagement columns."""
    return label_matrix_model(train, **options)[0]


def label_matrix_model(train: DataFrame, **options) -> tuple[Model, DataFrame]:
    """The label model and the matrix it was fitted on, which is written once for all passes."""
    matrix, names = build_matrix(train, drop_engagement=True)
    if any(n in ENGAGEMENT for n in names):
        raise AssertionError("engagement columns in a label model")
    matrix = stored(matrix, "matrix")
    return train_model(matrix, names, "rf", **options), matrix


def _folds(rows: DataFrame, k: int, seed: str, group: str | None) -> DataFrame:
    return fold_groups(rows, k, seed, group) if group else fold_assign(rows, k, seed)


def out_of_fold(rows: DataFrame, k: int = 5, seed: str = "fold", group: str | None = None, kind: str = "rf", drop_engagement: bool = True, **options) -> DataFrame:
    """Predictions of each fold's rows by a model of the other folds; with ``group``, rows of a group share a fold."""
    matrix, names = build_matrix(stored(_folds(rows, k, seed, group), "folds"), drop_engagement=drop_engagement)
    matrix = stored(matrix, "matrix")  # read by every fold's fit
    read = cells_of(matrix, names, "fold") if kind == "logreg" else matrix
    out = None
    for fold in range(k):
        model = train_model(read.where(F.col("fold") != fold), names, kind, **options)
        part = predict_proba(model, matrix.where(F.col("fold") == fold))
        out = part if out is None else out.unionByName(part)
    return out


def alpha_oof(rows: DataFrame, k: int = 5, group: str | None = "group_id", **options) -> DataFrame:
    """The sweep of blend weights over out-of-fold scores, by lead groups and by rows: (folds, alpha, macro_f1, accuracy,
    mae, rank, rubric_agreement).  ``rows`` holds training rows only, with row_id, label, the features and ``group``."""
    rows = stored(rows, "oof-rows")  # of a split: both kinds of folds and the rubric read the files
    ruled = rubric_score(rows).select("row_id", F.col("lead_score").alias("rule_score"), "lead_label")
    code = F.when(F.col("lead_label") == "Cold", 0).when(F.col("lead_label") == "Warm", 1).otherwise(2)
    agreement = rows.select("row_id", "label").join(ruled, "row_id").agg(F.round(F.avg((code == F.col("label")).cast("double")), 4).alias("rubric_agreement"))
    out = None
    for name, by in (("grouped", group), ("rows", None)):
        if name == "grouped" and by is None:
            continue
        scored = out_of_fold(rows, k, group=by, **options).join(ruled, "row_id")
        swept = alpha_sweep(scored.select("label", "rule_score", proba_to_score(*map(F.col, PROBABILITIES)).alias("ml_score"))).withColumn("folds", F.lit(name))
        out = swept if out is None else out.unionByName(swept)
    return out.join(F.broadcast(agreement), F.lit(True))  # one row


def interval(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean, sample deviation and normal 95 % interval of ``score`` per keys."""
    mean, std = F.avg("score"), F.coalesce(F.stddev_samp("score"), F.lit(0.0))
    half = 1.96 * std / F.sqrt(F.count("*"))
    return scores.groupBy(*keys).agg(F.count("*").alias("n"), F.round(mean, 6).alias("mean"), F.round(std, 6).alias("std"), F.round(mean - half, 6).alias("low"), F.round(mean + half, 6).alias("high"))


def fold_scores(predicted: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, score): macro-F1 and the F1 of every class of (label, pred) rows."""
    cells = predicted.groupBy(*keys, "label", "pred").agg(F.count("*").alias("n")).select(*keys, "label", "pred", "n", F.explode(F.array(*map(F.lit, LABELS))).alias("c"))
    tp = F.sum(F.when((F.col("label") == F.col("c")) & (F.col("pred") == F.col("c")), F.col("n")).otherwise(0))
    both = F.sum(F.when(F.col("label") == F.col("c"), F.col("n")).otherwise(0) + F.when(F.col("pred") == F.col("c"), F.col("n")).otherwise(0))
    per = cells.groupBy(*keys, "c").agg(F.when(both > 0, 2 * tp / both).otherwise(0.0).alias("score"))
    return per.select(*keys, F.concat(F.lit("f1_"), F.col("c").cast("string")).alias("metric"), "score").unionByName(per.groupBy(*keys).agg(F.avg("score").alias("score")).select(*keys, F.lit("macro_f1").alias("metric"), "score"))


def exp_cv(rows: DataFrame, k: int = 5, repeats: int = 1, group: str | None = None, **options) -> DataFrame:
    """Repeated k-fold scores: interval of macro-F1 and of each class; every repeat deals folds anew."""
    out = None
    for r in range(repeats):
        part = out_of_fold(rows, k, f"cv{r}", group, **options).select(F.lit(r).alias("repeat"), "fold", "label", "pred")
        out = part if out is None else out.unionByName(part)
    return interval(fold_scores(out, "repeat", "fold"), "metric")


def exp_generalization(real: DataFrame, synthetic: DataFrame, drop_engagement: bool = False, kind: str = "rf", **options) -> DataFrame:
    """(metric, real, augmented, delta): models of real training rows, alone and with synthetic rows, on the same real holdout.

    ``real`` has ``holdout``; medians come from each frame on its own.  Synthetic rows made of held-out rows (``source_row_id``) are an error."""
    real, synthetic = stored(real, "real"), stored(synthetic, "synthetic")
    if "source_row_id" in synthetic.columns and synthetic.select("source_row_id").join(real.where("holdout").select("row_id"), F.col("source_row_id") == F.col("row_id"), "left_semi").limit(1).count():
        raise AssertionError("held-out rows were used for generation")
    train, names = build_matrix(real.where("not holdout"), drop_engagement=drop_engagement)
    test, _ = build_matrix(real.where("holdout"), drop_engagement=drop_engagement)
    more, more_names = build_matrix(synthetic, drop_engagement=drop_engagement)
    every = list(dict.fromkeys([*names, *more_names]))
    train, test, more = stored(train, "matrix"), stored(test, "matrix"), stored(more, "matrix")
    union = with_columns(train, every).select("label", *every).unionByName(with_columns(more, every).select("label", *every))
    out = None
    for name, rows, columns in (("real", train, names), ("augmented", union, every)):
        part = predict_proba(train_model(rows, columns, kind, **options), with_columns(test, columns)).select(F.lit(name).alias("variant"), "label", "pred")
        out = part if out is None else out.unionByName(part)
    wide = fold_scores(out, "variant").groupBy("metric").pivot("variant", ["real", "augmented"]).agg(F.first("score"))
    return wide.select("metric", F.round("real", 6).alias("real"), F.round("augmented", 6).alias("augmented"), F.round(F.col("augmented") - F.col("real"), 6).alias("delta"))


# ---- topics of texts ----


class TopicModel:
    def __init__(self, fitted, topics: list[str]):
        self.fitted, self.topics = fitted, topics


def _text_stages() -> list:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    tokens = f"SELECT *, filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+', 0), w -> w NOT IN ({stop})) AS t1 FROM __THIS__"
    return [SQLTransformer(statement=tokens), NGram(n=2, inputCol="t1", outputCol="t2"), SQLTransformer(statement="SELECT *, concat(t1, t2) AS terms FROM __THIS__")]


def topic_terms(docs: DataFrame) -> DataFrame:
    """``docs`` with their terms, dealt over all tasks (files may have few row groups) and written once, for fits and predictions to read."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return stored(PipelineModel(_text_stages()).transform(docs.repartition(n)).drop("t1", "t2"), "topic-terms")


def term_counts(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def topic_train(docs: DataFrame, iterations: int = 1000, vocabulary: int = 1 << 18, counts: DataFrame | None = None) -> TopicModel:
    """Balanced logistic regression over TF-IDF of words and word pairs of (text, topic).  ``vocabulary`` is the most
    frequent terms that the model may have; of equally frequent ones the first in order are taken.

    Texts are split once: ``docs`` may come from ``topic_terms``, and ``counts`` may have their (term, n)."""
    docs = docs if "terms" in docs.columns else topic_terms(docs.select("text", "topic"))
    topics = sorted(r[0] for r in docs.select("topic").distinct().collect())  # a few names
    index = F.array_position(F.array(*map(F.lit, topics)), F.col("topic")).cast("int") - 1
    counts = term_counts(docs) if counts is None else counts
    chosen = stored(counts.orderBy(F.col("n").desc(), "term").limit(vocabulary).select(F.array("term").alias("terms")), "topic-vocabulary")
    known = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary).fit(chosen)
    rows = stored(known.transform(with_weights(docs.select("terms", index.alias("label")))).select("label", "weight", "tf"), "topic-tf")
    idf = IDF(inputCol="tf", outputCol="x").fit(rows)
    regression = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=iterations, regParam=1.0 / max(1, rows.count()), family="multinomial")
    return TopicModel(PipelineModel([*_text_stages(), known, idf, regression.fit(idf.transform(rows))]), topics)


def topic_predict(model: TopicModel | None, docs: DataFrame, k: int = 3, fallback: str = "General Enquiries") -> DataFrame:
    """``docs`` with predicted, confidence and top (the k best topics with their probabilities); blank texts, and all without
    a model, get the fallback and no probabilities."""
    if model is None:
        none = F.lit(None).cast("double").alias("confidence"), F.array().cast("array<struct<topic:string,p:double>>").alias("top")
        return docs.select("*", F.lit(fallback).alias("predicted"), *none)
    fitted = PipelineModel(model.fitted.stages[3:]) if "terms" in docs.columns else model.fitted  # of ``topic_terms``
    found = fitted.transform(docs).withColumn("p", vector_to_array("probability"))
    pairs = F.transform(F.arrays_zip(F.array(*map(F.lit, model.topics)).alias("topic"), F.col("p")), lambda x: F.struct((-x["p"]).alias("key"), x["topic"].alias("topic")))
    top = F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x["topic"].alias("topic"), (-x["key"]).alias("p")))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    best = F.when(blank, F.array().cast("array<struct<topic:string,p:double>>")).otherwise(top)
    out = found.select(*docs.columns, best.alias("top"))
    return out.select(*docs.columns, F.coalesce(F.try_element_at("top", F.lit(1))["topic"], F.lit(fallback)).alias("predicted"), F.try_element_at("top", F.lit(1))["p"].alias("confidence"), "top")


def fold_vocabularies(rows: DataFrame, k: int, vocabulary: int) -> tuple[CountVectorizerModel, np.ndarray]:
    """A model of all terms that one of the k folds' training rows has among its ``vocabulary`` most frequent ones, and which of them each fold has, a row
    per fold.  Terms are counted once, per fold beside one another."""
    n = [F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(k)]
    counts = stored(rows.select("fold", F.explode("terms").alias("term")).groupBy("term").agg(*n), "topic-counts")
    chosen = None
    for f in range(k):
        others = sum((F.col(f"n{g}") for g in range(k) if g != f), F.lit(0))
        part = counts.select("term", others.alias("n")).where("n > 0").orderBy(F.col("n").desc(), "term").limit(vocabulary).select("term", F.lit(1 << f).alias("of"))
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = stored(chosen.groupBy("term").agg(F.sum("of").alias("of")).select(F.array("term").alias("terms"), "term", "of"), "topic-vocabulary")
    known = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=max(1, k * vocabulary)).fit(chosen)
    of = chosen.select("term", "of").toPandas().set_index("term")["of"].reindex(known.vocabulary).to_numpy(np.int64)
    return known, np.array([(of >> f) & 1 for f in range(k)], np.float64)


def topic_folds(docs: DataFrame, k: int = 5, iterations: int = 1000, vocabulary: int = 1 << 18, at_once: int = 2) -> DataFrame:
    """(row_id, fold, topic, predicted): every text predicted by a model of the other folds, as ``topic_train`` makes it; folds are stratified by topic.

    Texts are split and their terms looked up once for all folds, over the terms of all their vocabularies: a fold's fit has a weight of 0 for
    terms that are not its own, which leaves them without a coefficient.  ``at_once`` folds are fitted at the same time; each takes the driver some
    twenty vectors of topics x terms."""
    rows = topic_terms(fold_assign(docs.withColumn("label", F.col("topic")), k, "topics").drop("label"))
    known, own = fold_vocabularies(rows, k, vocabulary)
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    # of the text only whether it is blank is asked from here on
    rows = stored(known.transform(rows).select("row_id", "fold", "topic", F.when(blank, "").otherwise("-").alias("text"), "tf"), "topic-tf")
    sizes = rows.groupBy("fold", "topic").agg(F.count("*").alias("n")).collect()  # a few names a fold
    cores = rows.sparkSession.sparkContext.defaultParallelism

    def fit(fold: int) -> TopicModel:
        topics = sorted({r.topic for r in sizes if r.fold != fold})
        n = sum(r.n for r in sizes if r.fold != fold)
        index = F.array_position(F.array(*map(F.lit, topics)), F.col("topic")).cast("int") - 1
        train = with_weights(rows.where(F.col("fold") != fold).select("tf", index.alias("label")))
        idf = IDF(inputCol="tf", outputCol="x").fit(train)
        scale = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() * own[fold]), inputCol="tf", outputCol="x")
        regression = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", maxIter=iterations, regParam=1.0 / max(1, n), family="multinomial")
        # every iteration adds up a gradient of all terms per task: no more tasks than cores, and few for few texts
        return TopicModel(PipelineModel([scale, regression.fit(scale.transform(train.coalesce(min(cores, 1 + n // 5000))))]), topics)

    with ThreadPoolExecutor(at_once) as pool:
        fitted = list(pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(k)))
    out = None
    for fold, model in enumerate(fitted):
        part = topic_predict(model, rows.where(F.col("fold") == fold)).select("row_id", "fold", "topic", "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def topic_report(predicted: DataFrame) -> DataFrame:
    """(fold, topic, support, f1, macro_f1, mean_macro_f1, std_macro_f1) of (fold, topic, predicted) rows."""
    cells = predicted.groupBy("fold", "topic", "predicted").agg(F.count("*").alias("n"))
    a = cells.select("fold", F.col("topic").alias("c"), "n", (F.col("topic") == F.col("predicted")).alias("hit"), F.lit(True).alias("own"))
    b = cells.select("fold", F.col("predicted").alias("c"), "n", F.lit(False).alias("hit"), F.lit(False).alias("own"))
    per = a.unionByName(b).groupBy("fold", "c").agg(F.sum("n").alias("both"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("support"))
    f1 = F.when(F.col("both") > 0, 2 * F.col("tp") / F.col("both")).otherwise(0.0)
    rows = per.select("fold", F.col("c").alias("topic"), "support", f1.alias("f1")).withColumn("macro_f1", F.avg("f1").over(Window.partitionBy("fold")))
    folds = rows.select("fold", "macro_f1").distinct().agg(F.round(F.avg("macro_f1"), 6).alias("mean_macro_f1"), F.round(F.stddev_pop("macro_f1"), 6).alias("std_macro_f1"))
    return rows.select("fold", "topic", "support", F.round("f1", 6).alias("f1"), F.round("macro_f1", 6).alias("macro_f1")).join(F.broadcast(folds), F.lit(True))  # one row
