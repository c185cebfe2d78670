"""Queries over matrices and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from enquira.operators import experiments as N
from enquira.operators import matrix as X
from enquira.operators import mltables as M
from enquira.operators import models as P
from enquira.operators import scoring as R
from enquira.operators import sessions as S
from enquira.sources.shared import stored

from .adapters import table, view
from .entries import query
from .q_evaluation import weights_sql
from .q_mltables import _ALIGN, _PRED, _TABLE, ALL, _h, _text, aligned, grouped, leads
from .q_sessions import _EVID, turns

_VALUES = {c: [*v, *(["unknown"] if c != "qual_level" else [])] for c, v in X.KNOWN_VALUES.items()}
_FLAGS = ", ".join(f"({_text(c)} = '{v}')::INT::DOUBLE AS {c}_{v}" for c in M.CATEGORICAL for v in _VALUES[c])
_NUMBERS = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM al), 0)::DOUBLE AS {c}" for c in M.NUMERIC)


@query("build_matrix", f"SELECT * FROM (WITH al AS MATERIALIZED ({_ALIGN}) SELECT label, source, english_band, {_NUMBERS}, {_FLAGS} FROM al)", ALL)
def build_matrix(spark, d):
    return X.build_matrix(aligned(spark, d))[0]


_SHOWN = {"has_course", "has_intake", "has_english_test", "funding_method_present"}
_SEEN = {"message_count": "f.message_count", "session_word_count": "f.session_word_count", "visa_intent_mentioned": "e.visa_intent_mentioned", "has_english_test": "e.has_english_test", "funding_method_present": "e.funding_method_present", "returning_session": "0"}
_LIVE_NUMBERS = ", ".join(f"coalesce({_SEEN.get(c, 'NULL')}, (SELECT number FROM t WHERE key = 'median_{c}'))::DOUBLE AS {c}" for c in M.NUMERIC)
_LIVE_FLAGS = ", ".join(f"(coalesce({f'e.{c}::VARCHAR' if c in _SHOWN else 'NULL'}, (SELECT text FROM t WHERE key = 'mode_{c}')) = '{v}')::INT::DOUBLE AS {c}_{v}" for c in M.CATEGORICAL for v in X.KNOWN_VALUES[c])
_FEATURES = "SELECT session_id, count(*) AS message_count, CAST(sum(len(regexp_extract_all(user_msg, '\\S+'))) AS BIGINT) AS session_word_count FROM a_turns GROUP BY session_id"


@query("inference_matrix", f"SELECT * FROM (WITH t AS MATERIALIZED ({_TABLE}) SELECT e.session_id, {_LIVE_NUMBERS}, {_LIVE_FLAGS} FROM ({_EVID}) e JOIN ({_FEATURES}) f ON e.session_id = f.session_id)", ("a_turns", *ALL))
def inference_matrix(spark, d):
    """Sessions as the model's inputs: evidence, then engagement, then the training table."""
    evidence = S.rubric_evidence(turns(spark, d)).drop("english_band").withColumnRenamed("visa_intent_mentioned", "flags_visa_intent_mentioned")
    engaged = S.session_features(turns(spark, d)).select("session_id", *(F.col(c).alias(f"engagement_{c}") for c in ("message_count", "session_word_count", "returning_session")))
    return X.inference_matrix(evidence.join(engaged, "session_id"), *X.imputation_values(M.imputation_table(aligned(spark, d))))


#: Sizes of the models of the queries that name them; the operators' own defaults, which the others fit, are 500 trees and 5000 iterations.
TREES, ITERATIONS = 30, 20


def _known(spark, d):
    rows = grouped(spark, d).where("label >= 0")
    return rows.select("row_id", "group_id", "label", "source", *dict.fromkeys([*M.FEATURES]), *(F.lit(None).cast("double").alias(c) for c in M.ENGAGEMENT))


def _matrix(spark, d):
    # written: quantiles, weights, every pass of a fit and predictions read the files, not the views and the split again
    rows, names = X.build_matrix(stored(M.stratified_split(_known(spark, d)), "split"), drop_engagement=True)
    rows = stored(rows, "matrix")
    return rows.where("not holdout"), rows.where("holdout"), names


@query("train_model")
def train_model(spark, d):
    """Holdout reports of the forest, the regression and the majority model."""
    train, held, names = _matrix(spark, d)
    out = None
    for kind in ("rf", "logreg", "dummy"):
        model = P.train_model(train, names, kind)
        part = M.classification_report(P.predict_proba(model, held).select("label", "pred")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("predict_proba")
def predict_proba(spark, d):
    """Probabilities of all labelled rows by the regression."""
    train, held, names = _matrix(spark, d)
    found = P.predict_proba(P.train_model(train, names, "logreg"), train.unionByName(held))
    return found.select("row_id", "holdout", "pred", *P.PROBABILITIES)


@query("feature_importance")
def feature_importance(spark, d):
    train, _, names = _matrix(spark, d)
    return P.feature_importance(P.train_model(train, names, trees=TREES), spark)


@query("alpha_oof")
def alpha_oof(spark, d):
    """Blend weights over out-of-fold scores of the training rows of a lead-grouped split."""
    train = M.grouped_split(_known(spark, d)).where("not holdout")
    return P.alpha_oof(train, kind="logreg", iterations=ITERATIONS)


@query("exp_cv")
def exp_cv(spark, d):
    return P.exp_cv(_known(spark, d), kind="logreg", repeats=1, group="group_id", iterations=ITERATIONS)


@query("exp_generalization")
def exp_generalization(spark, d):
    synthetic = M.align_schema(view(spark, d, "a_sessions").withColumn("label", F.col("label").cast("int")))
    return P.exp_generalization(M.stratified_split(_known(spark, d)), synthetic, kind="logreg")


@query("exp_grid")
def exp_grid(spark, d):
    """Real, augmented and distilled models over two feature sets and two seeds of a lead-grouped split."""

    def drawn(train, seed):
        pool = train.select(F.col("row_id").alias("id"), "label", *((F.col("label") == k).cast("double").alias(w) for k, w in enumerate(("w_cold", "w_warm", "w_hot"))))
        rows = M.bootstrap_with_sampled_labels(pool, 400, f"grid-{seed}").select("source_row_id", F.col("label").alias("drawn"))
        return rows.join(train, F.col("source_row_id") == F.col("row_id")).select("source_row_id", F.col("drawn").alias("label"), *(c for c in train.columns if c not in ("row_id", "label", "group_id")))

    return N.experiment_grid(_known(spark, d), {"redrawn": drawn}, [1, 7], kind="logreg", split="grouped", distill={"trees": 10, "depth": 8}, iterations=ITERATIONS)


@query("label_model")
def label_model(spark, d):
    """P(label | profile) of every distinct profile, by a model of training rows."""
    rows = stored(M.stratified_split(_known(spark, d)), "split")
    model = P.label_model(rows.where("not holdout"), trees=TREES)
    profiles = rows.select(*M.FEATURES).distinct().withColumn("label", F.lit(0))
    matrix, _ = X.build_matrix(profiles.select("*", *(F.lit(None).cast("double").alias(c) for c in M.ENGAGEMENT)), drop_engagement=True)
    return P.predict_proba(model, matrix).drop("label")


@query("generated_agreement")
def generated_agreement(spark, d):
    """Rows drawn from the training rows with labels of the label model, against the model, the rubric and their source."""
    train = stored(M.stratified_split(_known(spark, d)), "split").where("not holdout")
    model, matrix = P.label_matrix_model(train, trees=TREES)
    scored = stored(P.predict_proba(model, matrix).select("row_id", "label", "pred", *P.PROBABILITIES), "scored")
    pool = scored.select(F.col("row_id").alias("id"), "label", F.col("p_cold").alias("w_cold"), F.col("p_warm").alias("w_warm"), F.col("p_hot").alias("w_hot"))
    drawn = M.bootstrap_with_sampled_labels(pool, train.count())
    ruled = R.rubric_score(train).select("row_id", "lead_label")
    source = scored.select("row_id", "pred", *P.PROBABILITIES).join(ruled, "row_id")
    return M.generated_agreement(drawn.join(source, F.col("source_row_id") == F.col("row_id")))


_B = 100
_DRAWS = f"SELECT g.b, {_h('f1', "g.b || ':' || j.j")} % (SELECT count(*) FROM a_px) + 1 AS i FROM (SELECT unnest(range({_B})) AS b) g CROSS JOIN (SELECT unnest(range((SELECT count(*) FROM a_px))) AS j) j"
_DRAWN = f"SELECT b, id FROM ({_DRAWS}) d JOIN (SELECT id, row_number() OVER (ORDER BY {_h('number', 'id')}, id) AS i FROM a_px) n ON d.i = n.i UNION ALL SELECT -1, id FROM a_px"
_PIDS = " UNION ALL ".join(f"SELECT '{v}' AS variant, id, label, pred_{v} AS pred FROM a_px" for v in ("real", "v1", "v2"))
_MARKS = f"""SELECT b, variant, avg(f1) AS macro_f1, max(CASE WHEN c = 2 THEN f1 END) AS hot_f1 FROM (SELECT b, variant, c, CASE WHEN both_ > 0 THEN 2 * tp::DOUBLE / both_ ELSE 0 END AS f1 FROM (
  SELECT b, variant, c, sum(n * (label = c AND pred = c)::INT) AS tp, sum(n * (label = c)::INT) + sum(n * (pred = c)::INT) AS both_ FROM (
    SELECT d.b, p.variant, p.label, p.pred, count(*) AS n FROM ({_DRAWN}) d JOIN ({_PIDS}) p ON d.id = p.id GROUP BY ALL) CROSS JOIN (VALUES (0), (1), (2)) v(c) GROUP BY b, variant, c)) GROUP BY b, variant"""
_LONG = f"""SELECT m.b, m.variant, x.metric, CASE x.metric WHEN 'macro_f1' THEN m.macro_f1 WHEN 'hot_f1' THEN m.hot_f1 WHEN 'delta_macro_f1' THEN m.macro_f1 - r.macro_f1 ELSE m.hot_f1 - r.hot_f1 END AS v
  FROM marks m JOIN marks r ON m.b = r.b AND r.variant = 'real' CROSS JOIN (VALUES ('macro_f1'), ('hot_f1'), ('delta_macro_f1'), ('delta_hot_f1')) x(metric) WHERE NOT (m.variant = 'real' AND starts_with(x.metric, 'delta'))"""


def _f1_intervals(marks: str) -> str:
    return f"""SELECT * FROM (WITH marks AS MATERIALIZED ({marks}) SELECT *, starts_with(metric, 'delta') AND (low > 0 OR high < 0) AS significant FROM (SELECT variant, metric, round(max(CASE WHEN b < 0 THEN v END), 6) AS point, round(avg(v) FILTER (WHERE b >= 0), 6) AS mean,
      round(quantile_cont(v, 0.025) FILTER (WHERE b >= 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (WHERE b >= 0), 6) AS high FROM ({_LONG}) GROUP BY variant, metric))"""


def _variants(spark, d):
    long = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(f"pred_{v}").alias("pred")) for v in ("real", "v1", "v2"))))
    return view(spark, d, "a_px").select("id", "label", long.alias("x")).select("id", "label", "x.variant", "x.pred")


@query("bootstrap_f1_ci_rows", _f1_intervals(_MARKS), ("a_px",))
def bootstrap_f1_ci_rows(spark, d):
    return M.bootstrap_f1_ci(_variants(spark, d), _B)


_CELL = "label || ':real=' || pred_real || ':v1=' || pred_v1 || ':v2=' || pred_v2"
_CELLS = f"SELECT {_CELL} AS cell, any_value(label) AS label, any_value(pred_real) AS real, any_value(pred_v1) AS v1, any_value(pred_v2) AS v2, count(*) AS n FROM a_px GROUP BY 1"
_PREDS = " UNION ALL ".join(f"SELECT cell, '{v}' AS variant, label, {v} AS pred FROM cells" for v in ("real", "v1", "v2"))
_CELL_MARKS = f"""SELECT b, variant, avg(f1) AS macro_f1, max(CASE WHEN c = 2 THEN f1 END) AS hot_f1 FROM (SELECT b, variant, c, CASE WHEN both_ > 0 THEN 2 * tp::DOUBLE / both_ ELSE 0 END AS f1 FROM (
  SELECT b, variant, c, sum(n * (label = c AND pred = c)::INT) AS tp, sum(n * (label = c)::INT) + sum(n * (pred = c)::INT) AS both_ FROM (
    WITH cells AS MATERIALIZED ({_CELLS}) SELECT d.b, p.variant, p.label, p.pred, sum(d.w) AS n FROM (SELECT r AS b, cell, w FROM ({weights_sql('SELECT * FROM cells', 1000, 'f1')}) UNION ALL SELECT -1, cell, n FROM cells) d JOIN ({_PREDS}) p ON d.cell = p.cell GROUP BY ALL)
  CROSS JOIN (VALUES (0), (1), (2)) v(c) GROUP BY b, variant, c)) GROUP BY b, variant"""


@query("bootstrap_f1_ci", _f1_intervals(_CELL_MARKS), ("a_px",))
def bootstrap_f1_ci(spark, d):
    """1,000 resamples of the cells of equal label and predictions."""
    return M.bootstrap_f1_ci(_variants(spark, d), 1000, mode="cells")


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("topic")).where("topic is not null")


@query("topic_train")
def topic_train(spark, d):
    """Terms that the model knows, documents and topics."""
    model = P.topic_train(_docs(spark, d), iterations=20)
    return spark.range(1).select(F.lit(len(model.fitted.stages[3].vocabulary)).alias("n_terms"), F.lit(len(model.topics)).alias("n_topics"))


@query("topic_predict")
def topic_predict(spark, d):
    """All documents, by a model of four fifths of them."""
    docs = P.topic_terms(_docs(spark, d))
    held = F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0
    return P.topic_predict(P.topic_train(docs.where(~held), iterations=20), docs).select(F.col("row_id").alias("doc_id"), held.alias("held_out"), "topic", "predicted", "confidence", F.to_json("top").alias("top"))


@query("topic_cv")
def topic_cv(spark, d):
    return P.topic_report(P.topic_folds(_docs(spark, d)))
