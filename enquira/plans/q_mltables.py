"""Queries over training tables and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from enquira.operators import experiments as X
from enquira.operators import mltables as M
from enquira.operators import scoring as S

from .adapters import table, view
from .entries import query
from .q_scoring import _SCORED

LEADS = ("a_leads",)


def leads(spark, d):
    return view(spark, d, "a_leads")


_BLANKED = "CASE WHEN row_id % 9 = 0 THEN '' WHEN row_id % 9 = 1 THEN crm_id || '.0' WHEN row_id % 9 = 2 THEN 'nan' ELSE crm_id END"
_GROUP = f"SELECT row_id, label, CASE WHEN c IN ('', 'nan') THEN '__row' || row_id ELSE regexp_replace(c, '\\.0+$', '') END AS group_id FROM (SELECT row_id, label, {_BLANKED} AS c FROM a_leads)"


def grouped(spark, d):
    rows = leads(spark, d).withColumn("crm_id", F.expr(_BLANKED))
    return M.lead_group_id(rows)


@query("lead_group_id", f"SELECT row_id, group_id FROM ({_GROUP})", LEADS)
def lead_group_id(spark, d):
    return grouped(spark, d).select("row_id", "group_id")


_FIXED = list(dict.fromkeys([*M.FEATURES, *M.NUMERIC]))
_SESSION_HAS = {"message_count", "session_word_count", "visa_intent_mentioned", "funding_clarity", "qual_level"}
_ALIGN = (
    "SELECT label, source, " + ", ".join(f"CAST({c if c in M.FEATURES else 'NULL'} AS DOUBLE) AS {c}" for c in _FIXED) + " FROM a_leads WHERE label IN (0, 1, 2) UNION ALL "
    "SELECT label, source, " + ", ".join(f"CAST({c if c in _SESSION_HAS else 'NULL'} AS DOUBLE) AS {c}" for c in _FIXED) + " FROM a_sessions WHERE label IN (0, 1, 2)"
)
ALL = ("a_leads", "a_sessions")


def aligned(spark, d):
    out = M.align_schema(leads(spark, d), view(spark, d, "a_sessions"))
    return out.select("label", "source", *(F.col(c).cast("double").alias(c) for c in _FIXED))


@query("align_schema", _ALIGN, ALL)
def align_schema(spark, d):
    return aligned(spark, d)


def _text(c: str) -> str:
    return f"coalesce(CAST(CAST({c} AS BIGINT) AS VARCHAR), 'unknown')"


_MODES = {c: f"(SELECT v FROM (SELECT {_text(c)} AS v, count(*) AS n FROM ({_ALIGN}) GROUP BY v ORDER BY n DESC, v LIMIT 1))" for c in M.CATEGORICAL}
_REPORT = (
    "SELECT count(*) AS n, " + ", ".join(f"count_if(label = {k}) AS label_{k}" for k in M.LABELS) + ", "
    + ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS median_{c}" for c in M.NUMERIC) + ", " + ", ".join(f"{q} AS mode_{c}" for c, q in _MODES.items()) + f" FROM ({_ALIGN})"
)


@query("schema_report", _REPORT, ALL)
def schema_report(spark, d):
    return M.schema_report(aligned(spark, d))


_PARTS = " UNION ALL ".join(
    [f"SELECT 'median_{c}' AS key, coalesce(median_{c}, 0)::DOUBLE AS number, NULL::VARCHAR AS text FROM report" for c in M.NUMERIC]
    + [f"SELECT 'mode_{c}', NULL, mode_{c} FROM report" for c in M.CATEGORICAL] + [f"SELECT 'label_{k}', label_{k}, NULL FROM report" for k in M.LABELS]
    + ["SELECT 'rows_' || source, count(*), NULL FROM al GROUP BY source"]
)
_TABLE = f"SELECT * FROM (WITH al AS MATERIALIZED ({_ALIGN}), report AS MATERIALIZED ({_REPORT.replace(f'({_ALIGN})', 'al')}) {_PARTS})"


@query("imputation_table", _TABLE, ALL)
def imputation_table(spark, d):
    return M.imputation_table(aligned(spark, d))


_HALVES = [f"SELECT key, coalesce(text, CAST(number AS VARCHAR)) AS v FROM ({_TABLE.replace(_ALIGN, part)})" for part in (f"SELECT * FROM ({_ALIGN}) WHERE source = 'real'", _ALIGN)]


@query("imputation_drift", f"SELECT key, a.v AS stored, b.v AS recomputed FROM ({_HALVES[0]}) a FULL JOIN ({_HALVES[1]}) b USING (key) WHERE a.v IS DISTINCT FROM b.v", ALL)
def imputation_drift(spark, d):
    rows = aligned(spark, d)
    return M.imputation_drift(M.imputation_table(rows.where("source = 'real'")), M.imputation_table(rows))


def _h(seed: str, c: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {c}), 1, 8) AS BIGINT)"


def _ranked(seed: str) -> str:
    return f"SELECT row_id, label, crm_id, row_number() OVER (PARTITION BY label ORDER BY {_h(seed, 'row_id')}, row_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM a_leads"


@query("stratified_split", f"SELECT row_id, rank <= floor(n * CAST(0.2 AS DOUBLE) + 0.5) AS holdout FROM ({_ranked('split')})", LEADS)
def stratified_split(spark, d):
    return M.stratified_split(leads(spark, d)).select("row_id", "holdout")


@query("fold_assign", f"SELECT row_id, CAST((rank - 1) % 5 AS INT) AS fold FROM ({_ranked('fold')})", LEADS)
def fold_assign(spark, d):
    return M.fold_assign(leads(spark, d)).select("row_id", "fold")


_MAJOR = f"SELECT group_id, label AS major, size FROM (SELECT group_id, label, sum(n) OVER (PARTITION BY group_id) AS size, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, label) AS rn FROM (SELECT group_id, label, count(*) AS n FROM ({_GROUP}) GROUP BY group_id, label)) WHERE rn = 1"
_GSPLIT = f"""SELECT g.row_id, g.group_id, h.holdout FROM ({_GROUP}) g JOIN (SELECT group_id, coalesce(sum(size) OVER (PARTITION BY major ORDER BY {_h('group', 'group_id')}, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  < sum(size) OVER (PARTITION BY major) * CAST(0.2 AS DOUBLE) AS holdout FROM ({_MAJOR})) h ON g.group_id = h.group_id"""


@query("grouped_split", f"SELECT row_id, holdout FROM ({_GSPLIT})", LEADS)
def grouped_split(spark, d):
    return M.grouped_split(grouped(spark, d)).select("row_id", "holdout")


_ROWSPLIT = f"SELECT r.row_id, g.group_id, r.rank <= floor(r.n * CAST(0.2 AS DOUBLE) + 0.5) AS holdout FROM ({_ranked('split')}) r JOIN ({_GROUP}) g ON r.row_id = g.row_id"


@query(
    "split_overlap",
    f"SELECT count(*) AS holdout_rows, count_if(group_id IN (SELECT group_id FROM ({_ROWSPLIT}) WHERE NOT holdout)) AS with_sibling, round(count_if(group_id IN (SELECT group_id FROM ({_ROWSPLIT}) WHERE NOT holdout))::DOUBLE / count(*), 6) AS share FROM ({_ROWSPLIT}) WHERE holdout",
    LEADS,
)
def split_overlap(spark, d):
    return M.split_overlap(M.stratified_split(grouped(spark, d)))


@query(
    "leakage_report",
    f"""SELECT (SELECT count(*) FROM a_leads WHERE row_id % 7 = 0) AS used_rows, (SELECT count(*) FROM ({_ROWSPLIT}) WHERE holdout AND row_id % 7 = 0) AS leaked_rows,
      (SELECT string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY row_id) FROM (SELECT row_id FROM ({_ROWSPLIT}) WHERE holdout AND row_id % 7 = 0 ORDER BY row_id LIMIT 25)) AS ids""",
    LEADS,
)
def leakage_report(spark, d):
    found = M.leakage_report(M.stratified_split(grouped(spark, d)), leads(spark, d).where("row_id % 7 = 0"))
    return found.select("used_rows", "leaked_rows", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("class_weights", "SELECT label, n, round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 6) AS weight FROM (SELECT label, count(*) AS n FROM a_leads WHERE label >= 0 GROUP BY label)", LEADS)
def class_weights(spark, d):
    return M.class_weights(leads(spark, d).where("label >= 0"))


_CR = """SELECT c, count_if(label = c) AS support, count_if(label = c AND pred_real = 0) AS as_0, count_if(label = c AND pred_real = 1) AS as_1, count_if(label = c AND pred_real = 2) AS as_2,
  round(CASE WHEN count_if(pred_real = c) > 0 THEN count_if(label = c AND pred_real = c)::DOUBLE / count_if(pred_real = c) ELSE 0 END, 6) AS precision, round(CASE WHEN count_if(label = c) > 0 THEN count_if(label = c AND pred_real = c)::DOUBLE / count_if(label = c) ELSE 0 END, 6) AS recall,
  round(CASE WHEN count_if(label = c) + count_if(pred_real = c) > 0 THEN 2 * count_if(label = c AND pred_real = c)::DOUBLE / (count_if(label = c) + count_if(pred_real = c)) ELSE 0 END, 6) AS f1 FROM a_px CROSS JOIN (VALUES (0), (1), (2)) v(c) GROUP BY c"""


@query("classification_report", f"SELECT *, round(avg(f1) OVER (), 6) AS macro_f1 FROM ({_CR})", ("a_px",))
def classification_report(spark, d):
    return M.classification_report(view(spark, d, "a_px").select("label", F.col("pred_real").alias("pred")))


_SOFT = " UNION ALL ".join(f"SELECT id, {k} AS label, round(CASE WHEN w_cold + w_warm + w_hot > 0 THEN {c} / (w_cold + w_warm + w_hot) ELSE (label = {k})::INT::DOUBLE END, 9) AS weight, 'soft' AS kind FROM a_px" for k, c in enumerate(("w_cold", "w_warm", "w_hot")))


@query("soft_label_expand", f"SELECT id, label, CAST(1 AS DOUBLE) AS weight, 'hard' AS kind FROM a_px UNION ALL {_SOFT}", ("a_px",))
def soft_label_expand(spark, d):
    return M.soft_label_expand(view(spark, d, "a_px"))


@query(
    "label_agreement",
    f"SELECT coalesce(label, -1) AS label, count(*) AS n, round(avg(ok), 6) AS agreement FROM (SELECT l.label, (CASE s.lead_label WHEN 'Cold' THEN 0 WHEN 'Warm' THEN 1 ELSE 2 END = l.label)::INT::DOUBLE AS ok FROM a_leads l JOIN ({_SCORED}) s ON l.row_id = s.row_id WHERE l.label >= 0) GROUP BY ROLLUP (label)",
    LEADS,
)
def label_agreement(spark, d):
    return M.label_agreement(S.rubric_score(leads(spark, d)))


@query(
    "bootstrap_with_sampled_labels",
    f"""SELECT draw, id AS source_row_id, label AS source_label, CASE WHEN t <= 0 THEN label WHEN u < w_cold / t THEN 0 WHEN u < (w_cold + w_warm) / t THEN 1 ELSE 2 END AS label FROM (
      SELECT d.draw, p.id, p.label, w_cold, w_warm, w_cold + w_warm + w_hot AS t, {_h('boot-label', 'd.draw')}::DOUBLE / 4294967296 AS u
      FROM (SELECT i AS draw, {_h('boot', 'i')} % (SELECT count(*) FROM a_px) + 1 AS rank FROM range(2000) r(i)) d
      JOIN (SELECT *, row_number() OVER (ORDER BY {_h('number', 'id')}, id) AS rank FROM a_px) p ON d.rank = p.rank)""",
    ("a_px",),
)
def bootstrap_with_sampled_labels(spark, d):
    return M.bootstrap_with_sampled_labels(view(spark, d, "a_px"), 2000)


_VARIANTS = ("real", "v1", "v2")
_PRED = " UNION ALL ".join(f"SELECT '{v}' AS variant, seed, label, pred_{v} AS pred FROM a_px" for v in _VARIANTS)
_F1S = f"""SELECT variant, seed, round(avg(CASE WHEN b > 0 THEN 2 * tp::DOUBLE / b ELSE 0 END), 9) AS macro_f1 FROM (SELECT variant, seed, c, count_if(label = c AND pred = c) AS tp, count_if(label = c) + count_if(pred = c) AS b
  FROM ({_PRED}) CROSS JOIN (VALUES (0), (1), (2)) v(c) GROUP BY variant, seed, c) GROUP BY variant, seed"""


def _f1s(spark, d):
    rows = view(spark, d, "a_px")
    long = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(f"pred_{v}").alias("pred")) for v in _VARIANTS)))
    return M.macro_f1_by(rows.select("seed", "label", long.alias("x")).select("seed", "label", "x.variant", "x.pred"), "variant", "seed")


@query(
    "seed_robustness",
    f"""SELECT *, CASE WHEN least > 0.02 THEN 'ROBUST' WHEN least > 0 AND most > 0.15 AND least < 0.05 THEN 'PARTIALLY' WHEN least <= 0 THEN 'SEED-SENSITIVE' ELSE 'INCONCLUSIVE' END AS tier FROM (
      SELECT a.variant, round(avg(a.macro_f1 - b.macro_f1), 6) AS mean, round(min(a.macro_f1 - b.macro_f1), 6) AS least, round(max(a.macro_f1 - b.macro_f1), 6) AS most, count(*) AS n
      FROM ({_F1S}) a JOIN ({_F1S}) b ON a.seed = b.seed AND b.variant = 'real' WHERE a.variant <> 'real' GROUP BY a.variant)""",
    ("a_px",),
)
def seed_robustness(spark, d):
    return M.seed_robustness(_f1s(spark, d))


#: The predictions as results of two feature sets and two kinds of split.
_SETS = "CASE WHEN id % 2 = 0 THEN 'full' ELSE 'no-engagement' END"
_GRID_PRED = " UNION ALL ".join(f"SELECT '{v}' AS variant, seed, label, pred_{v} AS pred, {_SETS} AS feature_set, CASE WHEN id % 4 < 2 THEN 'rows' ELSE 'grouped' END AS split FROM a_px" for v in _VARIANTS)


def _grid_f1(*keys: str) -> str:
    by = ", ".join((*keys, "variant", "seed"))
    return f"""SELECT {by}, round(avg(CASE WHEN b > 0 THEN 2 * tp::DOUBLE / b ELSE 0 END), 9) AS macro_f1 FROM (SELECT {by}, c, count_if(label = c AND pred = c) AS tp, count_if(label = c) + count_if(pred = c) AS b
      FROM ({_GRID_PRED}) CROSS JOIN (VALUES (0), (1), (2)) v(c) GROUP BY {by}, c) GROUP BY {by}"""


def _grid_deltas(*keys: str) -> str:
    same = " AND ".join(f"a.{k} = b.{k}" for k in (*keys, "seed"))
    return f"SELECT {', '.join(f'a.{k}' for k in keys)}, a.variant, a.seed, a.macro_f1 - b.macro_f1 AS delta FROM ({_grid_f1(*keys)}) a JOIN ({_grid_f1(*keys)}) b ON {same} AND b.variant = 'real' WHERE a.variant <> 'real'"


def _grid(spark, d, *keys: str):
    rows = view(spark, d, "a_px").withColumn("feature_set", F.expr(_SETS)).withColumn("split", F.expr("CASE WHEN id % 4 < 2 THEN 'rows' ELSE 'grouped' END"))
    long = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(f"pred_{v}").alias("pred")) for v in _VARIANTS)))
    return M.macro_f1_by(rows.select("seed", "label", *keys, long.alias("x")).select("seed", "label", *keys, "x.variant", "x.pred"), *keys, "variant", "seed")


@query(
    "seed_robustness_by_features",
    f"""SELECT *, CASE WHEN least > 0.02 THEN 'ROBUST' WHEN least > 0 AND most > 0.15 AND least < 0.05 THEN 'PARTIALLY' WHEN least <= 0 THEN 'SEED-SENSITIVE' ELSE 'INCONCLUSIVE' END AS tier FROM (
      SELECT feature_set, variant, round(avg(delta), 6) AS mean, round(min(delta), 6) AS least, round(max(delta), 6) AS most, count(*) AS n FROM ({_grid_deltas('feature_set')}) GROUP BY feature_set, variant)""",
    ("a_px",),
)
def seed_robustness_by_features(spark, d):
    return M.seed_robustness(_grid(spark, d, "feature_set"), keys=("feature_set",))


@query(
    "distill_check",
    f"""SELECT feature_set, seed, round(a, 6) AS d_augmented, round(b, 6) AS d_distilled, round(a - b, 6) AS increment, coalesce(abs(a - b) < 0.02, false) AS confirmed FROM (
      SELECT feature_set, seed, max(CASE WHEN variant = 'v2' THEN delta END) AS a, max(CASE WHEN variant = 'v1' THEN delta END) AS b FROM ({_grid_deltas('feature_set')}) GROUP BY feature_set, seed)""",
    ("a_px",),
)
def distill_check(spark, d):
    return X.distill_check(_grid(spark, d, "feature_set"), "v2", "v1")


@query(
    "split_comparison",
    "SELECT r.feature_set, r.variant, count(*) AS n_seeds, " + ", ".join(f"round({f}({t}.delta), 6) AS {c}_{n}" for t, c in (("r", "rows"), ("g", "grouped")) for n, f in (("mean", "avg"), ("least", "min"), ("most", "max")))
    + f" FROM (SELECT * FROM ({_grid_deltas('feature_set', 'split')}) WHERE split = 'rows') r JOIN (SELECT * FROM ({_grid_deltas('feature_set', 'split')}) WHERE split = 'grouped') g ON r.feature_set = g.feature_set AND r.variant = g.variant AND r.seed = g.seed GROUP BY r.feature_set, r.variant",
    ("a_px",),
)
def split_comparison(spark, d):
    rows = _grid(spark, d, "feature_set", "split")
    return X.split_comparison(rows.where("split = 'rows'"), rows.where("split = 'grouped'"))


@query(
    "cv_interval",
    f"SELECT variant, round(avg(macro_f1), 6) AS mean, round(stddev_samp(macro_f1), 6) AS std, round(avg(macro_f1) - 1.96::DOUBLE * stddev_samp(macro_f1) / sqrt(count(*)), 6) AS low, round(avg(macro_f1) + 1.96::DOUBLE * stddev_samp(macro_f1) / sqrt(count(*)), 6) AS high FROM ({_F1S}) GROUP BY variant",
    ("a_px",),
)
def cv_interval(spark, d):
    """Mean, deviation and normal 95 % interval of repeated scores."""
    half = 1.96 * F.stddev_samp("macro_f1") / F.sqrt(F.count("*"))
    mean = F.avg("macro_f1")
    return _f1s(spark, d).groupBy("variant").agg(F.round(mean, 6).alias("mean"), F.round(F.stddev_samp("macro_f1"), 6).alias("std"), F.round(mean - half, 6).alias("low"), F.round(mean + half, 6).alias("high"))


_LABELLED = "SELECT coalesce(d.lang, '(none)') AS topic, l.quality, count(*) AS n, count_if(d.lang NOT IN ('en', 'de', 'fr', 'es') OR d.lang IS NULL) AS n_rejected FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL"


@query("label_corpus", _LABELLED)
def label_corpus(spark, d):
    """Labels attached to rows by id, counted per label; rows of unknown topics are counted as rejected."""
    topics = spark.range(1).select(F.explode(F.array(*map(F.lit, ("en", "de", "fr", "es")))).alias("known"))
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("topic")).join(table(spark, d, "labels"), "doc_id").join(topics, F.col("topic") == F.col("known"), "left")
    return rows.groupBy(F.coalesce("topic", F.lit("(none)")).alias("topic"), "quality").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("n_rejected"))
