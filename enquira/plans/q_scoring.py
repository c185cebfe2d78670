"""Score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from enquira.operators import scoring as S

from .adapters import view
from .entries import query

_PARTS = [
    ("passport_status", "CASE WHEN passport_status = 2 THEN 0.30 ELSE 0 END"),
    ("destination_uk", "CASE WHEN destination_uk <> 0 THEN 0.10 ELSE 0 END"),
    ("funding_clarity", "CASE funding_clarity WHEN 3 THEN 0.20 WHEN 2 THEN 0.066 ELSE 0 END"),
    ("has_course", "CASE WHEN has_course <> 0 THEN 0.05 ELSE 0 END"),
    ("has_intake", "CASE WHEN has_intake <> 0 THEN 0.05 ELSE 0 END"),
    ("qual_level", "CAST(qual_level AS DOUBLE) / 5 * 0.10"),
    ("english_test", "CASE WHEN has_english_test = 0 THEN 0 WHEN english_band = 0 THEN 0.04 WHEN english_band >= 6 THEN 0.08 ELSE english_band / 6 * 0.08 END"),
    ("study_gap", "CASE WHEN study_gap_mentioned <> 0 THEN 0 ELSE 0.04 END"),
    ("previous_app", "CASE WHEN previous_application_mentioned <> 0 THEN 0.03 ELSE 0 END"),
    ("note_completeness", "round(least(CAST(note_word_count AS DOUBLE) / 40, 1) * CAST(0.05 AS DOUBLE), 9)"),
]
_LONG = " UNION ALL ".join(f"SELECT row_id, '{n}' AS feature, round(CAST({v} AS DOUBLE), 4) AS contribution, CAST({S.WEIGHTS[n]} AS DOUBLE) AS weight FROM a_leads" for n, v in _PARTS)
_TOTAL = "round(" + " + ".join(f"round(CAST({v} AS DOUBLE), 4)" for _, v in _PARTS) + ", 9)"
_SCORED = f"SELECT row_id, round(t, 4) AS lead_score, CASE WHEN t >= 0.68 THEN 'Hot' WHEN t < 0.35 THEN 'Cold' ELSE 'Warm' END AS lead_label FROM (SELECT row_id, {_TOTAL} AS t FROM a_leads)"


@query("rubric_contributions", f"SELECT row_id, feature, contribution, weight FROM ({_LONG})", ("a_leads",))
def rubric_contributions(spark, d):
    rows = view(spark, d, "a_leads").select("row_id", F.explode(S.contributions()).alias("c"))
    return rows.select("row_id", "c.feature", "c.contribution", "c.weight")


@query("rubric_score", _SCORED, ("a_leads",))
def rubric_score(spark, d):
    return S.rubric_score(view(spark, d, "a_leads")).select("row_id", "lead_score", "lead_label")


@query(
    "rubric_summary",
    f"""SELECT count(*) AS total, count_if(lead_label = 'Cold') AS cold, count_if(lead_label = 'Warm') AS warm, count_if(lead_label = 'Hot') AS hot, min(lead_score) AS min_score, max(lead_score) AS max_score,
      round(avg(lead_score), 4) AS mean_score, round(CAST(count_if(lead_label = 'Hot') AS DOUBLE) / count(*), 4) AS hot_share, round(CAST(count_if(lead_label = 'Cold') AS DOUBLE) / count(*), 4) AS cold_share FROM ({_SCORED})""",
    ("a_leads",),
)
def rubric_summary(spark, d):
    return S.rubric_summary(S.rubric_score(view(spark, d, "a_leads")))


_OK = "w_cold + w_warm + w_hot > 0"
_ML = "(CAST(0.5 AS DOUBLE) * w_warm + w_hot) / (w_cold + w_warm + w_hot)"


def _ml():
    return S.proba_to_score(F.col("w_cold"), F.col("w_warm"), F.col("w_hot"))


@query("proba_to_score", f"SELECT id, round({_ML}, 9) AS score FROM a_px WHERE {_OK}", ("a_px",))
def proba_to_score(spark, d):
    return view(spark, d, "a_px").where(_OK).select("id", F.round(_ml(), 9).alias("score"))


_NULLED = f"CASE WHEN id % 7 = 0 OR NOT ({_OK}) THEN NULL ELSE {_ML} END"


@query("hybrid_score", f"SELECT id, round(coalesce(CAST(0.3 AS DOUBLE) * rule_score + CAST(0.7 AS DOUBLE) * ({_NULLED}), rule_score), 9) AS score FROM a_px", ("a_px",))
def hybrid_score(spark, d):
    ml = F.when((F.col("id") % 7 != 0) & F.expr(_OK), _ml())
    return view(spark, d, "a_px").select("id", F.round(S.hybrid_score(F.col("rule_score"), ml, 0.3), 9).alias("score"))


@query("score_label", "SELECT id, CASE WHEN rule_score < CAST(1 AS DOUBLE) / 3 THEN 'Cold' WHEN rule_score < CAST(2 AS DOUBLE) / 3 THEN 'Warm' ELSE 'Hot' END AS label FROM a_px", ("a_px",))
def score_label(spark, d):
    return view(spark, d, "a_px").select("id", S.score_label(F.col("rule_score")).alias("label"))


@query(
    "alpha_sweep",
    f"""SELECT *, row_number() OVER (ORDER BY macro_f1 DESC, mae, alpha) AS rank FROM (
      SELECT alpha, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1, round(CAST(sum(tp) AS DOUBLE) / sum(m), 6) AS accuracy, round(sum(e) / sum(m), 6) AS mae FROM (
        SELECT alpha, c, count_if(label = c AND pred = c) AS tp, count_if(label <> c AND pred = c) AS fp, count_if(label = c AND pred <> c) AS fn, count_if(label = c) AS m, sum(CASE WHEN label = c THEN abs(h - CAST(label AS DOUBLE) / 2) ELSE 0 END) AS e
        FROM (SELECT label, alpha, h, CASE WHEN h < CAST(1 AS DOUBLE) / 3 THEN 0 WHEN h < CAST(2 AS DOUBLE) / 3 THEN 1 ELSE 2 END AS pred FROM (
          SELECT label, CAST(a AS DOUBLE) / 10 AS alpha, round(CAST(a AS DOUBLE) / 10 * rule_score + (1 - CAST(a AS DOUBLE) / 10) * ({_ML}), 9) AS h FROM a_px CROSS JOIN range(11) g(a) WHERE {_OK}))
        CROSS JOIN (VALUES (0), (1), (2)) v(c) GROUP BY alpha, c HAVING count_if(label = c OR pred = c) > 0) GROUP BY alpha)""",
    ("a_px",),
)
def alpha_sweep(spark, d):
    rows = view(spark, d, "a_px").where(_OK).select("label", "rule_score", _ml().alias("ml_score"))
    return S.alpha_sweep(rows)
