"""Rule score, hybrid score and their calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enquira.functions.lead_rules import LEVEL_ORDER

# Weights of the rubric; they sum to 1.
WEIGHTS = {
    "passport_status": 0.30, "destination_uk": 0.10, "funding_clarity": 0.20, "has_course": 0.05, "has_intake": 0.05,
    "qual_level": 0.10, "english_test": 0.08, "study_gap": 0.04, "previous_app": 0.03, "note_completeness": 0.05,
}
COLD, HOT = 0.35, 0.68


def english_part(has: Column, band: Column, weight: float = WEIGHTS["english_test"]) -> Column:
    """Half for a test without a band, in full from band 6."""
    return F.when(has == 0, 0.0).when(band == 0, 0.5 * weight).when(band >= 6, weight).otherwise(band / 6.0 * weight)


def contributions() -> Column:
    """The ten parts of the rubric as an array of structs."""
    w = WEIGHTS
    passport, level, funding = F.col("passport_status"), F.col("qual_level"), F.col("funding_clarity")
    parts = [
        ("passport_status", F.when(passport == 2, w["passport_status"]).otherwise(0.0),
         F.when(passport == 2, "valid passport").when(passport == 0, "expired / needs renewal").when(passport == 1, "no passport reported").otherwise("unknown")),
        ("destination_uk", F.when(F.col("destination_uk") != 0, w["destination_uk"]).otherwise(0.0), None),
        ("funding_clarity", F.when(funding == 3, w["funding_clarity"]).when(funding == 2, 0.33 * w["funding_clarity"]).otherwise(0.0), F.concat(F.lit("level="), funding.cast("string"))),
        ("has_course", F.when(F.col("has_course") != 0, w["has_course"]).otherwise(0.0), None),
        ("has_intake", F.when(F.col("has_intake") != 0, w["has_intake"]).otherwise(0.0), None),
        ("qual_level", level / 5.0 * w["qual_level"], F.coalesce(F.try_element_at(F.array(*map(F.lit, LEVEL_ORDER)), level + 1), F.lit("unknown"))),
        ("english_test", english_part(F.col("has_english_test"), F.col("english_band")), None),
        ("study_gap", F.when(F.col("study_gap_mentioned") != 0, 0.0).otherwise(w["study_gap"]), F.when(F.col("study_gap_mentioned") != 0, "gap mentioned").otherwise("no gap")),
        ("previous_app", F.when(F.col("previous_application_mentioned") != 0, w["previous_app"]).otherwise(0.0), None),
        ("note_completeness", F.least(F.col("note_word_count") / 40.0, F.lit(1.0)) * w["note_completeness"], None),
    ]
    return F.array(*(
        F.struct(F.lit(n).alias("feature"), F.round(F.round(v, 9), 4).alias("contribution"), F.lit(w[n]).alias("weight"), (F.lit(None).cast("string") if t is None else t).alias("detail"))
        for n, v, t in parts
    ))


def rubric_label(score: Column) -> Column:
    return F.when(score >= HOT, "Hot").when(score < COLD, "Cold").otherwise("Warm")


def rubric_score(features: DataFrame) -> DataFrame:
    """lead_score (4 digits) and lead_label, judged on the sum of the parts."""
    total = F.round(F.aggregate(contributions(), F.lit(0.0), lambda a, x: a + x["contribution"]), 9)
    rows = features.withColumn("_total", total)
    return rows.select(*features.columns, F.round("_total", 4).alias("lead_score"), rubric_label(F.col("_total")).alias("lead_label"))


def rubric_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("lead_label") == n).alias(n.lower()) for n in ("Cold", "Warm", "Hot")),
        F.min("lead_score").alias("min_score"), F.max("lead_score").alias("max_score"), F.round(F.avg("lead_score"), 4).alias("mean_score"),
        F.round(F.count_if(F.col("lead_label") == "Hot") / F.count("*"), 4).alias("hot_share"), F.round(F.count_if(F.col("lead_label") == "Cold") / F.count("*"), 4).alias("cold_share"),
    )


def proba_to_score(cold: Column, warm: Column, hot: Column) -> Column:
    """0.5 P(Warm) + P(Hot) of normalised weights; a negative or zero sum is an error."""
    total = cold + warm + hot
    bad = (cold < 0) | (warm < 0) | (hot < 0) | (total <= 0)
    score = F.least(F.greatest((0.5 * warm + hot) / total, F.lit(0.0)), F.lit(1.0))
    return F.when(bad, F.raise_error(F.lit("probabilities must be non-negative with a positive sum")).cast("double")).otherwise(score)


def hybrid_score(rule: Column, ml: Column, alpha: Column | float = 0.5) -> Column:
    """The blend of rule and model; the rule alone where the model is silent."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    blend = F.least(F.greatest(a * rule + (1 - a) * ml, F.lit(0.0)), F.lit(1.0))
    checked = F.when((a < 0) | (a > 1), F.raise_error(F.lit("alpha must lie in [0, 1]")).cast("double"))
    return checked.otherwise(F.when(ml.isNull(), rule).otherwise(blend))


def score_label(score: Column) -> Column:
    return F.when(score < 1 / 3, "Cold").when(score < 2 / 3, "Warm").otherwise("Hot")


def label_code(score: Column) -> Column:
    return F.when(score < 1 / 3, 0).when(score < 2 / 3, 1).otherwise(2)


def alpha_sweep(scored: DataFrame, steps: int = 10) -> DataFrame:
    """Macro-F1, accuracy and mean error of the blend for every weight on a grid; best first.

    ``scored`` has label, rule_score and ml_score.  All weights are judged in one pass over
    the rows; the confusion counts that are shuffled are at most 9 per weight.
    """
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / float(steps))).alias("alpha")
    rows = scored.select("label", "rule_score", "ml_score", grid)
    blend = hybrid_score(F.col("rule_score"), F.col("ml_score"), F.col("alpha"))
    cells = rows.withColumn("h", F.round(blend, 9)).groupBy("alpha", "label", label_code(F.col("h")).alias("pred")).agg(
        F.count("*").alias("n"), F.sum(F.abs(F.col("h") - F.col("label") / 2)).alias("err")
    )
    by = Window.partitionBy("alpha")
    marks = cells.select("alpha", "n", "err", F.explode(F.array(
        F.struct(F.col("label").alias("c"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("label") != F.col("pred"), F.col("n")).otherwise(0).alias("fn"), F.col("n").alias("m"), F.col("err").alias("e")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("tp"), F.when(F.col("label") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("m"), F.lit(0.0).alias("e")),
    )).alias("x")).groupBy("alpha", "x.c").agg(*(F.sum(f"x.{k}").alias(k) for k in ("tp", "fp", "fn", "m", "e")))
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    out = marks.groupBy("alpha").agg(
        F.round(F.avg(f1), 6).alias("macro_f1"), F.round(F.sum("tp") / F.sum("m"), 6).alias("accuracy"), F.round(F.sum("e") / F.sum("m"), 6).alias("mae"),
    )
    order = Window.orderBy(F.col("macro_f1").desc(), "mae", "alpha")  # one row per weight
    return out.withColumn("rank", F.row_number().over(order))
