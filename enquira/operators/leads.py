"""Reports over lead feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "passport_status has_english_test english_band funding_method_present funding_clarity destination_uk has_course has_intake "
    "qual_level study_gap_mentioned previous_application_mentioned note_word_count"
).split()


def feature_profile(features: DataFrame) -> DataFrame:
    """One row: totals, label counts, repeated ids and value shares (4 digits)."""
    ids = features.groupBy("crm_id").agg(F.count("*").alias("n"))
    repeats = ids.agg(F.count("*").alias("unique_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_repeats"))

    def share(condition):
        return F.round(F.count_if(condition) / F.count("*"), 4)

    main = features.agg(
        F.count("*").alias("total"), F.count_if(F.col("label") >= 0).alias("labelled"),
        *(F.count_if(F.col("label") == k).alias(f"label_{n}") for k, n in enumerate(("cold", "warm", "hot"))),
        share(F.col("note_word_count") > 0).alias("notes_share"), share(F.col("passport_status") == 2).alias("passport_share"),
        share(F.col("has_english_test") == 1).alias("english_share"), share(F.col("funding_clarity") == 3).alias("funding_share"),
        share(F.col("destination_uk") == 1).alias("uk_share"), share(F.col("has_course") == 1).alias("course_share"),
        F.array_join(F.array_compact(F.array(*(F.when(F.min(c) == F.max(c), c) for c in FEATURES))), ",").alias("constant_columns"),
    )
    return main.join(repeats, F.lit(True))


def lead_funnel(features: DataFrame) -> DataFrame:
    """Stages total, labelled, unique ids and rows in repeated ids, with their percentage."""
    ids = features.where("label >= 0").groupBy("crm_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("u"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("r"))
    one = features.agg(F.count("*").alias("t"), F.count_if(F.col("label") >= 0).alias("l")).join(ids, F.lit(True))
    stage = F.array(*(F.struct(F.lit(i).alias("no"), F.lit(n).alias("stage"), F.col(c).alias("n")) for i, (n, c) in enumerate([("total", "t"), ("labelled", "l"), ("unique_ids", "u"), ("rows_in_repeats", "r")])))
    return one.select("t", F.explode(stage).alias("s")).select("s.no", "s.stage", "s.n", F.round(100 * F.col("s.n") / F.col("t"), 2).alias("pct"))


def profile_collisions(features: DataFrame) -> DataFrame:
    """Distinct feature vectors, and rows whose vector has one or several labels."""
    per = features.where("label >= 0").groupBy(*FEATURES).agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))
    return per.agg(
        F.count("*").alias("vectors"), F.coalesce(F.sum(F.when(F.col("labels") > 1, F.col("n"))), F.lit(0)).alias("conflicting_rows"),
        F.coalesce(F.sum(F.when(F.col("labels") == 1, F.col("n"))), F.lit(0)).alias("clean_rows"),
    )
