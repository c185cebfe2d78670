"""Model matrices from aligned lead tables, and from live sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mltables import CATEGORICAL, ENGAGEMENT, NUMERIC, category_text
from .quantiles import exact_quantiles

# Known values of the categories, and what an unobserved one is taken to be.
KNOWN_VALUES = {
    "passport_status": ["0", "1", "2"], "qual_level": ["0", "1", "2", "3", "4", "5"], "destination_uk": ["0", "1"], "has_course": ["0", "1"],
    "has_intake": ["0", "1"], "study_gap_mentioned": ["0", "1"], "previous_application_mentioned": ["0", "1"],
}
DEFAULT_MODES = {
    "passport_status": "2", "qual_level": "0", "destination_uk": "1", "has_course": "1", "has_intake": "1", "study_gap_mentioned": "0",
    "previous_application_mentioned": "0",
}


def numeric_columns(drop_english: bool = False, drop_engagement: bool = False) -> list[str]:
    return [c for c in NUMERIC if not (drop_english and c == "has_english_test") and not (drop_engagement and c in ENGAGEMENT)]


def build_matrix(df: DataFrame, drop_english: bool = False, drop_engagement: bool = False) -> tuple[DataFrame, list[str]]:
    """(table, names of its feature columns): numeric columns with the frame's own medians for missing values (0
    where all are missing), categories as ``<column>_<value>`` flags, a missing one as ``unknown``.  All other
    columns are kept.

    The driver sees the counts of ``exact_quantiles`` and the distinct values of the categories.
    """
    numbers = numeric_columns(drop_english, drop_engagement)
    medians = exact_quantiles(df, numbers)
    stats = df.agg(*(F.sort_array(F.collect_set(category_text(F.col(c)))).alias(c) for c in CATEGORICAL)).first()
    kept = [c for c in df.columns if c not in {*NUMERIC, *CATEGORICAL}]
    features = [F.coalesce(F.col(c).cast("double"), F.lit(medians[c] or 0.0)).alias(c) for c in numbers]
    flags = [(category_text(F.col(c)) == v).cast("double").alias(f"{c}_{v}") for c in CATEGORICAL for v in stats[c]]
    names = [*numbers, *(f"{c}_{v}" for c in CATEGORICAL for v in stats[c])]
    return df.select(*kept, *features, *flags), names


def with_columns(matrix: DataFrame, names: list[str]) -> DataFrame:
    """The matrix with a model's columns: absent ones are 0."""
    return matrix.select(*matrix.columns, *(F.lit(0.0).alias(n) for n in names if n not in matrix.columns))


def imputation_values(table: DataFrame) -> tuple[dict[str, float], dict[str, str]]:
    """Medians and modes of an imputation table (a row per feature)."""
    rows = table.collect()
    medians = {r["key"].removeprefix("median_"): r["number"] for r in rows if r["key"].startswith("median_") and r["number"] is not None}
    return medians, {r["key"].removeprefix("mode_"): r["text"] for r in rows if r["key"].startswith("mode_")}


def inference_matrix(live: DataFrame, medians: dict[str, float], modes: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """A model's inputs for live rows: all columns of ``live`` that are no features, then the features.

    ``live`` may hold a feature as evidence (its own name), as engagement (``engagement_<name>``) or as a session
    flag (``flags_<name>``); a number is looked up in this order, then the training median, then 0.  A category is evidence,
    then the training mode, then a built-in one.  ``columns`` are the model's; its flags say which values exist, a value that
    it does not know switches none on.
    """

    def first_of(c: str) -> list[Column]:
        return [F.col(p + c).cast("double") for p in ("", "engagement_", "flags_") if p + c in live.columns]

    numbers = [F.coalesce(*first_of(c), F.lit(float(medians.get(c, 0.0)))).alias(c) for c in NUMERIC]
    names = columns or [*NUMERIC, *(f"{c}_{v}" for c in CATEGORICAL for v in KNOWN_VALUES[c])]
    flags = []
    for c in CATEGORICAL:
        typical = F.lit(modes.get(c, DEFAULT_MODES[c]))
        seen = category_text(F.col(c), None) if c in live.columns else F.lit(None).cast("string")
        flags += [(F.coalesce(seen, typical) == n.removeprefix(f"{c}_")).cast("double").alias(n) for n in names if n.startswith(f"{c}_")]
    features = {*NUMERIC, *CATEGORICAL}
    kept = [c for c in live.columns if reduce(lambda x, p: x.removeprefix(p), ("engagement_", "flags_"), c) not in features]
    return live.select(*kept, *numbers, *flags)
