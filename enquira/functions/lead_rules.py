"""Rules that turn the text of an assessment form into lead features."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import known_level, word_count

# Label of each rating.
RATINGS = {"cold": 0, "good": 1, "warm": 1, "excellent": 2, "hot": 2}
# Phrases about funding, in the order in which they are tried.
FUNDING = [
    (1, ["no funds", "no source of funds", "yet to discuss", "not sure", "unknown", "unclear", "to be discussed"]),
    (2, ["looking for", "scholarship", "bursary", "awaiting", "may get", "pending", "try", "undecided", "explore"]),
    (3, ["self funded", "self-funded", "parents", "sponsor", "savings", "has funds", "has savings", "loan approved", "paid", "fully funded", "own funds"]),
    (3, ["fund", "finance"]),
]
# Levels in rank order, and words that tell a level in free text.
LEVEL_ORDER = ["unknown", "foundation", "diploma", "bachelor", "master", "phd"]
LEVEL_WORDS = [
    ("phd", ["phd", "doctorate", "dphil"]),
    ("master", ["master", "msc", "mba", "ma ", "meng", "postgraduate", "post-graduate"]),
    ("bachelor", ["bachelor", "bsc", "beng", "ba ", "honours", "degree"]),
    ("diploma", ["diploma"]),
    ("foundation", ["foundation"]),
]


def contains_any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(map(re.escape, words)))


def _trim(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def lead_label(c: Column) -> Column:
    v = F.lower(_trim(c))
    return reduce(lambda w, kv: w.when(v == kv[0], kv[1]), list(RATINGS.items())[1:], F.when(v == "cold", 0)).otherwise(-1)


def lead_blob(df: DataFrame) -> Column:
    """The free text of a form, with truthy extra answers."""
    fields = ["assessment_notes", "qualifications", "english_test", "funding_method", "study_destination"]
    extra = F.filter(F.map_values("extra_fields"), lambda v: v.isNotNull() & (v != ""))
    return F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in fields), extra)


def passport_status(blob: Column) -> Column:
    t = F.lower(blob)
    return (
        F.when(t.contains("yet to renew passport") | t.contains("needs to renew passport"), 0)
        .when(t.rlike(r"\bno passport\b") | t.rlike(r"\bdoes ?n'?t have a passport\b"), 1)
        .otherwise(2)
    )


def has_english_test(c: Column) -> Column:
    return F.when(F.lower(_trim(c)).isin("", "no", "none", "n/a", "na", "-"), 0).otherwise(1)


def english_band(c: Column) -> Column:
    number = F.regexp_extract(_trim(c), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(has_english_test(c) == 0, 0.0).otherwise(F.coalesce(number, F.lit(0.0)))


def present(c: Column) -> Column:
    return F.when(_trim(c) != "", 1).otherwise(0)


def funding_clarity(c: Column) -> Column:
    v = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(F.trim(v) == "", 0)
    for level, words in FUNDING:
        out = out.when(contains_any(v, words), level)
    return out.otherwise(2)


def destination_uk(c: Column) -> Column:
    """1 where "uk" occurs, also inside a word."""
    return F.when(F.lower(F.coalesce(c, F.lit(""))).contains("uk"), 1).otherwise(0)


def qual_level(c: Column) -> Column:
    """Index in LEVEL_ORDER; known levels outside it count as 0."""
    v = _trim(c)
    low = F.lower(v)
    words = reduce(lambda w, kv: w.when(contains_any(low, kv[1]), kv[0]), LEVEL_WORDS[1:], F.when(contains_any(low, LEVEL_WORDS[0][1]), LEVEL_WORDS[0][0]))
    name = F.when(low.isin("", "na", "n/a", "none", "[university]"), "unknown").otherwise(F.coalesce(known_level(v), words.otherwise("unknown")))
    return F.greatest(F.array_position(F.array(*map(F.lit, LEVEL_ORDER)), name) - 1, F.lit(0)).cast("int")


def _extra_answer(part: str, no: list[str]) -> Column:
    """Whether a question with a word has an answer other than these."""
    return F.exists(F.map_entries("extra_fields"), lambda e: F.lower(e["key"]).contains(part) & ~F.lower(F.trim(e["value"])).isin("", *no))


def study_gap(blob: Column) -> Column:
    said = blob.rlike(r"(?i)\bstudy gap\b|gap year|since the completion of your last studies")
    return F.when(said | _extra_answer("study gap", ["no", "none", "n/a"]), 1).otherwise(0)


def previous_application(blob: Column) -> Column:
    said = blob.rlike(r"(?i)\bapplied to\b|application (?:made|submitted)|applied (?:to|at) a university")
    return F.when(said | _extra_answer("application", ["no", "none", "not yet", "n/a", "-"]), 1).otherwise(0)


def lead_features(forms: DataFrame) -> DataFrame:
    """One feature row per form; ``forms`` has extra_fields as a map."""
    rows = forms.withColumn("_blob", lead_blob(forms))
    blob = F.col("_blob")
    return rows.select(
        "row_id", "crm_id", lead_label(F.col("rating")).alias("label"), passport_status(blob).alias("passport_status"),
        has_english_test(F.col("english_test")).alias("has_english_test"), english_band(F.col("english_test")).alias("english_band"),
        present(F.col("funding_method")).alias("funding_method_present"), funding_clarity(F.col("funding_method")).alias("funding_clarity"),
        destination_uk(F.col("study_destination")).alias("destination_uk"), present(F.col("course")).alias("has_course"),
        present(F.col("intake")).alias("has_intake"), qual_level(F.col("qualifications")).alias("qual_level"),
        study_gap(blob).alias("study_gap_mentioned"), previous_application(blob).alias("previous_application_mentioned"),
        word_count(F.col("assessment_notes")).alias("note_word_count"),
    )
