"""Lead feature queries over assessment forms and feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from enquira.functions import lead_rules as R
from enquira.operators import leads as L

from .adapters import view
from .entries import query


def forms(spark, d):
    return view(spark, d, "a_forms").withColumn("extra_fields", F.create_map("extra_q", "extra_a"))


def _like(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


BLOB = "concat_ws(' ', assessment_notes, qualifications, english_test, funding_method, study_destination, nullif(extra_a, ''))"
LABEL = "CASE lower(trim(rating)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.RATINGS.items()) + " ELSE -1 END"
PASSPORT = f"""CASE WHEN contains(lower({BLOB}), 'yet to renew passport') OR contains(lower({BLOB}), 'needs to renew passport') THEN 0
  WHEN regexp_matches(lower({BLOB}), '\\bno passport\\b') OR regexp_matches(lower({BLOB}), '\\bdoes ?n''?t have a passport\\b') THEN 1 ELSE 2 END"""
HAS_ENG = "CASE WHEN lower(trim(english_test)) IN ('', 'no', 'none', 'n/a', 'na', '-') THEN 0 ELSE 1 END"
BAND = f"CASE WHEN {HAS_ENG} = 0 THEN CAST(0 AS DOUBLE) ELSE coalesce(TRY_CAST(regexp_extract(english_test, '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE), 0) END"
METHOD = "CASE WHEN trim(funding_method) <> '' THEN 1 ELSE 0 END"
CLARITY = "CASE WHEN trim(funding_method) = '' THEN 0 " + " ".join(f"WHEN {_like('lower(funding_method)', w)} THEN {n}" for n, w in R.FUNDING) + " ELSE 2 END"
UK = "CASE WHEN contains(lower(study_destination), 'uk') THEN 1 ELSE 0 END"
COURSE = "CASE WHEN trim(course) <> '' THEN 1 ELSE 0 END"
INTAKE = "CASE WHEN trim(intake) <> '' THEN 1 ELSE 0 END"
_RANK = {n: i for i, n in enumerate(R.LEVEL_ORDER)}


def _level_sql() -> str:
    from enquira.functions.text import LEVELS

    v = "lower(trim(qualifications))"
    short = f"trim(regexp_replace({v}, '\\b(in|of|with honours|honours)\\b.*$', ''))"
    out = f"CASE WHEN {v} IN ('', 'na', 'n/a', 'none', '[university]') THEN 0"
    for key in (v, short):
        for name, synonyms in LEVELS.items():
            quoted = ", ".join(f"'{s}'" for s in synonyms)
            out += f" WHEN {key} IN ({quoted}) THEN {_RANK.get(name, 0)}"
    for name, words in R.LEVEL_WORDS:
        out += f" WHEN {_like(v, words)} THEN {_RANK[name]}"
    return out + " ELSE 0 END"


LEVEL = _level_sql()
GAP = f"""CASE WHEN regexp_matches({BLOB}, '(?i)\\bstudy gap\\b|gap year|since the completion of your last studies')
  OR (contains(lower(extra_q), 'study gap') AND lower(trim(extra_a)) NOT IN ('', 'no', 'none', 'n/a')) THEN 1 ELSE 0 END"""
APPLIED = f"""CASE WHEN regexp_matches({BLOB}, '(?i)\\bapplied to\\b|application (?:made|submitted)|applied (?:to|at) a university')
  OR (contains(lower(extra_q), 'application') AND lower(trim(extra_a)) NOT IN ('', 'no', 'none', 'not yet', 'n/a', '-')) THEN 1 ELSE 0 END"""
WORDS = "CAST(len(regexp_extract_all(assessment_notes, '\\S+')) AS INT)"


def _one(name: str, column: str, sql: str, expression) -> None:
    """Register a rule as a query of its own column."""

    @query(name, f"SELECT row_id, {sql} AS {column} FROM a_forms", ("a_forms",))
    def run(spark, d):
        rows = forms(spark, d)
        return rows.select("row_id", expression(rows).alias(column))


_one("lead_label", "label", LABEL, lambda r: R.lead_label(F.col("rating")))
_one("lead_blob", "blob", BLOB, R.lead_blob)
_one("passport_status", "passport_status", PASSPORT, lambda r: R.passport_status(R.lead_blob(r)))
_one("funding_method_present", "funding_method_present", METHOD, lambda r: R.present(F.col("funding_method")))
_one("funding_clarity", "funding_clarity", CLARITY, lambda r: R.funding_clarity(F.col("funding_method")))
_one("destination_uk", "destination_uk", UK, lambda r: R.destination_uk(F.col("study_destination")))
_one("qual_level", "qual_level", LEVEL, lambda r: R.qual_level(F.col("qualifications")))
_one("study_gap_mentioned", "study_gap_mentioned", GAP, lambda r: R.study_gap(R.lead_blob(r)))
_one("previous_application_mentioned", "previous_application_mentioned", APPLIED, lambda r: R.previous_application(R.lead_blob(r)))


@query("english_test_state", f"SELECT row_id, {HAS_ENG} AS has_english_test, {BAND} AS english_band FROM a_forms", ("a_forms",))
def english_test_state(spark, d):
    c = F.col("english_test")
    return forms(spark, d).select("row_id", R.has_english_test(c).alias("has_english_test"), R.english_band(c).alias("english_band"))


@query("has_course_intake", f"SELECT row_id, {COURSE} AS has_course, {INTAKE} AS has_intake FROM a_forms", ("a_forms",))
def has_course_intake(spark, d):
    return forms(spark, d).select("row_id", R.present(F.col("course")).alias("has_course"), R.present(F.col("intake")).alias("has_intake"))


@query("note_word_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INT) AS words FROM documents")
def note_word_count(spark, d):
    from enquira.functions.text import word_count

    from .adapters import table

    return table(spark, d, "documents").select("doc_id", word_count(F.col("text")).alias("words"))


@query(
    "lead_features",
    f"""SELECT row_id, crm_id, {LABEL} AS label, {PASSPORT} AS passport_status, {HAS_ENG} AS has_english_test, {BAND} AS english_band,
      {METHOD} AS funding_method_present, {CLARITY} AS funding_clarity, {UK} AS destination_uk, {COURSE} AS has_course, {INTAKE} AS has_intake,
      {LEVEL} AS qual_level, {GAP} AS study_gap_mentioned, {APPLIED} AS previous_application_mentioned, {WORDS} AS note_word_count FROM a_forms""",
    ("a_forms",),
)
def lead_features(spark, d):
    return R.lead_features(forms(spark, d))


def _sh(c: str) -> str:
    return f"round(CAST(count_if({c}) AS DOUBLE) / count(*), 4)"


@query(
    "feature_profile",
    f"""SELECT * FROM (SELECT count(*) AS total, count_if(label >= 0) AS labelled, count_if(label = 0) AS label_cold, count_if(label = 1) AS label_warm, count_if(label = 2) AS label_hot,
      {_sh('note_word_count > 0')} AS notes_share, {_sh('passport_status = 2')} AS passport_share, {_sh('has_english_test = 1')} AS english_share,
      {_sh('funding_clarity = 3')} AS funding_share, {_sh('destination_uk = 1')} AS uk_share, {_sh('has_course = 1')} AS course_share,
      concat_ws(',', {', '.join(f"CASE WHEN min({c}) = max({c}) THEN '{c}' END" for c in L.FEATURES)}) AS constant_columns FROM a_leads)
      CROSS JOIN (SELECT count(*) AS unique_ids, count_if(n > 1) AS repeated_ids, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS rows_in_repeats FROM (SELECT crm_id, count(*) AS n FROM a_leads GROUP BY crm_id))""",
    ("a_leads",),
)
def feature_profile(spark, d):
    return L.feature_profile(view(spark, d, "a_leads"))


@query(
    "lead_funnel",
    """SELECT no, stage, n, round(CAST(100 AS DOUBLE) * n / t, 2) AS pct FROM (
      SELECT 0 AS no, 'total' AS stage, (SELECT count(*) FROM a_leads) AS n UNION ALL SELECT 1, 'labelled', (SELECT count(*) FROM a_leads WHERE label >= 0)
      UNION ALL SELECT 2, 'unique_ids', (SELECT count(DISTINCT crm_id) FROM a_leads WHERE label >= 0)
      UNION ALL SELECT 3, 'rows_in_repeats', (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM a_leads WHERE label >= 0 GROUP BY crm_id) WHERE n > 1))
      CROSS JOIN (SELECT count(*) AS t FROM a_leads)""",
    ("a_leads",),
)
def lead_funnel(spark, d):
    return L.lead_funnel(view(spark, d, "a_leads"))


_VEC = ", ".join(L.FEATURES)


@query(
    "profile_collisions",
    f"""SELECT count(*) AS vectors, CAST(coalesce(sum(CASE WHEN labels > 1 THEN n END), 0) AS BIGINT) AS conflicting_rows, CAST(coalesce(sum(CASE WHEN labels = 1 THEN n END), 0) AS BIGINT) AS clean_rows
      FROM (SELECT {_VEC}, count(*) AS n, count(DISTINCT label) AS labels FROM a_leads WHERE label >= 0 GROUP BY {_VEC})""",
    ("a_leads",),
)
def profile_collisions(spark, d):
    return L.profile_collisions(view(spark, d, "a_leads"))
