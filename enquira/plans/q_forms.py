"""Mail form and personal data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from enquira.functions import pii as P
from enquira.functions.lead_rules import lead_blob
from enquira.operators import forms as M

from .adapters import table, view
from .entries import query
from .q_leads import forms

# the rules that RE2 can run: it has no look-around
_RE2 = {m: p for m, p in P.RULES if m in ("EMAIL", "PASSPORT", "IP")}


def _dealt(spark, d):
    """Documents over all tasks, however few row groups their files have: the rules take far longer than a shuffle of the texts."""
    return table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")


@query("redact_pii")
def redact_pii(spark, d):
    return _dealt(spark, d).select("doc_id", P.redact(F.col("text")).alias("redacted"))


def _chain(c: str) -> str:
    for m, p in _RE2.items():
        c = f"regexp_replace({c}, '{p}', '[{m}_REDACTED]', 'g')"
    return c


@query("redact_email_ip", f"SELECT doc_id, {_chain('text')} AS redacted FROM documents")
def redact_email_ip(spark, d):
    c = F.col("text")
    for m, p in _RE2.items():
        c = F.regexp_replace(c, p, f"[{m}_REDACTED]")
    return table(spark, d, "documents").select("doc_id", c.alias("redacted"))


# RE2 has no look-around: the telephone rule's borders as characters that it matches, the form's name without its look-ahead
_BY_RE2 = {m: p for m, p in P.RULES} | {"PHONE": None}
_COUNTED = [m for m, p in _BY_RE2.items() if p]


@query("count_pii", "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{_BY_RE2[m]}')) AS INT) AS n_{m.lower()}" for m in _COUNTED) + " FROM documents")
def count_pii(spark, d):
    """The markers whose rules both engines can run; ``count_pii_all`` has all eight."""
    rows = _dealt(spark, d).select("doc_id", P.counts(F.col("text")).alias("c"))
    return rows.select("doc_id", *(F.col("c")[m].alias(f"n_{m.lower()}") for m in _COUNTED))


@query("count_pii_all")
def count_pii_all(spark, d):
    rows = _dealt(spark, d).select("doc_id", P.counts(F.col("text")).alias("c"))
    return rows.select("doc_id", *(F.col("c")[m].alias(f"n_{m.lower()}") for m in [*(m for m, _ in P.RULES), "NAME"]))


def _re2(pattern: str) -> str:
    """The same question for RE2, "does it match anywhere?": a border or a look-ahead is matched as a character."""
    borders = pattern.replace(r"(?<![\d-])", r"(?:^|[^\d-])").replace(r"(?![\d-])", r"(?:[^\d-]|$)").replace(r"(?=", "(?:")
    return borders.replace("'", "''")


@query("has_pii", "SELECT doc_id, coalesce(" + " OR ".join(f"regexp_matches(text, '{_re2(p)}')" for p in [*(p for _, p in P.RULES), P.FORM_NAME]) + ", false) AS has_pii FROM documents")
def has_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", P.has_pii(F.col("text")).alias("has_pii"))


_QUESTION = "(regexp_matches(line, '[?:]\\s*$') OR " + " OR ".join(f"contains(lower(line), '{w}')" for w in M.PROMPTS) + ") AND NOT (contains(line, 'Jotform Logo') OR contains(lower(line), 'edit this submission'))"
_BODY = """concat('before ', rating, chr(10), 'Jotform Logo', chr(10), 'CRM ID?', chr(10), crm_id, chr(10), chr(10), 'Funding', chr(13), chr(10), funding_method, chr(10), '  Edit this submission ', chr(10), 'Comments:', chr(10), assessment_notes, chr(10), qualifications, chr(10), 'Study destination:')"""


@query(
    "plain_pairs",
    f"""SELECT row_id, CAST(min(pos) AS INT) AS pos, arg_min(line, pos) AS question, coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (WHERE NOT q), '') AS answer FROM (
      SELECT *, sum(q::INT) OVER (PARTITION BY row_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT row_id, pos, line, {_QUESTION} AS q FROM (
        SELECT row_id, unnest(range(len(l))) AS pos, trim(unnest(l)) AS line FROM (SELECT row_id, string_split_regex({_BODY}, '\\r?\\n') AS l FROM a_forms)) WHERE line <> '')) WHERE grp > 0 GROUP BY row_id, grp""",
    ("a_forms",),
)
def plain_pairs(spark, d):
    """Plain mails made of the forms."""
    return M.plain_pairs(view(spark, d, "a_forms").select("row_id", F.expr(_BODY).alias("body")), "row_id", "body")


def _field_sql(c: str) -> str:
    whens = " ".join("WHEN {} THEN '{}'".format(" OR ".join(f"contains(lower({c}), '{w}')" for w in words), name) for name, words in M.FIELDS)
    return f"CASE WHEN regexp_matches({c}, '{M.PERSONAL}') THEN NULL {whens} END"


@query("classify_question", f"SELECT row_id, coalesce({_field_sql('extra_q')}, '-') AS field, coalesce({_field_sql('qualifications')}, '-') AS other FROM a_forms", ("a_forms",))
def classify_question(spark, d):
    rows = view(spark, d, "a_forms")
    return rows.select("row_id", F.coalesce(M.classify_question(F.col("extra_q")), F.lit("-")).alias("field"), F.coalesce(M.classify_question(F.col("qualifications")), F.lit("-")).alias("other"))


_RATING = "CASE WHEN contains(lower(rating), 'cold') THEN 'Cold' WHEN contains(lower(rating), 'good') THEN 'Good' WHEN contains(lower(rating), 'excellent') THEN 'Excellent' ELSE '' END"


@query("normalize_rating", f"SELECT row_id, {_RATING} AS rating FROM a_forms", ("a_forms",))
def normalize_rating(spark, d):
    return view(spark, d, "a_forms").select("row_id", M.normalize_rating(F.col("rating")).alias("rating"))


@query("extract_crm_id", "SELECT row_id, coalesce(nullif(regexp_extract(crm_id, '\\d{4,}'), ''), trim(crm_id)) AS crm_id FROM a_forms", ("a_forms",))
def extract_crm_id(spark, d):
    return view(spark, d, "a_forms").select("row_id", M.extract_crm_id(F.col("crm_id")).alias("crm_id"))


@query("assemble_record")
def assemble_record(spark, d):
    """Pairs made of each form's fields, assembled again."""
    rows = view(spark, d, "a_forms")
    asked = [("CRM ID?", "crm_id"), ("Overall rating", "rating"), ("How are you funding it?", "funding_method"), ("Comments", "assessment_notes")]
    pairs = F.explode(F.array(
        *(F.struct(F.lit(n).alias("pos"), F.lit(q).alias("question"), F.coalesce(F.col(c), F.lit("")).alias("answer")) for n, (q, c) in enumerate(asked)),
        F.struct(F.lit(99).alias("pos"), F.col("extra_q").alias("question"), F.col("extra_a").alias("answer")),
    ))
    long = rows.select("row_id", pairs.alias("p")).select("row_id", "p.*")
    return M.assemble_records(long, "row_id").withColumn("extra_fields", F.to_json("extra_fields"))


def _records(spark, d):
    staff = F.when(F.col("row_id") % 3 == 0, "").when(F.col("row_id") % 3 == 1, "Jo Do").otherwise("[NAME_REDACTED]")
    return forms(spark, d).withColumn("rating", M.normalize_rating(F.col("rating"))).withColumn("counsellor_id", staff)


# the notes and qualifications of the forms hold personal data where a rule that RE2 can run, or the one telephone number, says so
_LEFT = " OR ".join([f"regexp_matches(assessment_notes || ' | ' || qualifications, '{p}')" for p in (_BY_RE2[m] for m in _COUNTED)] + ["contains(assessment_notes, '+254 702 102 295')"])
_FLAGGED = f"SELECT row_id, rating, CASE WHEN left_ THEN 'REVIEW' WHEN rating = '' OR crm_id = '' THEN 'CHECK' ELSE 'CLEAN' END AS quality_flag, CASE WHEN left_ THEN 'PII not fully redacted' ELSE '' END AS pii_issues, CASE WHEN row_id % 3 = 0 THEN '' ELSE '[NAME_REDACTED]' END AS counsellor_id FROM (SELECT row_id, crm_id, {_RATING} AS rating, {_LEFT} AS left_ FROM a_forms)"


@query("quality_flag", f"SELECT row_id, quality_flag, pii_issues, counsellor_id FROM ({_FLAGGED})", ("a_forms",))
def quality_flag(spark, d):
    return M.quality_flag(_records(spark, d)).select("row_id", "quality_flag", "pii_issues", "counsellor_id")


@query(
    "quality_summary",
    f"""SELECT 'total' AS kind, '' AS name, count(*) AS n FROM ({_FLAGGED}) UNION ALL SELECT 'flag', quality_flag, count(*) FROM ({_FLAGGED}) GROUP BY quality_flag UNION ALL SELECT 'rating', rating, count(*) FROM ({_FLAGGED}) GROUP BY rating
      UNION ALL SELECT 'pii_left', '', count(*) FROM ({_FLAGGED}) WHERE quality_flag = 'REVIEW' HAVING count(*) > 0""",
    ("a_forms",),
)
def quality_summary(spark, d):
    kept = M.quality_flag(_records(spark, d)).select("row_id", "crm_id", "rating", "counsellor_id", "assessment_notes", "qualifications", "quality_flag", "pii_issues")
    return M.quality_summary(kept)


@query("redact_forms")
def redact_forms(spark, d):
    rows = forms(spark, d)
    return rows.select("row_id", P.redact(lead_blob(rows)).alias("redacted"))


_SUBJ = """(SELECT row_id, CASE WHEN row_id % 3 = 0 THEN '' ELSE CAST(row_id AS VARCHAR) END AS crm_id, CASE WHEN row_id % 4 = 0 THEN 'Good' ELSE '' END AS rating, CASE WHEN row_id % 5 = 0 THEN 'c1' ELSE '' END AS counsellor_id,
  CASE row_id % 3 WHEN 0 THEN 'Form 123456 - Jo Do - Cold' WHEN 1 THEN 'Re: form' ELSE 'Form - A B - Excellent' END AS subject FROM a_forms)"""


@query(
    "subject_fallback",
    f"""SELECT row_id, CASE WHEN crm_id = '' THEN regexp_extract(subject, '\\b(\\d{{6}})\\b', 1) ELSE crm_id END AS crm_id, CASE WHEN counsellor_id = '' AND n <> '' AND rating = '' THEN n ELSE rating END AS rating,
      CASE WHEN counsellor_id = '' AND n <> '' THEN '[NAME_REDACTED]' ELSE counsellor_id END AS counsellor_id FROM (SELECT *, regexp_extract(subject, '-\\s*[^-]+?\\s*-\\s*(Cold|Good|Excellent)', 1) AS n FROM {_SUBJ})""",
    ("a_forms",),
)
def subject_fallback(spark, d):
    k = F.col("row_id")
    rows = view(spark, d, "a_forms").select(
        "row_id", F.when(k % 3 == 0, "").otherwise(k.cast("string")).alias("crm_id"), F.when(k % 4 == 0, "Good").otherwise("").alias("rating"), F.when(k % 5 == 0, "c1").otherwise("").alias("counsellor_id"),
        F.when(k % 3 == 0, "Form 123456 - Jo Do - Cold").when(k % 3 == 1, "Re: form").otherwise("Form - A B - Excellent").alias("subject"),
    )
    return M.subject_fallback(rows).drop("subject")
