"""Question and answer pairs of assessment mails, classification and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enquira.functions.lead_rules import contains_any
from enquira.functions.pii import has_pii, redact

# Prompts that count as questions in plain mails.
PROMPTS = [
    "qualifications", "english proficiency", "study destination", "course", "intake", "funding", "crm id", "enquiry stage", "username",
    "email address",
]
# Question words of each form field, tried in order.
FIELDS = [
    ("crm_id", ["crm id", "lead id", "lead number", "application id"]),
    ("qualifications", ["qualification", "degree", "academic", "education", "highest qualification"]),
    ("english_test", ["english", "ielts", "toefl", "kcse", "proficiency", "language"]),
    ("study_destination", ["study destination", "destination", "which country", "preferred country", "country are you"]),
    ("course", ["course", "programme", "program", "subject", "study preference", "what course"]),
    ("intake", ["intake", "start date", "start term", "which intake", "entry", "when do you"]),
    ("funding_method", ["funding", "sponsor", "self funded", "loan", "scholarship", "how are you funding"]),
    ("fund_amount", ["fund amount", "amount arranged", "budget", "how much"]),
    ("assessment_notes", ["comments", "notes", "feedback", "observation", "assessment"]),
    ("counsellor_id", ["counsellor", "username", "agent", "staff"]),
    ("rating", ["rating", "student readiness", "assessment rating", "grade"]),
]
# Fixed value: questions about the person.
PERSONAL = r"(?i)(^|\W)(name|email|phone|whatsapp|marital|visa refusal|dependant|nationality|country of residence|address|date of birth|age)(\W|$)"


def is_question(line: Column) -> Column:
    return line.rlike(r"[?:]\s*$") | contains_any(F.lower(line), PROMPTS)


def plain_pairs(bodies: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, question, answer): lines after a question, joined, are its answer.

    Logo lines are left out where they would start a group; text before the first question is
    dropped."""
    lines = bodies.select(key, F.posexplode(F.split(text, "\\r?\\n")).alias("pos", "line")).select(key, "pos", F.trim("line").alias("line")).where("line <> ''")
    logo = F.col("line").contains("Jotform Logo") | F.lower("line").contains("edit this submission")
    question = is_question(F.col("line")) & ~logo
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("q", question).withColumn("grp", F.sum(question.cast("int")).over(so_far)).where("grp > 0")
    per = rows.groupBy(key, "grp").agg(
        F.min("pos").alias("pos"), F.min_by("line", "pos").alias("question"), F.array_sort(F.collect_list(F.when(~F.col("q"), F.struct("pos", "line")))).alias("rest"),
    )
    return per.select(key, "pos", "question", F.array_join(F.transform("rest", lambda x: x["line"]), " ").alias("answer"))


def classify_question(q: Column) -> Column:
    out = F.when(q.rlike(PERSONAL), F.lit(None).cast("string"))
    for name, words in FIELDS:
        out = out.when(contains_any(F.lower(q), words), name)
    return out


def normalize_rating(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.contains("cold"), "Cold").when(v.contains("good"), "Good").when(v.contains("excellent"), "Excellent").otherwise("")


def extract_crm_id(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"\d{4,}", 0), F.lit("")), F.trim(c))


def assemble_records(pairs: DataFrame, key: str) -> DataFrame:
    """One record per mail: the last answer of each field, other answers redacted in a map."""
    rows = pairs.withColumn("field", classify_question(F.col("question")))
    fields = [F.coalesce(F.max_by("answer", F.when(F.col("field") == n, F.col("pos"))), F.lit("")).alias(n) for n, _ in FIELDS]
    name = F.when(F.lower("question").rlike(r"\bname\b"), "[NAME_REDACTED]").otherwise(redact(F.col("answer")))
    other = F.array_sort(F.collect_list(F.when(F.col("field").isNull() & (F.col("question") != ""), F.struct("pos", redact(F.col("question")).alias("q"), name.alias("a")))))
    out = rows.groupBy(key).agg(*fields, other.alias("_other"))
    last = F.map_from_entries(F.filter(F.transform("_other", lambda x: F.struct(x["q"], x["a"])), lambda e: ~F.exists(F.col("_other"), lambda y: (y["q"] == e["q"]) & (F.struct(y["q"], y["a"]) > e))))
    return out.withColumn("extra_fields", last).drop("_other").withColumn("rating", normalize_rating(F.col("rating"))).withColumn("crm_id", extract_crm_id(F.col("crm_id")))


def quality_flag(records: DataFrame) -> DataFrame:
    """CLEAN, CHECK (no rating or id) or REVIEW (personal data left in notes, qualifications or an unredacted counsellor id);
    a counsellor id that is no marker is redacted afterwards."""
    left = has_pii(F.col("assessment_notes")) | has_pii(F.col("qualifications"))
    staff = F.coalesce(F.col("counsellor_id"), F.lit("")) if "counsellor_id" in records.columns else F.lit("")
    marked = staff.contains("REDACTED") | staff.contains("COUNSELLOR_ID")
    hidden = F.when((staff != "") & ~marked, "[NAME_REDACTED]").otherwise(staff)
    named = has_pii(hidden) & ~hidden.contains("REDACTED")
    flag = F.when(left | named, "REVIEW").when((F.col("rating") == "") | (F.col("crm_id") == ""), "CHECK").otherwise("CLEAN")
    issues = F.concat_ws("; ", F.when(left, "PII not fully redacted"), F.when(named, "counsellor id"))
    out = records.withColumn("quality_flag", flag).withColumn("pii_issues", issues)
    return out.withColumn("counsellor_id", hidden) if "counsellor_id" in records.columns else out


def quality_summary(flagged: DataFrame) -> DataFrame:
    """(kind, name, n): the total, counts per flag and per rating, and rows with personal data left in any text column."""
    texts = [f.name for f in flagged.schema if f.dataType.typeName() == "string" and f.name not in ("quality_flag", "pii_issues")]
    leak = F.lit(False)
    for c in texts:
        leak = leak | has_pii(F.col(c))
    parts = [("total", F.lit("")), ("flag", F.col("quality_flag")), ("rating", F.col("rating")), ("pii_left", F.when(leak, ""))]
    rows = F.explode(F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in parts)), lambda x: x["name"].isNotNull()))
    return flagged.select(rows.alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def subject_fallback(records: DataFrame, subject: str = "subject") -> DataFrame:
    """Id, rating and (redacted) counsellor from the mail subject where fields lack them."""
    named = F.regexp_extract(subject, r"-\s*[^-]+?\s*-\s*(Cold|Good|Excellent)", 1)
    number = F.regexp_extract(subject, r"\b(\d{6})\b", 1)
    no_name = F.coalesce(F.col("counsellor_id"), F.lit("")) == ""

    def filled(c: str, other: Column) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) == "", other).otherwise(F.col(c))

    return records.select(
        *(c for c in records.columns if c not in ("crm_id", "rating", "counsellor_id")),
        filled("crm_id", number).alias("crm_id"), F.when(no_name & (named != ""), filled("rating", named)).otherwise(F.coalesce("rating", F.lit(""))).alias("rating"),
        F.when(no_name & (named != ""), "[NAME_REDACTED]").otherwise(F.coalesce("counsellor_id", F.lit(""))).alias("counsellor_id"),
    )
