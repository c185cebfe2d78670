"""Intent guard, answer or abstain, escalation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groups of words that show an intent.
INTENTS = [
    ["passport"],
    ["ielts", "english test", "english-test"],
    ["kcse", "grade", "mean grade", "b+", "c+", "gpa"],
    ["data science", "nursing", "business", "course", "degree", "masters", "programme", "program", "subject"],
    ["intake", "september", "january", "deadline", "when can i start", "when do i apply"],
]
MOST_INTENTS = 2
GATE = 0.15


def intent_groups(query: Column) -> Column:
    """Array of (group, keywords) with whole-word hits; "of course" is no hit for course."""
    q = F.regexp_replace(F.lower(query), r"\bof course\b", " ")
    groups = []
    for n, words in enumerate(INTENTS):
        found = F.array_compact(F.array(*(F.when(q.rlike(rf"(?<!\w){re.escape(w)}(?!\w)"), w) for w in words)))
        groups.append(F.when(F.size(found) > 0, F.struct(F.lit(n).alias("group"), found.alias("keywords"))))
    return F.array_compact(F.array(*groups))


def multi_intent(query: Column) -> Column:
    return F.size(intent_groups(query)) > MOST_INTENTS


def escalate(label: Column, abstained: Column) -> Column:
    return abstained | (label == "Hot")


def priority(label: Column, abstained: Column) -> Column:
    return F.when(label == "Hot", "high").when(abstained, "normal").otherwise("none")


def reasons(forced: Column, has_hits: Column, confidence: Column, label: Column, gate: float = GATE) -> Column:
    found = F.array_compact(F.array(
        F.when(forced, "multi_intent_guard"), F.when(~has_hits, "no_retrieval_hits"),
        F.when(has_hits & (confidence < gate), "low_confidence"), F.when(label == "Hot", "hot_lead"),
    ))
    return F.when(F.size(found) == 0, F.array(F.lit("none"))).otherwise(found)


def decision(forced: Column, has_hits: Column, confidence: Column, gate: float = GATE) -> Column:
    below = ~has_hits | (confidence < gate)
    return (
        F.when(forced & below, "abstain: guard, gate would also have fired").when(forced, "abstain: guard, gate would not have fired")
        .when(~has_hits, "abstain: no hits").when(below, "abstain: low confidence").otherwise("answer")
    )


def route_answers(queries: DataFrame, hits: DataFrame, faq: DataFrame, fallback: Column, gate: float = GATE) -> DataFrame:
    """One response per query: the top hit's answer with its source, or an abstention.

    ``hits`` has (query_id, idx, rank, score); ``fallback`` is the category on abstention."""
    top = hits.where("rank = 1").join(faq.select("idx", "question", "answer", F.col("category").alias("faq_category"), "institution"), "idx")
    kept = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "idx", "score"))).alias("candidates"))
    rows = queries.withColumn("_fallback", fallback).join(top.drop("rank"), "query_id", "left").join(kept, "query_id", "left")
    forced = multi_intent(F.col("query"))
    has = F.col("idx").isNotNull()
    confidence = F.coalesce("score", F.lit(0.0))
    abstained = forced | ~has | (confidence < gate)
    answer = F.when(~abstained, F.concat("answer", F.lit(" (Source: '"), "question", F.lit("')")))
    return rows.select(
        "query_id", abstained.alias("abstained"), confidence.alias("confidence"), answer.alias("answer"), F.when(~abstained, F.col("question")).alias("cited"),
        F.when(abstained, F.col("_fallback")).otherwise(F.col("faq_category")).alias("category"), "institution",
        F.coalesce(F.size("candidates"), F.lit(0)).alias("n_candidates"), decision(forced, has, confidence, gate).alias("decision"),
    )


def audit_rows(queries: DataFrame, hits: DataFrame, faq: DataFrame, fallback: Column, label: Column | None = None, expected: Column | None = None, gate: float = GATE) -> DataFrame:
    """One row per query with all that its decision rests on: top score and gate, intent groups and guard, reasons, decision, escalation, the
    cited question's id, title, category and institution, whether the category comes from retrieval or the classifier, and where the expected
    category stands (its best rank among the hits, NULL if it is not there; whether the classifier names it).

    ``hits`` has (query_id, idx, rank, score); ``fallback`` is the classifier's category, ``label`` the lead's, both of the query's row."""
    own = queries.select("query_id", "query", fallback.alias("_fallback"), (label if label is not None else F.lit(None).cast("string")).alias("_label"), (expected if expected is not None else F.lit(None).cast("string")).alias("_expected"))
    known = faq.select("idx", F.col("question").alias("_title"), F.col("category").alias("_category"), F.col("institution").alias("_institution"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "idx", "score", "_title", "_category", "_institution")))
    kept = hits.select("query_id", "idx", "rank", "score").join(known, "idx").groupBy("query_id").agg(listed.alias("_hits"))  # as many as the search keeps
    rows = own.join(kept, "query_id", "left").withColumn("_top", F.get("_hits", F.lit(0))).withColumn("groups", intent_groups(F.col("query")))
    forced, has = F.size("groups") > MOST_INTENTS, F.col("_top").isNotNull()
    confidence = F.coalesce("_top.score", F.lit(0.0))
    abstained = forced | ~has | (confidence < gate)
    lead = F.coalesce("_label", F.lit(""))
    place = F.array_min(F.transform(F.filter("_hits", lambda h: h["_category"] == F.col("_expected")), lambda h: h["rank"]))

    def cited(c: str) -> Column:
        return F.when(~abstained, F.col(f"_top.{c}"))

    return rows.select(
        "query_id", confidence.alias("top1"), F.lit(gate).alias("gate"), "groups", F.size("groups").alias("n_groups"), forced.alias("guard_fired"), abstained.alias("abstained"),
        decision(forced, has, confidence, gate).alias("decision"), reasons(forced, has, confidence, lead, gate).alias("reasons"),
        escalate(lead, abstained).alias("escalate"), priority(lead, abstained).alias("priority"),
        cited("idx").alias("faq_id"), cited("_title").alias("title"), F.when(abstained, F.col("_fallback")).otherwise(F.col("_top._category")).alias("category"), cited("_institution").alias("institution"),
        F.when(abstained, "classifier").otherwise("retrieval").alias("category_source"), F.coalesce(F.size("_hits"), F.lit(0)).alias("n_candidates"),
        place.alias("expected_rank"), (F.col("_fallback") == F.col("_expected")).alias("expected_by_classifier"),
    )
