"""Session features and scores from chat turns (session_id, event_id, ts, category, user_msg).

Turns are ordered by (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from enquira.functions.funding import funding_tier
from enquira.functions.text import word_count

from .scoring import WEIGHTS, english_part, hybrid_score, proba_to_score, score_label

# Topics of a chat.
CATEGORIES = [
    "Program Details", "Fees & Funding", "Entry Requirements", "Accommodation", "Scholarships",
    "English Language", "Visa & Immigration", "Application Process", "General Enquiries",
]
ORDER = ["ts", "event_id"]


def category() -> Column:
    return F.when(F.col("category").isin(CATEGORIES), F.col("category")).otherwise("General Enquiries")


def category_entropy(turns: DataFrame) -> DataFrame:
    """Entropy in bits of each session's topics: counts per topic first, then per session."""
    counts = turns.groupBy("session_id", category().alias("c")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("session_id"))
    parts = counts.select("session_id", (F.col("n") / total).alias("p"))
    return parts.groupBy("session_id").agg(F.round(F.abs(F.sum(-F.col("p") * F.log2("p"))), 4).alias("category_entropy"))


def category_counts(turns: DataFrame) -> DataFrame:
    """Turns per topic, with the position at which it was first seen."""
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy(*ORDER))
    rows = turns.select("session_id", category().alias("category"), pos.alias("pos"))
    return rows.groupBy("session_id", "category").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def session_features(turns: DataFrame) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("session_id").orderBy(*ORDER))
    delay = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6
    rows = turns.withColumn("_delay", F.when(before.isNotNull(), F.greatest(delay, F.lit(0.0))))
    per = rows.groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.sum(word_count(F.col("user_msg"))).alias("session_word_count"),
        F.round(F.avg("_delay"), 2).alias("mean_response_delay"), F.max(F.when(F.col("category") == "Visa & Immigration", 1).otherwise(0)).alias("visa_intent_mentioned"),
    )
    return per.join(category_entropy(turns), "session_id").withColumn("returning_session", F.lit(0))


def seen(*names: str) -> Column:
    return F.when(F.col("category").isin(*names), 1).otherwise(0)


EVIDENCE = {
    "has_course": ("Entry Requirements",), "has_intake": ("Application Process",), "has_english_test": ("English Language",),
    "funding_method_present": ("Fees & Funding", "Scholarships"), "visa_intent_mentioned": ("Visa & Immigration",),
}


def rubric_evidence(turns: DataFrame) -> DataFrame:
    per = turns.groupBy("session_id").agg(*(F.max(seen(*topics)).alias(n) for n, topics in EVIDENCE.items()))
    return per.withColumn("english_band", F.lit(0.0))


def live_rule(has_course: Column, has_intake: Column, has_test: Column, band: Column) -> Column:
    """The share of the rubric that a chat can show, of its weight 0.18."""
    got = F.when(has_course == 1, 0.05).otherwise(0.0) + F.when(has_intake == 1, 0.05).otherwise(0.0) + F.round(english_part(has_test, band), 4)
    return F.round(got / 0.18, 6)


def live_rule_score(evidence: DataFrame) -> DataFrame:
    return evidence.select("session_id", live_rule(F.col("has_course"), F.col("has_intake"), F.col("has_english_test"), F.col("english_band")).alias("rule_score"))


def funding_tier_last(turns: DataFrame) -> DataFrame:
    """The tier of the last turn that names a method and an amount, 0 without any."""
    rows = turns.withColumn("_tier", funding_tier(F.col("user_msg")))
    last = F.max_by("_tier", F.when(F.col("_tier").isNotNull(), F.struct(*ORDER)))
    return rows.groupBy("session_id").agg(F.coalesce(last, F.lit(0)).alias("funding_tier"))


#: What is known after a turn: flags, the last funding tier, and the engagement so far.
RUNNING = ["turn_no", *EVIDENCE, "funding_tier", "session_word_count", "mean_response_delay", "category_entropy"]


def entropy_of(counts: list[Column]) -> Column:
    """Entropy in bits of counts per topic."""
    total = sum(counts[1:], counts[0])
    parts = [F.when(n > 0, -(n / total) * F.log2(n / total)).otherwise(0.0) for n in counts]
    return F.round(F.abs(sum(parts[1:], parts[0])), 4)


def running_evidence(turns: DataFrame) -> DataFrame:
    """``RUNNING`` after every turn, by running windows."""
    ordered = Window.partitionBy("session_id").orderBy(*ORDER)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag("ts").over(ordered)
    delay = F.greatest((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6, F.lit(0.0))
    rows = turns.withColumn("_delay", F.when(before.isNotNull(), delay)).withColumn("_tier", funding_tier(F.col("user_msg"))).withColumn("_topic", category())
    return rows.select(
        "session_id", *ORDER, F.count("*").over(so_far).alias("turn_no"), *(F.max(seen(*topics)).over(so_far).alias(n) for n, topics in EVIDENCE.items()),
        F.coalesce(F.last("_tier", ignorenulls=True).over(so_far), F.lit(0)).alias("funding_tier"), F.sum(word_count(F.col("user_msg"))).over(so_far).alias("session_word_count"),
        F.round(F.avg("_delay").over(so_far), 2).alias("mean_response_delay"), entropy_of([F.count_if(F.col("_topic") == c).over(so_far) for c in CATEGORIES]).alias("category_entropy"),
    )


def with_scores(rows: DataFrame, predict=None, alpha: float = 0.5) -> DataFrame:
    """Rule, model and blended score, label and escalation of rows of ``RUNNING`` evidence, batch or streaming.

    ``predict`` adds ml_score to a table with evidence, ``engagement_`` and ``flags_`` columns; without it the rule decides.
    """
    rows = rows.withColumn("rule_score", live_rule(F.col("has_course"), F.col("has_intake"), F.col("has_english_test"), F.lit(0.0)))
    if predict is None:
        rows = rows.withColumn("ml_score", F.lit(None).cast("double"))
    else:
        live = {
            "engagement_message_count": F.col("turn_no"), "engagement_session_word_count": F.col("session_word_count"), "engagement_avg_delay_s": F.col("mean_response_delay"),
            "engagement_question_category_entropy": F.col("category_entropy"), "engagement_returning_session": F.lit(0), "flags_visa_intent_mentioned": F.col("visa_intent_mentioned"),
            "funding_clarity": F.col("funding_tier"),
        }
        rows = predict(rows.withColumns(live)).drop(*live)
    rows = rows.withColumn("hybrid_score", F.round(hybrid_score(F.col("rule_score"), F.col("ml_score"), alpha), 6))
    rows = rows.withColumn("label", score_label(F.col("hybrid_score")))
    return rows.withColumn("escalate", F.col("label") == "Hot").withColumn("priority", F.when(F.col("label") == "Hot", "high").otherwise("none"))


def model_score(model, medians: dict, modes: dict):
    """A ``predict`` for ``with_scores`` from a trained model and a training table's values."""
    from .matrix import inference_matrix
    from .models import PROBABILITIES, predict_proba

    def predict(live: DataFrame) -> DataFrame:
        own = F.struct("*").alias("own_row")
        found = predict_proba(model, inference_matrix(live.select(own, "*"), medians, modes, model.names))
        return found.select("own_row.*", proba_to_score(*map(F.col, PROBABILITIES)).alias("ml_score"))

    return predict


NO_TURNS = "Awaiting first message"


def score_per_turn(turns: DataFrame, predict=None, alpha: float = 0.5, sessions: DataFrame | None = None) -> DataFrame:
    """Evidence, scores, label and escalation after every turn, by running windows.

    With ``sessions`` (session_id, further columns are not read) a session without turns has one row: turn 0, scores of 0 that no
    model has a part in, the label ``NO_TURNS``."""
    scored = with_scores(running_evidence(turns), predict, alpha)
    return scored if sessions is None else scored.unionByName(awaiting(sessions, turns), allowMissingColumns=True)


def awaiting(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """The rows of sessions without turns."""
    none = sessions.select("session_id").where("session_id is not null").distinct().join(turns.select("session_id"), "session_id", "left_anti")
    zeros = {"turn_no": F.lit(0).cast("long"), **{n: F.lit(0) for n in EVIDENCE}, "funding_tier": F.lit(0), "session_word_count": F.lit(0).cast("long")}
    scores = {"rule_score": F.lit(0.0), "hybrid_score": F.lit(0.0), "label": F.lit(NO_TURNS), "escalate": F.lit(False), "priority": F.lit("none")}
    return none.select("session_id", *(c.alias(n) for n, c in (zeros | scores).items()))


def clarity_trace(scored: DataFrame) -> DataFrame:
    """Scored turns with what the rubric of the whole form gives for the funding that is known by then, its weight there, and the level.
    The score of a chat leaves that part out."""
    tier = F.col("funding_tier")
    weight = WEIGHTS["funding_clarity"]
    got = F.round(F.when(tier == 3, weight).when(tier == 2, 0.33 * weight).otherwise(0.0), 4)
    return scored.withColumns({"clarity_contribution": got, "clarity_weight": F.lit(weight), "clarity_detail": F.concat(F.lit("level="), tier.cast("string"))})


def closing_evidence(turns: DataFrame) -> DataFrame:
    """``RUNNING`` after the last turn of each session, with started_at and last_at.  Partial sums, no window: as the turns are in order, the
    mean delay is the time from the first to the last over the number of steps."""
    tier = funding_tier(F.col("user_msg"))
    seconds = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    steps = F.count("*") - 1
    return turns.withColumn("_tier", tier).withColumn("_topic", category()).groupBy("session_id").agg(
        F.count("*").alias("turn_no"), *(F.max(seen(*topics)).alias(n) for n, topics in EVIDENCE.items()),
        F.coalesce(F.max_by("_tier", F.when(F.col("_tier").isNotNull(), F.struct(*ORDER))), F.lit(0)).alias("funding_tier"), F.sum(word_count(F.col("user_msg"))).alias("session_word_count"),
        F.round(F.when(steps > 0, seconds / steps), 2).alias("mean_response_delay"), entropy_of([F.count_if(F.col("_topic") == c) for c in CATEGORIES]).alias("category_entropy"),
        F.min("ts").alias("started_at"), F.max("ts").alias("last_at"),
    )


def lead_entries(turns: DataFrame, exported_at: Column, idle: str = "30 minutes", predict=None, alpha: float = 0.5) -> DataFrame:
    """The last state of every lead at the time ``exported_at``: rule, hybrid, label, turns, started_at.  A lead without a turn for ``idle``
    is closed, closed_at is its last turn; an open one has exported_at in its place."""
    rows = with_scores(closing_evidence(turns), predict, alpha)
    is_closed = F.col("last_at") + F.expr(f"INTERVAL {idle}") <= exported_at
    return rows.select(
        "session_id", F.round("rule_score", 4).alias("final_rule_score"), F.round("hybrid_score", 4).alias("final_hybrid_score"), F.col("label").alias("final_label"),
        F.col("turn_no").alias("turns"), "started_at", F.when(is_closed, F.col("last_at")).alias("closed_at"), F.when(~is_closed, exported_at).alias("exported_at"),
    )


def lead_archive(turns: DataFrame, latest: int = 5, predict=None, alpha: float = 0.5) -> DataFrame:
    """Closing snapshots of the sessions that ended last, with what was said and the topic of each turn."""
    scored = with_scores(closing_evidence(turns), predict, alpha)
    per = scored.select("session_id", F.col("turn_no").alias("turns"), "rule_score", "hybrid_score", "label", "started_at", F.col("last_at").alias("closed_at"))
    top = per.orderBy(F.col("closed_at").desc(), "session_id").limit(latest)
    said = turns.join(F.broadcast(top.select("session_id")), "session_id")  # at most ``latest`` ids
    texts = said.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "user_msg", category().alias("topic")))).alias("said"))
    joined = top.join(texts, "session_id")
    return joined.withColumn("transcript", F.transform("said", lambda x: x["user_msg"])).withColumn("topics", F.transform("said", lambda x: x["topic"])).drop("said")


#: What a transcript tells of the answer to a turn, besides category and confidence.
DECISION = {"escalate": "boolean", "priority": "string", "lead_label": "string", "lead_score": "double", "retrieval_backend": "string"}


def turn_pairs(messages: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """One row per user turn with the assistant turn that follows it, "" without one.

    ``signals``, one row per (conv_id, turn), adds the classifier's category and confidence and the columns of ``DECISION``.  A
    turn without signals has "" as its category, 0 as its confidence, and no decision: "" in texts, NULL otherwise."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("_r"), F.lead("text").over(w).alias("_t"))
    reply = F.when(F.col("_r") == "assistant", F.coalesce("_t", F.lit(""))).otherwise("")
    pairs = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_msg"), reply.alias("reply"))
    if signals is None:
        return pairs
    number = F.row_number().over(w).cast("long")
    joined = pairs.withColumn("turn_no", number).join(signals.select("conv_id", "turn", "category", "confidence", *DECISION), ["conv_id", "turn"], "left")
    blank = {n: F.coalesce(n, F.lit("")) for n in ["category", *(n for n, kind in DECISION.items() if kind == "string")]}
    return joined.withColumns(blank | {"confidence": F.coalesce("confidence", F.lit(0.0))})
