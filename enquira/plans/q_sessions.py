"""Session queries, batch and streaming."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from enquira.functions import funding as M
from enquira.operators import routing as R
from enquira.operators import sessions as S
from enquira.sources.shared import shared_folder
from enquira.streaming import sessions as X

from .adapters import table, view
from .entries import query

TURNS = ("a_turns",)
_VISA = "Visa & Immigration"
_ENT = """SELECT session_id, round(abs(sum(-p * log2(p))), 4) AS category_entropy FROM (
  SELECT session_id, n::DOUBLE / sum(n) OVER (PARTITION BY session_id) AS p FROM (SELECT session_id, category, count(*) AS n FROM a_turns GROUP BY session_id, category)) GROUP BY session_id"""


def turns(spark, d):
    return view(spark, d, "a_turns")


@query("category_entropy", _ENT, TURNS)
def category_entropy(spark, d):
    return S.category_entropy(turns(spark, d))


@query(
    "category_counts",
    "SELECT session_id, category, count(*) AS n, min(pos) AS first_pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS pos FROM a_turns) GROUP BY session_id, category",
    TURNS,
)
def category_counts(spark, d):
    return S.category_counts(turns(spark, d))


@query(
    "session_features",
    f"""SELECT s.*, e.category_entropy, 0 AS returning_session FROM (SELECT session_id, count(*) AS message_count, CAST(sum(len(regexp_extract_all(user_msg, '\\S+'))) AS BIGINT) AS session_word_count,
      round(avg(delay), 2) AS mean_response_delay, max(CASE WHEN category = '{_VISA}' THEN 1 ELSE 0 END) AS visa_intent_mentioned FROM (
        SELECT *, greatest((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id)))::DOUBLE / 1000000, CASE WHEN lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) IS NULL THEN NULL ELSE 0 END) AS delay FROM a_turns)
      GROUP BY session_id) s JOIN ({_ENT}) e ON s.session_id = e.session_id""",
    TURNS,
)
def session_features(spark, d):
    return S.session_features(turns(spark, d))


def _flag(*names: str) -> str:
    return "CASE WHEN category IN ({}) THEN 1 ELSE 0 END".format(", ".join(f"'{n}'" for n in names))


_EVID = "SELECT session_id, " + ", ".join(f"max({_flag(*t)}) AS {n}" for n, t in S.EVIDENCE.items()) + ", CAST(0 AS DOUBLE) AS english_band FROM a_turns GROUP BY session_id"
_RULE = "round((CAST(0.05 AS DOUBLE) * has_course + CAST(0.05 AS DOUBLE) * has_intake + CAST(0.04 AS DOUBLE) * has_english_test) / CAST(0.18 AS DOUBLE), 6)"
_LABEL = "CASE WHEN rule_score < CAST(1 AS DOUBLE) / 3 THEN 'Cold' WHEN rule_score < CAST(2 AS DOUBLE) / 3 THEN 'Warm' ELSE 'Hot' END"


@query("rubric_evidence", _EVID, TURNS)
def rubric_evidence(spark, d):
    return S.rubric_evidence(turns(spark, d))


@query("live_rule_score", f"SELECT session_id, {_RULE} AS rule_score FROM ({_EVID})", TURNS)
def live_rule_score(spark, d):
    return S.live_rule_score(S.rubric_evidence(turns(spark, d)))


_FIGURES = f"list_min(list_transform(regexp_extract_all(user_msg, '{M.AMOUNT}'), lambda m: TRY_CAST(replace(regexp_extract(m, '{M.NUMBER}'), ',', '') AS DOUBLE) * CASE WHEN regexp_matches(m, '(?i)k$') THEN 1000 ELSE 1 END))"
_VALUES = "CASE w " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in M.WORD_VALUES.items()) + " ELSE 0 END"
_WORDS = f"list_sum(list_transform(regexp_extract_all(regexp_extract(lower(user_msg), '{M.PHRASE}', 1), '[a-z]+'), lambda w: {_VALUES}))"
_AMOUNT = f"coalesce({_FIGURES}, CASE regexp_extract(lower(user_msg), '{M.PHRASE}', 2) WHEN 'hundred' THEN {_WORDS} * CAST(100 AS DOUBLE) WHEN 'thousand' THEN {_WORDS} * CAST(1000 AS DOUBLE) END)"
_METHOD = "(" + " OR ".join(f"contains(replace(lower(user_msg), '-', ' '), '{m}')" for m in M.METHODS) + ")"
_TIER = f"CASE WHEN {_METHOD} AND {_AMOUNT} IS NOT NULL THEN CASE WHEN {_AMOUNT} < 10000 THEN 1 WHEN {_AMOUNT} < 20000 THEN 2 ELSE 3 END END"


@query("funding_amount", f"SELECT event_id, {_AMOUNT} AS amount FROM a_turns", TURNS)
def funding_amount(spark, d):
    return turns(spark, d).select("event_id", M.funding_amount(F.col("user_msg")).alias("amount"))


@query(
    "funding_tier_last",
    f"SELECT session_id, coalesce(arg_max(tier, pos) FILTER (WHERE tier IS NOT NULL), 0) AS funding_tier FROM (SELECT session_id, {_TIER} AS tier, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS pos FROM a_turns) GROUP BY session_id",
    TURNS,
)
def funding_tier_last(spark, d):
    return S.funding_tier_last(turns(spark, d))


def _run(n: str) -> str:
    return f"max({_flag(*S.EVIDENCE[n])}) OVER w AS {n}"


_PER_TURN = f"""SELECT *, {_LABEL} AS label, rule_score >= CAST(2 AS DOUBLE) / 3 AS escalate, CASE WHEN rule_score >= CAST(2 AS DOUBLE) / 3 THEN 'high' ELSE 'none' END AS priority FROM (SELECT *, {_RULE} AS rule_score FROM (
  SELECT session_id, ts, event_id, count(*) OVER w AS turn_no, {_run('has_course')}, {_run('has_intake')}, {_run('has_english_test')}, coalesce(last_value(tier IGNORE NULLS) OVER w, 0) AS funding_tier
  FROM (SELECT *, {_TIER} AS tier FROM a_turns) WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))"""


#: Sessions that were opened, most of them without a turn.
_OPENED = "SELECT concat(CAST(c_custkey AS STRING), '-2024-01-0') AS session_id FROM customer"

_TURN_COLUMNS = ["session_id", "event_id", "turn_no", "has_course", "has_intake", "has_english_test", "funding_tier", "rule_score", "hybrid_score", "label", "escalate", "priority"]


@query("score_per_turn", f"SELECT * EXCLUDE (ts), rule_score AS hybrid_score FROM ({_PER_TURN})", TURNS)
def score_per_turn(spark, d):
    return S.score_per_turn(turns(spark, d)).select(*_TURN_COLUMNS)


@query("score_per_turn_model")
def score_per_turn_model(spark, d):
    """Scores of every turn with a regression over leads and sessions in the blend."""
    from enquira.operators import matrix as X
    from enquira.operators import mltables as M
    from enquira.operators import models as P

    from .q_mltables import aligned

    rows = aligned(spark, d)
    matrix, names = X.build_matrix(rows)
    model = P.train_model(matrix, names, "logreg", iterations=20)
    predict = S.model_score(model, *X.imputation_values(M.imputation_table(rows)))
    return S.score_per_turn(turns(spark, d), predict).select(*_TURN_COLUMNS, "ml_score", "mean_response_delay", "category_entropy")


@query(
    "score_trace",
    f"""SELECT session_id, event_id, turn_no, funding_method_present, funding_tier, rule_score, rule_score AS hybrid_score, label, escalate, priority, CAST(CASE funding_tier WHEN 3 THEN 0.2 WHEN 2 THEN 0.066 ELSE 0 END AS DOUBLE) AS clarity_contribution,
      CAST(0.2 AS DOUBLE) AS clarity_weight, 'level=' || funding_tier AS clarity_detail FROM ({_PER_TURN.replace("coalesce(last_value", _run("funding_method_present") + ", coalesce(last_value")})
      UNION ALL SELECT session_id, NULL, 0, 0, 0, 0, 0, '{S.NO_TURNS}', false, 'none', 0, CAST(0.2 AS DOUBLE), 'level=0' FROM ({_OPENED}) WHERE session_id NOT IN (SELECT session_id FROM a_turns)""",
    TURNS,
)
def score_trace(spark, d):
    """Every turn with the part of funding in its score, and the sessions that nothing was said in yet."""
    said = turns(spark, d)
    opened = table(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("-2024-01-0")).alias("session_id"))
    scored = S.clarity_trace(S.score_per_turn(said, sessions=opened))
    return scored.select("session_id", "event_id", "turn_no", "funding_method_present", "funding_tier", "rule_score", "hybrid_score", "label", "escalate", "priority", "clarity_contribution", "clarity_weight", "clarity_detail")


def _at(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c.split('.')[-1]}"


def _times(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


_LAST = f"SELECT session_id, max(turn_no) AS turns, arg_max(rule_score, turn_no) AS rule_score, arg_max(label, turn_no) AS label, min(ts) AS started_at, max(ts) AS closed_at FROM ({_PER_TURN}) GROUP BY session_id"


@query(
    "lead_archive",
    f"""SELECT a.session_id, a.turns, a.rule_score, a.rule_score AS hybrid_score, a.label, {_at('a.started_at')}, {_at('a.closed_at')}, t.transcript, t.topics FROM (SELECT * FROM ({_LAST}) ORDER BY closed_at DESC, session_id LIMIT 5) a
      JOIN (SELECT session_id, string_agg(user_msg, '|' ORDER BY ts, event_id) AS transcript, string_agg(category, '|' ORDER BY ts, event_id) AS topics FROM a_turns GROUP BY session_id) t ON a.session_id = t.session_id""",
    TURNS,
)
def lead_archive(spark, d):
    rows = _times(S.lead_archive(turns(spark, d)), "started_at", "closed_at")
    return rows.select("session_id", "turns", "rule_score", "hybrid_score", "label", "started_at", "closed_at", F.array_join("transcript", "|").alias("transcript"), F.array_join("topics", "|").alias("topics"))


@query(
    "lead_entries",
    f"""SELECT session_id, round(rule_score, 4) AS final_rule_score, round(rule_score, 4) AS final_hybrid_score, label AS final_label, turns, {_at('started_at')}, CASE WHEN closed_at + INTERVAL 1 DAY <= now_ THEN 'closed' ELSE 'open' END AS state,
      strftime(CASE WHEN closed_at + INTERVAL 1 DAY <= now_ THEN closed_at END, '%Y-%m-%d %H:%M:%S') AS closed_at, strftime(CASE WHEN closed_at + INTERVAL 1 DAY > now_ THEN now_ END, '%Y-%m-%d %H:%M:%S') AS exported_at FROM ({_LAST}), (SELECT max(ts) AS now_ FROM a_turns)""",
    TURNS,
)
def lead_entries(spark, d):
    """All leads at the time of the last turn; those with a turn in the day before are open."""
    said = turns(spark, d)
    rows = S.lead_entries(said, F.lit(said.agg(F.max("ts")).first()[0]), "1 day")
    return _times(rows.withColumn("state", F.when(F.col("closed_at").isNull(), "open").otherwise("closed")), "started_at", "closed_at", "exported_at")


@query(
    "turn_pairs",
    """SELECT conv_id, turn, text AS user_msg, CASE WHEN r = 'assistant' THEN coalesce(t, '') ELSE '' END AS reply FROM (
      SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations) WHERE role = 'user'""",
)
def turn_pairs(spark, d):
    return S.turn_pairs(table(spark, d, "conversations"))


_N_GROUPS = " + ".join("CASE WHEN " + " OR ".join(rf"regexp_matches(regexp_replace(lower(text), '\bof course\b', ' ', 'g'), '(?:^|[^0-9A-Za-z_]){re.escape(w)}(?:[^0-9A-Za-z_]|$)')" for w in words) + " THEN 1 ELSE 0 END" for words in R.INTENTS)
_SIGNALS = f"""SELECT *, coalesce(forced OR confidence < 0.15, false) AS abstained, CASE conv_id % 7 WHEN 0 THEN 'Hot' WHEN 1 THEN 'Cold' ELSE 'Warm' END AS lead_label
  FROM (SELECT conv_id, turn, ({_N_GROUPS}) > 2 AS forced, CAST((conv_id + turn) % 100 AS DOUBLE) / 250 AS confidence FROM conversations WHERE conv_id % 5 <> 0)"""


@query(
    "transcript",
    f"""SELECT p.*, CASE WHEN s.conv_id IS NULL THEN '' WHEN s.abstained THEN 'General Enquiries' ELSE 'Entry Requirements' END AS category, coalesce(s.confidence, 0) AS confidence, s.abstained OR s.lead_label = 'Hot' AS escalate,
      CASE WHEN s.conv_id IS NULL THEN '' WHEN s.lead_label = 'Hot' THEN 'high' WHEN s.abstained THEN 'normal' ELSE 'none' END AS priority, coalesce(s.lead_label, '') AS lead_label, s.confidence AS lead_score, CASE WHEN s.conv_id IS NULL THEN '' ELSE 'tfidf' END AS retrieval_backend
    FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no, text AS user_msg, CASE WHEN r = 'assistant' THEN coalesce(t, '') ELSE '' END AS reply FROM (
      SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations) WHERE role = 'user') p LEFT JOIN ({_SIGNALS}) s ON p.conv_id = s.conv_id AND p.turn = s.turn""",
)
def transcript(spark, d):
    """All user turns with reply and decision; every fifth conversation is from before decisions were recorded."""
    messages = table(spark, d, "conversations")
    confidence = (F.col("conv_id") + F.col("turn")) % 100 / 250.0
    label = F.when(F.col("conv_id") % 7 == 0, "Hot").when(F.col("conv_id") % 7 == 1, "Cold").otherwise("Warm")
    known = messages.where("conv_id % 5 <> 0").select("conv_id", "turn", confidence.alias("confidence"), label.alias("lead_label"), F.coalesce(R.multi_intent(F.col("text")) | (confidence < R.GATE), F.lit(False)).alias("abstained"))
    signals = known.select(
        "*", F.when(F.col("abstained"), "General Enquiries").otherwise("Entry Requirements").alias("category"), R.escalate(F.col("lead_label"), F.col("abstained")).alias("escalate"),
        R.priority(F.col("lead_label"), F.col("abstained")).alias("priority"), F.col("confidence").alias("lead_score"), F.lit("tfidf").alias("retrieval_backend"),
    )
    return S.turn_pairs(messages, signals)


def _turn_stream(spark, d):
    """The turns as a stream of eight files by time, and a last turn of no session that closes all others: its time is so late
    that the watermark passes them."""
    path = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    rows = turns(spark, d).select("session_id", F.col("user_id").cast("long").alias("user_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "category", "user_msg")
    rows.repartitionByRange(8, "ts").write.parquet(path)
    end = rows.agg(F.lit("end").alias("session_id"), F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit("").alias("category"), F.lit("").alias("user_msg"))
    end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


_GAPS = """SELECT user_id, count(*) AS n_turns, count_if(category = 'Visa & Immigration') AS n_visa FROM (
  SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM a_turns)) GROUP BY user_id, s"""


@query("session_gaps", _GAPS, TURNS)
def session_gaps(spark, d):
    return X.stream_sessions(turns(spark, d)).select("user_id", "n_turns", "n_visa")


@query("stream_sessions", _GAPS, TURNS)
def stream_sessions(spark, d):
    found = X.run_to_table(spark, X.stream_sessions(_turn_stream(spark, d)), shared_folder(spark))
    return found.where("user_id >= 0").select("user_id", "n_turns", "n_visa")


@query("stream_score_per_turn", f"SELECT * EXCLUDE (ts), rule_score AS hybrid_score FROM ({_PER_TURN})", TURNS)
def stream_score_per_turn(spark, d):
    found = X.run_to_table(spark, X.stream_score_per_turn(_turn_stream(spark, d)), shared_folder(spark))
    return found.where("session_id <> 'end'").select(*_TURN_COLUMNS)
