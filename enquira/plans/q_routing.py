"""Routing queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from enquira.operators import routing as R
from enquira.operators.scoring import score_label
from enquira.sources.shared import shared_folder
from enquira.streaming.answers import IndexSnapshot, answer_stream

from .adapters import table, view
from .entries import query
from .q_retrieval import BOTH, SCORED, faq, gold, scored_hits

_Q = "' ' || regexp_replace(lower({c}), '\\bof course\\b', ' ', 'g') || ' '"


def _hit(c: str, w: str) -> str:
    return f"regexp_matches({_Q.format(c=c)}, '[^\\w]{re.escape(w)}[^\\w]')".replace("\\ ", " ")


def _groups(c: str) -> str:
    return "concat_ws(';', " + ", ".join(
        f"nullif('g{n}:' || concat_ws('/', {', '.join(f'CASE WHEN {_hit(c, w)} THEN ' + chr(39) + w + chr(39) + ' END' for w in words)}), 'g{n}:')" for n, words in enumerate(R.INTENTS)
    ) + ")"


def _n_groups(c: str) -> str:
    return " + ".join("CASE WHEN " + " OR ".join(_hit(c, w) for w in words) + " THEN 1 ELSE 0 END" for words in R.INTENTS)


_UNION = "(SELECT event_id AS id, user_msg AS q FROM a_turns UNION ALL SELECT -1 - conv_id * 100 - turn AS id, text AS q FROM conversations WHERE role = 'user')"


def _queries(spark, d):
    talk = table(spark, d, "conversations").where("role = 'user'").select((-1 - F.col("conv_id") * 100 - F.col("turn")).alias("id"), F.col("text").alias("q"))
    return view(spark, d, "a_turns").select(F.col("event_id").alias("id"), F.col("user_msg").alias("q")).unionByName(talk)


@query("intent_groups", f"SELECT id, {_groups('q')} AS groups FROM {_UNION}", ("a_turns",))
def intent_groups(spark, d):
    shown = F.array_join(F.transform(R.intent_groups(F.col("q")), lambda g: F.concat(F.lit("g"), g["group"].cast("string"), F.lit(":"), F.array_join(g["keywords"], "/"))), ";")
    return _queries(spark, d).select("id", shown.alias("groups"))


@query("multi_intent", f"SELECT id, ({_n_groups('q')}) > 2 AS multi FROM {_UNION}", ("a_turns",))
def multi_intent(spark, d):
    return _queries(spark, d).select("id", R.multi_intent(F.col("q")).alias("multi"))


_LAB = "CASE WHEN rule_score < CAST(1 AS DOUBLE) / 3 THEN 'Cold' WHEN rule_score < CAST(2 AS DOUBLE) / 3 THEN 'Warm' ELSE 'Hot' END"


def _audit(spark, d):
    return view(spark, d, "a_px").select(
        "id", score_label(F.col("rule_score")).alias("label"), (F.col("id") % 5 == 0).alias("abstained"),
        (F.col("id") % 11 == 0).alias("forced"), (F.col("id") % 4 != 0).alias("has"), (F.col("id") % 100 / 250.0).alias("conf"),
    )


_AUD = f"(SELECT id, {_LAB} AS label, id % 5 = 0 AS abstained, id % 11 = 0 AS forced, id % 4 <> 0 AS has, CAST(id % 100 AS DOUBLE) / 250 AS conf FROM a_px)"


@query("decide_escalation", f"SELECT id, abstained OR label = 'Hot' AS escalate, CASE WHEN label = 'Hot' THEN 'high' WHEN abstained THEN 'normal' ELSE 'none' END AS priority FROM {_AUD}", ("a_px",))
def decide_escalation(spark, d):
    r = _audit(spark, d)
    return r.select("id", R.escalate(r.label, r.abstained).alias("escalate"), R.priority(r.label, r.abstained).alias("priority"))


_DEC = """CASE WHEN forced AND (NOT has OR conf < 0.15) THEN 'abstain: guard, gate would also have fired' WHEN forced THEN 'abstain: guard, gate would not have fired'
  WHEN NOT has THEN 'abstain: no hits' WHEN conf < 0.15 THEN 'abstain: low confidence' ELSE 'answer' END"""


@query(
    "decision_audit",
    f"""SELECT id, coalesce(nullif(concat_ws(',', CASE WHEN forced THEN 'multi_intent_guard' END, CASE WHEN NOT has THEN 'no_retrieval_hits' END, CASE WHEN has AND conf < 0.15 THEN 'low_confidence' END, CASE WHEN label = 'Hot' THEN 'hot_lead' END), ''), 'none') AS reasons, {_DEC} AS decision FROM {_AUD}""",
    ("a_px",),
)
def decision_audit(spark, d):
    r = _audit(spark, d)
    return r.select("id", F.array_join(R.reasons(r.forced, r.has, r.conf, r.label), ",").alias("reasons"), R.decision(r.forced, r.has, r.conf).alias("decision"))


@query(
    "route_answers",
    f"""SELECT query_id, abstained, conf AS confidence, CASE WHEN NOT abstained THEN answer || ' (Source: ''' || question || ''')' END AS answer, CASE WHEN NOT abstained THEN question END AS cited,
      CASE WHEN abstained THEN 'General Enquiries' ELSE faq_category END AS category, institution, n_candidates, {_DEC} AS decision FROM (SELECT *, forced OR NOT has OR conf < 0.15 AS abstained FROM (
        SELECT g.query_id, ({_n_groups('g.query')}) > 2 AS forced, h.idx IS NOT NULL AS has, coalesce(h.score, 0) AS conf, c.answer, c.question, c.category AS faq_category, c.institution, coalesce(n.n, 0) AS n_candidates
        FROM a_gold g LEFT JOIN (SELECT * FROM ({SCORED}) WHERE rank = 1) h ON g.query_id = h.query_id LEFT JOIN a_corpus c ON h.idx = c.idx LEFT JOIN (SELECT query_id, count(*) AS n FROM ({SCORED}) GROUP BY query_id) n ON n.query_id = g.query_id))""",
    BOTH,
)
def route_answers(spark, d):
    return R.route_answers(gold(spark, d), scored_hits(spark, d), faq(spark, d), F.lit("General Enquiries"))


#: The lead label of a query, as in the view below.
_LEAD = "CASE WHEN g.query_id % 7 = 0 THEN 'Hot' ELSE 'Warm' END"
_ROWS = f"""SELECT query_id, conf AS top1, CAST(0.15 AS DOUBLE) AS gate, shown AS groups, n_groups, forced AS guard_fired, abstained, {_DEC} AS decision,
  coalesce(nullif(concat_ws(',', CASE WHEN forced THEN 'multi_intent_guard' END, CASE WHEN NOT has THEN 'no_retrieval_hits' END, CASE WHEN has AND conf < 0.15 THEN 'low_confidence' END, CASE WHEN label = 'Hot' THEN 'hot_lead' END), ''), 'none') AS reasons,
  abstained OR label = 'Hot' AS escalate, CASE WHEN label = 'Hot' THEN 'high' WHEN abstained THEN 'normal' ELSE 'none' END AS priority,
  CASE WHEN NOT abstained THEN idx END AS faq_id, CASE WHEN NOT abstained THEN question END AS title, CASE WHEN abstained THEN 'cat_1' ELSE faq_category END AS category, CASE WHEN NOT abstained THEN institution END AS institution,
  CASE WHEN abstained THEN 'classifier' ELSE 'retrieval' END AS category_source, n_candidates, expected_rank, category = 'cat_1' AS expected_by_classifier FROM (SELECT *, forced OR NOT has OR conf < 0.15 AS abstained FROM (
    SELECT g.query_id, g.category, {_LEAD} AS label, {_groups('g.query')} AS shown, {_n_groups('g.query')} AS n_groups, ({_n_groups('g.query')}) > 2 AS forced, h.idx IS NOT NULL AS has, coalesce(h.score, 0) AS conf, h.idx, c.question, c.category AS faq_category, c.institution, coalesce(n.n, 0) AS n_candidates, e.expected_rank
    FROM a_gold g LEFT JOIN (SELECT * FROM ({SCORED}) WHERE rank = 1) h ON g.query_id = h.query_id LEFT JOIN a_corpus c ON h.idx = c.idx LEFT JOIN (SELECT query_id, count(*) AS n FROM ({SCORED}) GROUP BY query_id) n ON n.query_id = g.query_id
    LEFT JOIN (SELECT s.query_id, min(s.rank) AS expected_rank FROM ({SCORED}) s JOIN a_gold x ON s.query_id = x.query_id JOIN a_corpus k ON s.idx = k.idx AND k.category = x.category GROUP BY s.query_id) e ON e.query_id = g.query_id))"""


def _audit_of(queries, hits, corpus):
    label = F.when(F.col("query_id") % 7 == 0, "Hot").otherwise("Warm")
    rows = R.audit_rows(queries, hits, corpus, F.lit("cat_1"), label, F.col("category"))
    shown = F.array_join(F.transform("groups", lambda g: F.concat(F.lit("g"), g["group"].cast("string"), F.lit(":"), F.array_join(g["keywords"], "/"))), ";")
    return rows.withColumn("groups", shown).withColumn("reasons", F.array_join("reasons", ","))


@query("audit_rows", _ROWS, BOTH)
def audit_rows(spark, d):
    """One audit row per query."""
    return _audit_of(gold(spark, d), scored_hits(spark, d), faq(spark, d))


@query("stream_audit", _ROWS, BOTH)
def stream_audit(spark, d):
    """The same rows from a stream of files, against a stored index."""
    folder = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    rows = gold(spark, d)
    rows.repartitionByRange(3, "query_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return answer_stream(stream, IndexSnapshot.build(faq(spark, d), f"{folder}/index"), _audit_of, folder)
