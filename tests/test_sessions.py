"""Traces, entries and transcripts of sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from enquira.operators import sessions as S

SCHEMA = "session_id string, user_id long, event_id long, ts timestamp, category string, user_msg string"


def at(minute):
    return dt.datetime(2026, 1, 1, 10) + dt.timedelta(minutes=minute)


ROWS = [
    ("a", 1, 1, at(0), "Entry Requirements", "I can self-fund up to £20,000"), ("a", 1, 2, at(4), "Fees & Funding", "my budget is 12k"), ("a", 1, 3, at(10), "English Language", None),
    ("b", 2, 4, at(100), "Scholarships", "is there a scholarship"), ("c", 3, 5, at(100), None, ""),
]


def test_sessions_without_turns_and_clarity(spark):
    opened = spark.createDataFrame([("a", 1), ("new", 2), ("new", 3), (None, 4)], "session_id string, label int")
    rows = S.clarity_trace(S.score_per_turn(spark.createDataFrame(ROWS, SCHEMA), sessions=opened)).collect()
    got = {(r.session_id, r.turn_no): r for r in rows}
    assert len(rows) == 6 and got["new", 0].label == S.NO_TURNS and not got["new", 0].escalate and got["new", 0].ml_score is None and got["new", 0].event_id is None
    assert [(got["a", n].funding_tier, got["a", n].clarity_contribution, got["a", n].clarity_detail) for n in (1, 2, 3)] == [(3, 0.2, "level=3"), (2, 0.066, "level=2"), (2, 0.066, "level=2")]
    assert [got["a", n].funding_method_present for n in (1, 2, 3)] == [0, 1, 1] and got["b", 1].clarity_contribution == 0.0


def test_closing_evidence_is_the_last_running_row(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    last = {r.session_id: r.asDict() for r in S.running_evidence(turns).orderBy("turn_no").collect()}
    for r in S.closing_evidence(turns).collect():
        assert {n: r[n] for n in S.RUNNING} == {n: last[r.session_id][n] for n in S.RUNNING}


def test_open_and_closed_leads(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.session_id: r for r in S.lead_entries(turns, F.lit(at(110))).collect()}
    assert got["a"].closed_at == at(10) and got["a"].exported_at is None and got["b"].closed_at is None and got["b"].exported_at == at(110)
    assert got["a"].started_at == at(0) and got["a"].turns == 3 and got["a"].final_rule_score == 0.5
    archive = S.lead_archive(turns, latest=2).collect()
    assert sorted(r.session_id for r in archive) == ["b", "c"]
    first = S.lead_archive(turns).where("session_id = 'a'").first()
    assert first.transcript == ["I can self-fund up to £20,000", "my budget is 12k", None] and first.topics[0] == "Entry Requirements" and S.lead_archive(turns).where("session_id = 'c'").first().topics == ["General Enquiries"]
    assert S.lead_archive(turns.limit(0)).count() == 0 and S.lead_entries(turns.limit(0), F.lit(at(0))).count() == 0


def test_transcript_with_and_without_signals(spark):
    said = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "user", None), (1, 3, "user", "d")], "conv_id int, turn int, role string, text string")
    known = spark.createDataFrame([(1, 2, "Visa & Immigration", 0.4, True, "high", "Hot", 0.9, "tfidf")], "conv_id int, turn int, category string, confidence double, " + ", ".join(f"{n} {k}" for n, k in S.DECISION.items()))
    rows = S.turn_pairs(said, known).orderBy("turn").collect()
    assert [(r.turn_no, r.reply, r.category, r.confidence, r.escalate, r.priority, r.lead_score) for r in rows] == [
        (1, "", "", 0.0, None, "", None), (2, "", "Visa & Immigration", 0.4, True, "high", 0.9), (3, "", "", 0.0, None, "", None)
    ]
