"""Streams over several files against their batch twins."""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from enquira.operators import routing, sessions
from enquira.streaming import answers
from enquira.streaming import sessions as streams

SCHEMA = "session_id string, user_id long, event_id long, ts timestamp, category string, user_msg string"


def turn(session, event, minute, category="General Enquiries", said="hello there"):
    return (session, 1 if session == "a" else 2, event, dt.datetime(2026, 1, 1, 10) + dt.timedelta(minutes=minute), category, said)


def files(spark, path, *batches):
    """A stream that reads one batch at a time, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


ROWS = [
    [turn("a", 1, 0, "Entry Requirements", "I can self-fund up to £20,000"), turn("a", 3, 5, "Fees & Funding"), turn("b", 9, 1)],
    [turn("a", 2, 4, "Application Process", "a b c"), turn("a", 4, 6, "English Language", "my budget is 9k")],  # event 2 comes late
    [turn("b", 10, 70, "Visa & Immigration")],
    [turn("a", 5, 2, "Scholarships"), turn("b", 11, 71)],  # event 5 is older than the watermark, but nothing of its session is out
    [turn("a", 6, 3), turn("c", 7, 1), ("end", -1, -1, dt.datetime(2027, 6, 1), "", "")],
]


def test_late_turns_are_put_in_order(spark, tmp_path):
    found = streams.run_to_table(spark, streams.stream_score_per_turn(files(spark, tmp_path / "in", *ROWS)), str(tmp_path))
    got = {(r.session_id, r.event_id): r.asDict() for r in found.where("session_id <> 'end'").collect()}
    kept = [r for part in ROWS[:-1] for r in part if r[2] not in (6, 7)]  # they come after the watermark has passed
    twin = {(r.session_id, r.event_id): r.asDict() for r in sessions.score_per_turn(spark.createDataFrame(kept, SCHEMA)).collect()}
    assert got == twin and got["a", 2]["turn_no"] == 3 and got["a", 3]["has_intake"] == 1 and got["a", 3]["funding_tier"] == 3 and got["a", 4]["funding_tier"] == 1


def test_restart_in_the_middle(spark, tmp_path):
    """A run over the first files and one over the rest, from its checkpoint, give the rows of one run."""
    source = tmp_path / "in"
    for n, part in enumerate((ROWS[:2], ROWS[2:])):
        stream = streams.stream_score_per_turn(files(spark, source, *part))
        found = streams.run_to_table(spark, stream, str(tmp_path), name="again")
        if n == 0:
            assert found.count() == 0  # the watermark has passed no turn
    whole = streams.run_to_table(spark, streams.stream_score_per_turn(files(spark, tmp_path / "whole", *ROWS)), str(tmp_path))
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect())) and found.count() > 6


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """A session that goes on after its idle time begins anew."""
    day = 24 * 60
    rows = [[turn("a", 1, 0)], [turn("b", 2, 3 * day)], [turn("b", 3, 3 * day + 1)], [turn("a", 4, 3 * day + 5), turn("b", 5, 9 * day)], [turn("b", 6, 9 * day)]]
    found = streams.run_to_table(spark, streams.stream_score_per_turn(files(spark, tmp_path / "in", *rows)), str(tmp_path)).collect()
    assert {(r.session_id, r.event_id): r.turn_no for r in found} == {("a", 1): 1, ("b", 2): 1, ("b", 3): 2, ("a", 4): 1}


def test_sessions_that_are_closed(spark, tmp_path):
    rows = [r for part in ROWS[:3] for r in part]
    found = streams.run_to_table(spark, streams.stream_sessions(files(spark, tmp_path / "in", *ROWS[:3])), str(tmp_path)).collect()
    # minute 70 moves the watermark to minute 60: sessions that end by minutes 36 and 31 are closed, the last one is open
    assert sorted((r.user_id, r.n_turns, r.n_visa) for r in found) == [(1, 4, 0), (2, 1, 0)]
    twin = streams.stream_sessions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.user_id, r.n_turns, r.n_visa) for r in twin) == [(1, 4, 0), (2, 1, 0), (2, 1, 1)]


def test_scores_with_a_model(spark):
    half = lambda live: live.withColumn("ml_score", (live["engagement_message_count"] / 10).cast("double"))
    rows = sessions.score_per_turn(spark.createDataFrame(ROWS[0][:1] + ROWS[1], SCHEMA), half).orderBy("turn_no").collect()
    assert [(r.turn_no, round(r.ml_score, 6), r.hybrid_score) for r in rows] == [(1, 0.1, 0.188889), (2, 0.2, 0.377778), (3, 0.3, 0.538889)]
    assert [r.label for r in rows] == ["Cold", "Warm", "Warm"] and rows[2].mean_response_delay == 180.0 and rows[1].category_entropy == 1.0


def test_answers_go_on_after_a_restart(spark, tmp_path):
    """Files that come later are answered by a second run, and nothing is answered twice."""
    faq = spark.createDataFrame([(0, "visa permit rules", "q0", "a0", "Visa", "i", ["visa"]), (1, "tuition fees", "q1", "a1", "Fees", "j", ["fees"])], "idx long, document string, question string, answer string, category string, institution string, keywords array<string>")
    snapshot = answers.IndexSnapshot.build(faq, str(tmp_path / "index"))
    schema = "query_id long, query string"
    route = lambda q, hits, corpus: routing.audit_rows(q, hits, corpus, F.lit("Fees"), expected=F.lit("Visa"))
    for n, (query, want) in enumerate([("visa rules", 1), ("unknown words", 2), ("fees", 3)]):
        spark.createDataFrame([(n, query)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = answers.answer_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), snapshot, route, str(tmp_path / "out")).orderBy("query_id").collect()
        assert len(rows) == want
    assert [(r.faq_id, r.category, r.category_source, r.expected_rank, r.expected_by_classifier) for r in rows] == [(0, "Visa", "retrieval", 1, False), (None, "Fees", "classifier", None, False), (1, "Fees", "retrieval", None, False)]
    assert [r.decision for r in rows] == ["answer", "abstain: no hits", "answer"] and rows[1].reasons == ["no_retrieval_hits"]


def test_a_call_reads_and_writes_a_sessions_state_once():
    """However many turns wait: one read and one write of the state, and one row for all turns that come out."""
    calls, rows = [], [Row(us=n * 1_000_000, event_id=n, flags=1, tier=None, words=2, topic=0) for n in range(500)]

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            calls.append("clear")
            self.held = None

    handle = SimpleNamespace(getValueState=lambda *_: Value(), registerTimer=lambda _: calls.append("timer"), deleteTimer=lambda _: calls.append("no timer"))
    scores = streams.TurnScores(7, 86_400_000)
    scores.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms, getExpiryTimeInMs=lambda: 1)
    assert list(scores.handleInputRows(("a",), iter(rows), at(0)))[0].event_id == [0] and calls == ["get", "update", "timer"]
    calls.clear()
    timer = SimpleNamespace(getExpiryTimeInMs=lambda: 1001)
    (out,) = scores.handleExpiredTimer(("a",), at(10**12), timer)
    assert calls == ["get", "clear"] and out.event_id == list(range(1, 500)) and out.turn_no == list(range(2, 501)) and out.words[-1] == 1000 and out.delay[-1] == 1.0
