"""Rules against hand-computed rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from enquira.functions import funding, lead_rules, pii, text
from enquira.operators import evaluation, forms, routing, scoring, sessions


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_cleaning(spark):
    assert column(spark, ["  a \n b ", "   ", None], text.clean_text) == ["a b", None, None]
    assert column(spark, ["£150 / week", "$1,200 /month", "Price on request", ","], text.parse_price) == [150.0, 1200.0, None, None]
    assert column(spark, ["BSc", "Bachelor of Arts with honours", "PG", "Master of Science in Physics", "", "Odd  one"], text.normalize_level) == ["bachelor", "bachelor", "postgraduate", "master", None, "Odd one"]
    assert column(spark, ["£ 9,250", "€  5"], text.clean_fees) == ["£9,250", "€5"]


def test_amounts(spark):
    said = ["I have £15,000", "15,000 pounds", "£20k or 18k", "twenty thousand", "one-year masters, three instalments", "fifteen hundred", "", None, "£15,000-£20,000"]
    assert column(spark, said, funding.funding_amount) == [15000.0, 15000.0, 18000.0, 20000.0, None, 1500.0, None, None, 15000.0]
    assert column(spark, ["self-fund up to £20,000", "my budget is 9k", "£15,000", "my savings"], funding.funding_tier) == [3, 1, None, None]


def test_lead_rules(spark):
    assert column(spark, ["Cold", "good ", "HOT", "NA", None], lead_rules.lead_label) == [0, 1, 2, -1, -1]
    assert column(spark, ["", "no source of funds", "looking for scholarship", "Self funded", "has finance", "expo first"], lead_rules.funding_clarity) == [0, 1, 2, 3, 3, 2]
    assert column(spark, ["BSc", "PhD candidate", "[UNIVERSITY]", "postgraduate", "certificate", "foundation year"], lead_rules.qual_level) == [3, 5, 0, 0, 0, 1]


def test_scores(spark):
    assert column(spark, [0.2, 0.34, 0.9], scoring.score_label, "double") == ["Cold", "Warm", "Hot"]
    blend = lambda alpha: column(spark, [0.8], lambda c: scoring.hybrid_score(c, F.lit(0.5), alpha), "double")[0]
    assert blend(1.0) == 0.8 and blend(0.0) == 0.5 and abs(blend(0.5) - 0.65) < 1e-12
    assert column(spark, [0.8], lambda c: scoring.hybrid_score(c, F.lit(None).cast("double"), 0.5), "double") == [0.8]
    with pytest.raises(Exception, match="alpha"):
        column(spark, [0.8], lambda c: scoring.hybrid_score(c, F.lit(0.5), 1.5), "double")


def test_intents(spark):
    groups = column(spark, ["I have a passport, IELTS 6.5 and want a masters in September", "upgrade of course", "b+ and c+"], routing.intent_groups)
    assert [[g["group"] for g in x] for x in groups] == [[0, 1, 3, 4], [], [2]]
    assert column(spark, ["passport ielts nursing", "passport ielts"], routing.multi_intent) == [True, False]


def test_redaction(spark):
    got = column(spark, ["mail a.b@example.com or +254 702 102 295", "passport 2024-2034 server 10.0.0.1", "budget £17,000", "clean text", None], pii.redact)
    assert got == ["mail [EMAIL_REDACTED] or [PHONE_REDACTED]", "passport [PASSPORT_REDACTED] server [IP_REDACTED]", "budget [AMOUNT_REDACTED]", "clean text", ""]
    assert column(spark, ["call 0716524788", "nothing here"], pii.has_pii) == [True, False]


def test_plain_mail(spark):
    body = "ignored\nJotform Logo\nCRM ID?\n123456\nComments:\nfirst line\n\nsecond line\nStudent name?\nJo Do"
    pairs = forms.plain_pairs(spark.createDataFrame([(1, body)], "k int, body string"), "k", "body").orderBy("pos").collect()
    assert [(p.question, p.answer) for p in pairs] == [("CRM ID?", "123456"), ("Comments:", "first line second line"), ("Student name?", "Jo Do")]
    record = forms.assemble_records(spark.createDataFrame(pairs), "k").first()
    assert record.crm_id == "123456" and record.assessment_notes == "first line second line" and record.extra_fields == {"Student name?": "[NAME_REDACTED]"}


def test_ranking_metrics(spark):
    gold = spark.createDataFrame([(0, 5, "a", False), (1, 6, "a", False), (2, None, "b", True)], "query_id int, gold_id int, category string, expected_abstain boolean")
    hits = spark.createDataFrame([(0, 5, 1, 0.9), (0, 6, 2, 0.4), (1, 7, 1, 0.5), (1, 6, 2, 0.4)], "query_id int, idx int, rank int, score double").withColumn("cosine", F.col("score"))
    one = evaluation.summary(evaluation.per_query(hits, gold, 0.15)).first()
    assert (one.rank1, one.mrr, one.recall3, one.abstention_precision, one.abstention_recall, one.false_abstention_rate) == (0.5, 0.75, 1.0, 1.0, 1.0, 0.0)


def test_turns_without_reply(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "user", "d")], "conv_id int, turn int, role string, text string")
    assert [(r.user_msg, r.reply) for r in sessions.turn_pairs(rows).orderBy("turn").collect()] == [("a", "b"), ("c", ""), ("d", "")]
