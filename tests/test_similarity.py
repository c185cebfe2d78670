"""Character ratios of many pairs against difflib, and similarity without a join of pairs."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest

import __spark_entry__
from enquira.functions.ratios import ratios
from enquira.operators import catalog


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "aéß中😀\ud800b "])
def test_ratios_are_those_of_difflib(letters, monkeypatch):
    rnd = random.Random(3)
    made = lambda n: "".join(rnd.choices(letters, k=n))
    texts = [made(rnd.randint(0, 80)) for _ in range(60)] + ["", made(1500)]
    questions = [made(rnd.randint(0, 199)) for _ in range(6)] + ["", made(199), made(200), made(320)]
    t, q = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(questions))))
    want = [SequenceMatcher(None, texts[i], questions[j]).ratio() for i, j in zip(t, q)]
    assert ratios(texts, questions, t, q).tolist() == want
    monkeypatch.setattr("enquira.functions.ratios.CHARACTERS", 50)
    assert ratios(texts, questions, t[:200], q[:200]).tolist() == want[:200]
    assert ratios([], [], [], []).tolist() == []


def corpus(spark):
    faq = spark.createDataFrame([(3, "visa fees!", "visa", "visa", "permit"), (1, "", "", "", ""), (2, "zimmer", None, "zimmer", "")], "idx int, question string, answer string, kw1 string, kw2 string")
    records = spark.createDataFrame([(1, "Visa fees"), (2, "Visa fees"), (3, "!!!"), (4, None), (5, ""), (6, "Zimmer frei")], "seq long, record_text string")
    return records, faq


def test_similarity_joins_no_pairs(spark):
    """Pairs are many where files are small: a join of them is turned into a broadcast that the driver collects."""
    records, faq = corpus(spark)
    found = catalog.faq_similarity(records, faq)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join \[[^\]]*idx", plan) and "BroadcastHashJoin" not in plan
    got = {(r.seq, r.idx): r.score for r in found.collect()}
    assert len(got) == 18 and got[1, 3] == got[2, 3] == 0.45 / 2 + 0.25 + 0.15 + 0.15 * (18 / 19)
    assert all(got[seq, i] == 0.0 for seq in (3, 4, 5) for i in (1, 2, 3))  # a text without a token
    assert got[6, 2] == 0.45 + 0.25 + 0.15 * (12 / 17) and got[6, 1] == 0.0


def test_related_questions_are_found_in_one_pass(spark, monkeypatch):
    """No join, and more questions than are sent at a time are scored block by block."""
    records, faq = corpus(spark)
    found = catalog.related_faqs(records, faq)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    whole = {r.seq: r.related for r in found.collect()}
    assert [(x["rank"], x.idx, x.score) for x in whole[1]] == [(1, 3, round(0.45 / 2 + 0.4 + 0.15 * 18 / 19, 4))] and whole[3] == whole[4] == whole[5] == []
    monkeypatch.setattr(catalog, "QUESTIONS", 1)
    for k, threshold in ((3, 0.10), (2, 0.0), (5, 0.0)):
        got = {r.seq: [(x["rank"], x.idx, x.score) for x in r.related] for r in catalog.related_faqs(records, faq, k, threshold).collect()}
        exact = catalog.faq_similarity(records, faq).where(f"score >= {threshold}").collect()
        ranked = {n: sorted((-r.score, r.idx) for r in exact if r.seq == n)[:k] for n in range(1, 7)}
        assert got == {n: [(p + 1, i, round(-s, 4)) for p, (s, i) in enumerate(x)] for n, x in ranked.items()}
    assert catalog.related_faqs(records, faq.where("idx > 9")).where("size(related) = 0").count() == 6


def test_related_questions_of_whole_documents(spark, tmp_path):
    """A question in a later line, behind more characters than the operator compares by default, is found by the query."""
    for t in ("part", "benchmark"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    item, text = spark.read.parquet(f"{tmp_path}/benchmark.parquet").select("item_id", "text").orderBy("item_id").first()
    said = "qq 11\n" + "#" * 2100 + "\n" + text
    spark.createDataFrame([(7, said), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.seq: (r.related, r.scores) for r in __spark_entry__.queries()["related_faqs"](spark, str(tmp_path)).where("seq LIKE 'note%'").collect()}
    tokens, words = (lambda x: set(re.findall("[a-z0-9]+", x.lower()))), text.split(" ")
    sides = [(w, tokens(x)) for w, x in ((0.45, f"{words[1]} {words[4]}"), (0.25, text[:60]), (0.15, text))]
    score = sum(w * (len(x & tokens(said)) / max(1, len(x))) for w, x in sides) + 0.15 * SequenceMatcher(None, said.lower(), text[:60].lower()).ratio()
    assert score > 0.8 and got["note-7"][0].split(",")[0] == str(item) and got["note-7"][1].split(",")[0] == str(round(score, 4)) and got["note-8"] == ("", "")
    records = spark.createDataFrame([(1, "a " + "#" * 3000 + "zzzzy")], "seq long, record_text string")
    faq = spark.createDataFrame([(1, "zzzz", "", "", "")], "idx long, question string, answer string, kw1 string, kw2 string")
    scores = [[x.score for x in catalog.related_faqs(records, faq, threshold=0.0, compared=n).first().related] for n in (2000, None)]
    assert scores == [[0.0], [round(0.15 * 8 / 3011, 4)]]
