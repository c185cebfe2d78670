"""Pages, mails, corpora and feature files against hand-computed rows."""

from __future__ import annotations

import json
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

import pytest

from enquira.operators import forms
from enquira.sources import html_items, mails, stores

ITEM = '<div class="item wide"><h2 class="name"> BSc <b>Physics</b>\n</h2><a class="go" href="/study/bsc">View</a><ul><li>one<li>two</ul><img src=" p.png "><p data-x="1">nine</p></div>'
PAGE = f'<html><body><script>var t="<div class=item></div>";</script><div id="list">{ITEM}<div class="item"><h2 class="name"></h2><a class="go" href=""></a></div><div class="item"><a class="go" href="https://x.org/a">only a link</a></div></div><br></p></body></html>'


def test_page_items(spark):
    pages = spark.createDataFrame([(1, "https://www.uni.example/study/courses", PAGE), (2, "https://x.org", None), (3, None, "<div class=item><h2 class=name>No url</h2></div>")], "page_id long, url string, html string")
    fields = {"title": "h2.name::text", "url": "a.go::attr(href)", "points": "ul li::all", "picture": "img", "mark": "[data-x=1], .none", "link": ".none::text, #list > .item > a, a.go", "raw": "b::html"}
    rows = {(r.page_id, r.pos): r for r in html_items.page_items(pages, ".item", fields).collect()}
    assert set(rows) == {(1, 0), (1, 1), (1, 2), (3, 0)}
    first = rows[1, 0]
    assert (first.title, first.url, first.picture, first.mark, first.raw, first.error) == ("BSc Physics", "https://www.uni.example/study/bsc", "p.png", "nine", "<b>Physics</b>", None)
    assert first.points[0].startswith("one") and first.link == "/study/bsc"
    assert rows[1, 1].error == "blank item" and rows[1, 2].url == "https://x.org/a" and rows[1, 2].title is None and rows[3, 0].title == "No url"
    errors = html_items.item_errors(html_items.page_items(pages, ".item", fields)).collect()
    assert [(r.page_id, r.error, r.n) for r in errors] == [(1, "blank item", 1)]
    assert "selector not supported" in html_items.page_items(pages, "div:has(a)", fields).first().error


def mail(subject, html=None, plain=None):
    m = MIMEMultipart("alternative")
    m["Subject"], m["From"], m["Date"] = subject, "forms@example.com", "Thu, 03 Apr 2025 03:34:07 -0400"
    for text, kind in ((html, "html"), (plain, "plain")):
        if text:
            m.attach(MIMEText(text, kind))
    return m.as_bytes()


def test_mails(spark, tmp_path):
    table = '<table id="x_emailFieldsTable"><tr><td id="question1">English proficiency</td><td id="value1">IELTS <i>6.5</i></td></tr><tr><td id="question2">Fund amount</td></tr><tr><td id="question3">Destination</td><td id="value3">UK &amp; Ireland</td></tr></table><table><tr><td id="question9">other</td><td id="value9">no</td></tr></table>'
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "Form +254 702 102 295.eml").write_bytes(mail("Office - Form - Jo - Good - 999001 -", table, "CRM ID?\n1"))
    (tmp_path / "b.eml").write_bytes(mail("Plain", "<html><body>no table</body></html>", "Jotform Logo\nEnglish proficiency\nIELTS 6.5\nStudy destination\nUK"))
    (tmp_path / "c.txt").write_bytes(b"no mail")
    files = mails.read_mail_files(spark, str(tmp_path))
    assert {r.source_file for r in files.collect()} == {"Form [PHONE_REDACTED].eml", "b.eml"}
    parsed = mails.parsed_mails(files.select("source_file", "content").union(spark.createDataFrame([("bad", None)], "source_file string, content binary")))
    assert tuple(mails.mail_summary(parsed).first()) == (2, 1)
    rows = mails.mail_to_pairs(parsed).collect()
    got = {(r.source_file[:4], r.source, r.question): r.answer for r in rows}
    assert got == {
        ("Form", "html", "English proficiency"): "IELTS  6.5", ("Form", "html", "Destination"): "UK & Ireland",
        ("b.em", "plain", "English proficiency"): "IELTS 6.5", ("b.em", "plain", "Study destination"): "UK",
    }
    assert {r["from"] for r in rows} == {"forms@example.com"}
    record = {r.source_file[:4]: r for r in forms.assemble_records(mails.mail_to_pairs(parsed), "source_file").collect()}
    assert record["Form"].english_test == "IELTS  6.5" and record["b.em"].study_destination == "UK"


def test_corpus_positions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question": "q0", "answer": "a0"}, {"question": "", "answer": "x"}, {"question": "q2", "answer": "a2", "index": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"faqs": [{"question": "q3", "answer": "a3", "category": "Visa", "keywords": ["k"]}]}))
    rows = stores.read_faq(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.idx, r.question, r.category) for r in rows] == [(0, "q0", "General Enquiries"), (2, "q2", "General Enquiries"), (3, "q3", "Visa")]
    (tmp_path / "c.json").write_text(json.dumps([{"question": "q4", "answer": "a4", "index": 0}]))
    with pytest.raises(Exception, match="states index"):
        stores.read_faq(spark, str(tmp_path)).collect()


def test_latest_features(spark, tmp_path):
    (tmp_path / "lead_features_1.csv").write_text("﻿crm_id,label\n5,1\n")
    (tmp_path / "lead_features_2.json").write_text(json.dumps({"data": [{"crm_id": 6, "label": 2}]}))
    (tmp_path / "sessions_3.json").write_text(json.dumps({"data": [{"label": 2, "n": 4}, {"label": 0, "n": 5}]}))
    one = stores.latest_features(spark, str(tmp_path), "lead_features", "real").first()
    assert (one.crm_id, one.label, one.source, one.provenance) == (5, 1, "real", "lead_features_1.csv")
    assert {(r.label, r.n) for r in stores.latest_features(spark, str(tmp_path), "sessions", "synthetic").collect()} == {(2, 4), (0, 5)}
    rebuilt = stores.latest_features(spark, str(tmp_path), "none", "real", spark.createDataFrame([(1,)], "label int"))
    assert rebuilt.first().provenance == "rebuilt"
