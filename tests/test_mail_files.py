"""Mail files are written by many tasks, without a folder each."""

from __future__ import annotations

import os

from enquira.sources import mails


def test_mail_files_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mails, "FILES", 5)
    rows = spark.range(40).coalesce(1).selectExpr("id AS s_suppkey", "concat('Subject: Plain ', id, '\\n\\nbody ', id) AS value")
    mails.write_mail_files(rows, "s_suppkey", f"{tmp_path}/mails")
    files = [f for f in os.listdir(f"{tmp_path}/mails") if f.startswith("part-")]
    assert not any(os.path.isdir(f"{tmp_path}/mails/{f}") for f in files) and len({f[:10] for f in files}) > 1
    found = mails.read_mail_files(spark, f"{tmp_path}/mails", glob="part-*")
    said = sorted(bytes(r.content).decode() for r in found.collect() if len(r.content))
    assert said == sorted(f"Subject: Plain {i}\n\nbody {i}\n" for i in range(40))
