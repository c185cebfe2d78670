"""The pipeline on small tables, stage by stage against brute force, and on odd and empty tables."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import pytest

from enquira.llm import isolation_quality, latent_decontamination, order_minhash
from enquira.llm.common import plain_words

from . import edge

DIR = "/root/testdata/sf0.001"
SCHEMAS = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}


def folder(spark, path, documents, labels=None, benchmark=None):
    documents.write.parquet(f"{path}/documents.parquet")
    (labels if labels is not None else spark.createDataFrame([], SCHEMAS["labels"])).write.parquet(f"{path}/labels.parquet")
    (benchmark if benchmark is not None else spark.createDataFrame([], SCHEMAS["benchmark"])).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def library_rows(rows):
    """(doc_id, start, n_tokens, ids_crc32) by the library itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = [plain_words(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    spans = {tuple(w[i : i + 8]) for w in bench for i in range(len(w) - 7)}
    seen = {"start": docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, DIR)
        assert found.columns == docs.columns
        seen[name] = found.collect()
        docs = spark.createDataFrame(seen[name], docs.schema)
    toxic = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").where("toxic > 0").collect()}
    gone = {r.doc_id for r in seen["start"]} - {r.doc_id for r in seen["toxicity"]}
    assert gone and len(gone & toxic) >= 0.8 * len(gone)
    kept = {r.doc_id for r in seen["near_dedup"]}
    words = {r.doc_id: order_minhash.words_of(r.text) for r in seen["toxicity"]}
    hashes = {i: order_minhash.window_hashes(w, 1) for i, w in words.items()}
    for i in set(words) - kept:  # each removed text has a similar one, each kept pair differs
        assert any(order_minhash.aligned(hashes[i], hashes[j], 0.8) for j in words if j != i)
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items() if i in kept}
    for i in kept:
        assert not any(j < i and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) > 0 for j in kept)
    for r in seen["decontamination"]:
        w = plain_words(r.text)
        assert not any(tuple(w[k : k + 8]) in spans for k in range(len(w) - 7))
    left = {r.doc_id for r in seen["near_dedup"]} - {r.doc_id for r in seen["decontamination"]}
    texts = {r.doc_id: plain_words(r.text) for r in seen["near_dedup"]}
    assert all(any(tuple(texts[i][k : k + 8]) in spans for k in range(len(texts[i]) - 7)) for i in left)
    assert {r.doc_id for r in seen["mixing"]} <= {r.doc_id for r in seen["decontamination"]}
    last = sorted(seen["mixing"], key=lambda r: r.doc_id)
    found = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == library_rows(last)
    whole = sorted(corpus_pipeline.run(spark, DIR).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in whole] == [tuple(r) for r in found]


def test_odd_and_empty_tables(spark, tmp_path):
    bench = spark.createDataFrame([(0, edge.PASSAGE), (1, None), (2, "")], SCHEMAS["benchmark"])
    d = folder(spark, tmp_path / "edge", edge.documents(spark), edge.labels(spark), bench)
    rows = [r.doc_id for r in corpus_pipeline.run(spark, d).collect()]
    assert 9 not in rows and 10 not in rows and 1 in rows and 2 not in rows and 8 in rows
    none = folder(spark, tmp_path / "none", edge.empty(spark))
    assert corpus_pipeline.run(spark, none).count() == 0
    bare = folder(spark, tmp_path / "bare", edge.documents(spark, extra=False))  # no labels, no items
    assert {r.doc_id for r in corpus_pipeline.run(spark, bare).collect()} >= {1, 6, 8, 9}


def test_columns_that_clash(spark):
    docs = edge.documents(spark)
    for c in ("_doc", "_xx", "_bad", "_copy", "_take", "leaked_doc", "k_doc", "d", "h", "repeats"):
        docs = docs.withColumn(c, docs["source"])
    for stage in (lambda x: latent_decontamination.decontaminate(x, spark.createDataFrame([(0, edge.PASSAGE)], SCHEMAS["benchmark"])), order_minhash.deduplicate):
        out = stage(docs)
        assert out.columns == docs.columns and {r._doc for r in out.collect()} <= {"a", "b", "c", "d", "", None}


def test_paraphrases_and_hard_items(spark):
    """Three in ten words changed, items of common words, short items, an item in a third of the rows and an item of 600 words."""
    import random

    rng = random.Random(7)
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()][:60]
    words = sorted({w for t in texts for w in t.split() if w.isalpha()})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").collect()[:20]]
    long_ = " ".join(rng.choice(words) for _ in range(600))
    items += [(100, long_), (101, "one two three four five six"), (102, " ".join(["the of and to in"] * 3))]
    rows, planted = [(i, t) for i, t in enumerate(texts)], set()
    for item, text in items[:20]:
        for share in (0.1, 0.2, 0.3):
            new = [rng.choice(words) if rng.random() < share else w for w in text.split(" ")]
            host = texts[rng.randrange(60)]
            rows.append((len(rows), f"{host[: len(host) // 2]} {' '.join(new)} {host[len(host) // 2 :]}"))
            planted.add((rows[-1][0], item))
    exact = set()
    for i in range(60):
        which = (101, 100, 102)[i % 3]
        rows.append((len(rows), f"{texts[i][:200]} {dict(items)[which]} {texts[i][:100]}"))
        exact.add((rows[-1][0], which))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, SCHEMAS["benchmark"])
    found = {(r.doc_id, r.item_id) for r in latent_decontamination.find_leaks(docs, bench).collect()}
    assert exact <= found and len(planted & found) >= 0.9 * len(planted)


def test_forest_against_recursion():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(300, 3))
    forest = isolation_quality.grow_forest(rows, 20, 64, 1)
    scores = isolation_quality.path_scores(forest, rows, 64)

    def path(tree, x, at=0):
        feature, split, left, right, length = tree
        return length[at] if feature[at] < 0 else path(tree, x, left[at] if x[feature[at]] < split[at] else right[at])

    for x, s in zip(rows, scores):
        assert abs(2 ** (-np.mean([path(t, x) for t in forest]) / isolation_quality.expected_path(64)) - s) < 1e-12
    assert isolation_quality.path_scores(forest, np.array([[9.0, 9.0, 9.0]]), 64)[0] > np.quantile(scores, 0.99)


@pytest.mark.parametrize("labels", [None, []])
def test_quality_without_labels(spark, labels):
    table = None if labels is None else spark.createDataFrame([], SCHEMAS["labels"])
    rows = isolation_quality.filter_quality(spark.read.parquet(f"{DIR}/documents.parquet"), table).collect()
    good = [r for r in rows if not r.base_failed]
    assert len(rows) == 200 and sum(not r.kept for r in good) <= 0.05 * len(good) and not any(r.kept for r in rows if r.base_failed)


def test_quality_verdict_on_new_rows(spark):
    """Calibrated on three quarters of the labels, judged on the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = isolation_quality.filter_quality(docs, labels.where("doc_id % 4 <> 0")).join(labels.where("doc_id % 4 = 0"), "doc_id")
    rows = found.groupBy("quality", "base_failed", "kept").count().collect()
    count = {(r.quality, r.base_failed, r.kept): r["count"] for r in rows}
    print("quality", count)
    good, bad = (count.get((q, False, True), 0) / sum(n for (x, failed, _), n in count.items() if x == q and not failed) for q in (1, 0))
    assert good >= 0.98  # of the labelled good rows that pass the base rules
    assert bad < 0.75 and sum(n for (q, _, kept), n in count.items() if q == 0 and kept) <= 0.4 * sum(n for (q, *_), n in count.items() if q == 0)
