"""Operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from enquira.llm import chat_windows, components, curriculum, hashing, isolation_quality, order_minhash, ordinal_toxicity, ppm, surrogates, token_blocks

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.randrange(40) for _ in range(rng.randrange(1, 50))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            if rng.random() < 0.4:
                b.insert(at, rng.randrange(40))
            elif len(b) > 1:
                b.pop(at % len(b))
        most = int(0.2 * max(len(a), len(b)) + 1e-9)
        assert order_minhash.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 0.8) == (edit_distance(a, b) <= most)


def test_order_minhash_recall(docs, texts):
    rows = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    grams = {}
    for i, t in texts.items():
        w = order_minhash.words_of(t)
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(grams)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            union = len(grams[a] | grams[b])
            if union and len(grams[a] & grams[b]) >= 0.8 * union:
                assert rows[a] == rows[b], (a, b)
    assert all(c <= i for i, c in rows.items())


def test_order_matters():
    h = hashing.window_hashes([b"w%d" % i for i in range(200)], 5)
    same = (order_minhash.order_sketch(h) == order_minhash.order_sketch(h)).mean()
    turned = (order_minhash.order_sketch(h) == order_minhash.order_sketch(np.r_[h[100:], h[:100]])).mean()
    assert same == 1 and turned < 0.8


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 100)] + [(300, 300 + k) for k in range(1, 30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102, 200)} == {100} and {got[300 + k] for k in range(30)} == {300}


def test_ppm_against_brute_force(docs, texts, spark):
    rows = {r.doc_id: r for r in ppm.score_documents(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    train = Counter()
    ends = sum(not h for h in held.values())
    for i, t in texts.items():
        if not held[i]:
            train.update(ppm.tokens(t))
    n, v = sum(train.values()) + ends, len(train) + 1
    for i, t in texts.items():
        r, words = rows[i], ppm.tokens(t)
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words) + 1, sum(train[w] > 0 for w in words) + 1, n)
        assert abs(r.base_score - base) < 1e-6


def test_ppm_beats_unigrams(spark):
    rows = ppm.score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out")
    assert rows.selectExpr("sum(score) > sum(base_score)").first()[0]


def test_ppm_against_trie(docs, texts):
    """Whole documents against a trie of dictionaries; most grams and words go the way of the join."""
    order, trie = ppm.ORDER, defaultdict(Counter)
    streams = {i: b"\r" * order + b" ".join(ppm.tokens(t)) + b"\n" for i, t in texts.items()}
    for i, s in streams.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for at in range(order, len(s)):
                for k in range(order + 1):
                    trie[s[at - k : at]][s[at]] += 1
    rows = {r.doc_id: r for r in ppm.score_documents(docs, most_grams=3000, most_words=50).collect()}
    for i, s in streams.items():
        cost = 0.0
        for at in range(order, len(s)):
            out: set = set()
            for k in range(order, -1, -1):
                c = trie.get(s[at - k : at])
                if not c:
                    continue
                n = sum(x for y, x in c.items() if y not in out)
                d = sum(1 for y in c if y not in out)
                if s[at] in c:
                    cost += math.log10((c[s[at]] - 0.5) / n)
                    break
                if d:
                    cost += math.log10(0.5 * d / n)
                out |= set(c)
            else:
                cost -= math.log10(ppm.SYMBOLS - len(out))
        assert abs(rows[i].score - cost) < 1e-6 and rows[i].n_bytes == len(s) - order


def test_ppm_without_training_rows(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = {r.doc_id: r for r in ppm.score_documents(spark.createDataFrame([(held[0], "ab c"), (held[1], None)], "doc_id long, text string")).collect()}
    for i, (n_tokens, n_bytes) in zip(held, ((3, 5), (1, 1))):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, n_tokens, 0, 0, 0.0)
        assert abs(r.score + n_bytes * math.log10(ppm.SYMBOLS)) < 1e-9


def test_ppm_long_text_in_slices(monkeypatch):
    streams = [b"ab", b"some longer text of many bytes\n", b"c\n"]
    whole = {0: ppm.gram_codes(streams)[0]}
    monkeypatch.setattr(ppm, "SLICE", 7)
    parts = list(ppm.slices(streams))
    assert len(parts) > 4 and (np.concatenate([p[1] for p in parts]) == whole[0]).all()
    assert np.concatenate([p[0] + p[2] for p in parts]).tolist() == [0] * 2 + [1] * len(streams[1]) + [2] * 2


def test_chat_round_trip(spark):
    talk = spark.read.parquet(f"{DIR}/conversations.parquet")
    windows = chat_windows.format_windows(talk, budget=200, history_turns=2, history_budget=60)
    got = {r.conv_id: r for r in chat_windows.digest(windows).collect()}
    said = defaultdict(list)
    for r in talk.orderBy("conv_id", "turn").collect():
        said[r.conv_id].append((r.role, r.text))
    for c, turns in said.items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256("".join(b for a, b in turns if a == "assistant").encode()).hexdigest()
    for w in windows.collect():
        assert w.tokens <= 200 or w.n_new == 1
        if "system" in {a for a, _ in said[w.conv_id]}:
            assert w.formatted.startswith('<turn role="system"')


def test_block_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 128, 129, 3000):
        for high in (1, 300, 60_000, 2**32 - 1):
            ids = rng.integers(0, high, n, endpoint=True).astype(np.uint32)
            ids[::19] = rng.integers(0, 2**32 - 1, len(ids[::19]))
            ends = np.sort(rng.integers(0, n, 4, endpoint=True))
            payload = token_blocks.encode_shard(ids, ends)
            got, got_ends = token_blocks.decode_shard(payload)
            assert (got == ids).all() and (got_ends == ends).all()
            for k in range(0, -(-n // 128), 5):
                assert (token_blocks.decode_block(payload, k) == ids[128 * k : 128 * (k + 1)]).all()


def test_tokens_equal_the_library(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = token_blocks.CachedTokenizer(path)
    library = Tokenizer.from_file(path)
    odd = ["a <|endoftext|> b", "x<|endoftext|>", "a  b", "a   b", " a", "a ", "  ", "a \n b", "x\n\n  y", "it's  fine", "\x1cb c\x85 d e"]
    start = 0
    rows = {r.doc_id: r for r in token_blocks.encode_documents(docs).collect()}
    for text in odd:
        assert np.frombuffer(model.encode(text), model.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    for i in sorted(texts):
        ids = library.encode(texts[i], add_special_tokens=False).ids + [2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_mix_targets(docs, texts):
    rows = curriculum.assign(docs).collect()
    total = sum(r.size for r in rows)
    sources = {}
    for r in rows:
        s = sources.setdefault(r.source, [r.target, r.source_size, 0])
        s[2] += r.taken
        assert r.taken <= 2 * r.size
    weights = dict(zip(sorted(sources), [3, 1, 2] * len(sources)))
    target, open_, left = {}, set(sources), 1.5 * total
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sources[s][1]}
        for s in full or open_:
            target[s] = 2.0 * sources[s][1] if full else level * weights[s]
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    for s, (t, _, taken) in sources.items():
        assert abs(t - target[s]) < 1e-6 * t + 1e-9 and abs(taken - t) <= 1
    positions = [r._position for r in curriculum.mix(docs).collect()]
    assert positions == sorted(positions)


def test_toxicity_held_out(spark):
    """At least nine tenths of toxic rows that are not in the fit, and next to no clean ones."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = ordinal_toxicity.score_documents(docs, labels.where("doc_id % 4 <> 0"))
    fitted = docs.join(labels.where("doc_id % 4 <> 0").select("doc_id"), "doc_id").select("text")
    new = scored.join(fitted, "text", "left_anti")  # no copies of fitted texts
    rows = new.join(labels.where("doc_id % 4 = 0"), "doc_id").select("toxic", "is_toxic", "severity", "grade").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert len(toxic) > 90 and sum(r.is_toxic for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.toxic == 0 and r.is_toxic for r in rows) <= 0.005 * len(rows)
    assert all((r.grade > 0) == r.is_toxic and 0 <= r.severity <= 2 for r in rows) and {r.grade for r in rows} == {0, 1, 2}


def test_ordinal_fit():
    """Graded rows: thresholds are ordered, all weights point upwards, grades are found again."""
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 400)
    bags = [np.array(sorted({*range(10, 10 + 3 * g), int(rng.integers(1000, 9000))}), np.int32) for g in grade]
    model = ordinal_toxicity.fit_grades(bags, grade)
    assert len(model.thetas) == 3 and (np.diff(model.thetas) > 0).all() and (model.weights[10:19] > 0).all()
    p = model.at_least(np.array([model.weights[b].sum() for b in bags]))
    assert ((p > 0.5).sum(1) == grade).mean() > 0.95


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(2, 1, None), (None, 0, 1)], labels.schema)
    for table in (labels, nulls):
        assert ordinal_toxicity.score_documents(docs, table).where("is_toxic or grade > 0").count() == 0


def test_quality_statistics(docs, texts):
    for t in texts.values():
        words = t.encode().split()
        tri = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) if tri[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        got = isolation_quality.text_stats(t)
        assert got[0] == len(words) and got[1] == sum(len(w.decode()) for w in words) and got[4] == len(covered) and got[3] == len(lines) - len(set(lines))


def test_surrogates():
    text = "Call +1 (988) 555-2485, Foo.Bar@Mail.example.com, foo.bar@mail.example.com, 10.0.0.1, 4111 1111 1111 1111; Mrs. Anna Keller and Mr Keller, password=abc123def"
    new, n = surrogates.rewrite(text, "k", {})
    assert n == 9 and "555-2485" not in new and "10.0.0.1" not in new and "Keller" not in new
    assert surrogates.luhn("".join(c for c in new.split(";")[0].split(",")[-1] if c.isdigit()))
    a, b = (w for w in new.replace(",", " ").split() if "@" in w)
    assert a.lower() == b.lower()
    assert surrogates.rewrite(text, "k", {})[0] == new and surrogates.rewrite(text, "other", {})[0] != new


def test_surrogates_are_distinct(spark):
    names = [f"Mr Robert{chr(97 + i)}x Smith{chr(97 + i)}y said so." for i in range(26)] + [f"mail m{i}@x.org" for i in range(50)] + ["Frau Anna Meier", "Frau Bertha Meier", "Frau Clara Meier", "Frau Emma Meier", "Frau Julia Meier", "Frau Laura Meier"]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")
    rows = surrogates.replace_entities(docs, "k").orderBy("doc_id").collect()
    new = [r.text for r in rows]
    assert len(set(new)) == len(set(names)) and not set(new) & set(names)
    assert len({t.split()[-1] for t in new[-6:]}) == 1


def test_ppm_parts_of_a_batch():
    from enquira.llm.ppm import portions

    pdf = pd.DataFrame({"text": ["a" * 6, None, "", "b" * 6, "c" * 30, "d"]})
    parts = list(portions([pdf, pdf.iloc[:0]], 10))
    assert [x for p in parts for x in p["text"]] == pdf["text"].tolist() and [len(p) for p in parts] == [3, 1, 2]
