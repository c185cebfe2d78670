"""Alignment against a merge of the two lists of ends, texts by word against whole texts, and the query against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from enquira.llm import token_alignment as T

from . import edge

DIR = "/root/testdata/sf0.001"
BITS = [
    " ", "  ", "\n", " \n", "\t", "\r\n", "a", "the", "ing ", "word", "12", "3.5", "_", "--", "'s", "Ü", "é", "é", "中文", "😀", "İ", "\x00", "\x1c", "\x85", " ", "　",
    "​", "᠎", "﻿", "▁", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>",
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # Written apart from the operator: the usual printable letters of byte-level vocabularies.
    letters, extra = {}, 0
    for byte in range(256):
        if byte in range(33, 127) or byte in range(161, 173) or byte in range(174, 256):
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + extra)] = byte
            extra += 1

    def align(text):
        """(ids of A, ids of B, groups) or None."""
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        names = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids_b, names)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in common]
        for side, ids, ends in ((0, ids_a, ends_a), (1, ids_b, ends_b)):
            k = 0
            for i, e in zip(ids, ends):
                groups[k][side].append(i)
                k += e == common[k]
        return ids_a, ids_b, groups

    return align


def spell(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


@pytest.fixture(scope="module")
def model():
    return T.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def test_cuts():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 400):
        for share in (0.1, 0.5, 0.9):
            a = np.append(np.flatnonzero(rnd.random(n) < share), n + 1)
            b = np.append(np.flatnonzero(rnd.random(n) < share), n + 1)
            last_a, last_b = T.align(a, b)
            assert a[last_a].tolist() == b[last_b].tolist() == np.intersect1d(a, b).tolist()
    assert [x.tolist() for x in T.align(np.array([], int), np.array([], int))] == [[], []]


def test_words_against_whole_texts(model, plain):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 14))) for _ in range(4000)]
    for k in range(0, len(texts), 200):
        part = [" " + t for t in texts[k : k + 200]]
        for t, words in zip(texts[k : k + 200], model.numbered(part)):
            want = plain(t)
            whole = model.of_text(" " + t)
            assert (want is None) == (whole is None) == (words.min() < 0)
            if want:
                assert whole[:3] == model.of_words(words) == (len(want[0]), len(want[1]), spell(want[2]))


def test_forgetting(plain):
    small = T.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    small.MOST = 10
    for k in range(30):
        if small.full():
            small.shrink()
        text = f"again number{k} other{k * k} and\nagain line{k} the end"
        words = small.numbered([" " + text])[0]
        want = plain(text)
        assert small.of_words(words) == (len(want[0]), len(want[1]), spell(want[2]))
        links = np.concatenate([small.links[small.first[w] : small.first[w + 1]] for w in words])
        assert links.tolist() == [a[-1] * small.size_b + b[-1] for a, b in want[2]]
    assert len(small.known) < 40


def expected(texts, plain):
    done = [(d, plain(t)) for d, t in texts]
    counts = Counter((a[-1], b[-1]) for _, x in done if x for a, b in x[2])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for d, x in done:
        links = [(a[-1], b[-1]) for a, b in x[2]] if x else []
        digest = hashlib.sha256(spell(x[2]).encode()).hexdigest() if x else ""
        sizes = (len(x[0]), len(x[1]), len(x[2])) if x else (0, 0, 0)
        out.append((d, *sizes, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out


def test_query(spark, plain):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    rows = T.op13_token_alignment(spark, DIR).collect()
    assert sorted(map(tuple, rows)) == sorted(expected(texts, plain))


def test_edges(spark, plain):
    docs = edge.documents(spark)
    rows = T.align_documents(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    found = [(*tuple(r)[:7], hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in rows]
    assert sorted(found, key=str) == sorted(expected(texts, plain), key=str)
    assert {r.doc_id: r.n_a for r in rows}[3] == 0 and T.align_documents(edge.empty(spark)).count() == 0
    odd = spark.createDataFrame([(1, "a ▁ b"), (2, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_a, r.groups) for r in T.align_documents(odd).collect())[0] == (1, 0, "")
