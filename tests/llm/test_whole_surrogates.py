"""Entities whose own surrogates are used up, and texts without digits."""

from __future__ import annotations

import string

from enquira.llm import surrogates


def test_entities_without_room(spark):
    texts = ["password: ********", "password: ##########"] + [f"Dr {c} said so." for c in string.ascii_uppercase]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = [r.text for r in surrogates.replace_entities(docs, "k").orderBy("doc_id").collect()]
    assert len(set(new)) == len(texts) and not set(new) & set(texts)


def test_every_pattern_passes_the_hint():
    for text in ("api_key=abcdefghij", "API-KEY: abcdefghij", "AKIAABCDEFGHIJKLMN", "use ghp_abcdefghijklmn", "sk-abcdefghijklmnop", "pwd=abcdefgh", "my name is Anna"):
        new, n = surrogates.rewrite(text, "k", {})
        assert n == 1 and new != text, text


def test_later_attempts_have_more_room():
    for kind, value in (("ip", "1.1.1.1"), ("name", "a"), ("secret", "*****1"), ("email", "a@b.de"), ("key", "sk-abcdefghijkl"), ("iban", "DE00123412341234")):
        assert len({surrogates.surrogate(kind, value, surrogates.plain_hint(kind, value), "k", n) for n in range(60)}) > 30, kind
    long_ = surrogates.surrogate("email", "a@b.de", "", "k", 8)
    assert len(surrogates.render("A@b.de", "email", long_)) == len(long_)


def rewritten(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in surrogates.replace_entities(docs, "k").orderBy("doc_id").collect()]


def test_one_person_keeps_one_name(spark):
    a, b, c, d = rewritten(
        spark, "Mr Robert Smith met Dr Robert Smith.", "Mr Robert. Mr Robert Smith.", "Dr Keller spoke. Keller left, KELLER too.", "Our manager Robert Smith wrote; Smith signed."
    )
    first, last = a.split()[1:3]
    assert a == f"Mr {first} {last} met Dr {first} {last}." and b == f"Mr {first}. Mr {first} {last}."
    assert d == f"Our manager {first} {last} wrote; {last} signed."
    k = c.split()[1]
    assert k != "Keller" and c == f"Dr {k} spoke. {k} left, {k.upper()} too."


def test_gender_of_all_mentions(spark):
    texts = ["Frau Bertha Meier kam.", "Dr Bertha Meier ging.", "Anna Schulz rief an.", "Herr Kuno Meier blieb.", "Госпожа Зоя Петрова"]
    new = rewritten(spark, *texts)
    latin, cyrillic = surrogates.ENDINGS["LATIN"], surrogates.ENDINGS["CYRILLIC"]
    assert new[0].split()[1] == new[1].split()[1] and new[0].split()[1].endswith(tuple(latin["f"])) and new[2].split()[0].endswith(tuple(latin["f"]))
    assert new[3].split()[1].endswith(tuple(latin["m"])) and new[4].split()[1].lower().endswith(tuple(cyrillic["f"]))
    assert new[0].split()[2] == new[3].split()[2] == new[1].split()[2]


def test_checks_hold(spark):
    iban, card = "GB82WEST12345698765432", "4111 1111 1111 1111"
    new = rewritten(spark, f"pay {iban}", "pay GB82 WEST 1234 5698 7654 32", f"card {card}", "pay GB00WEST12345698765432")
    one = new[0].split()[1]
    assert one != iban and one[:2] == "GB" and surrogates.iban_remainder(one) == 1 and new[1].split(" ", 1)[1].replace(" ", "") == one
    assert surrogates.luhn(new[2].split(" ", 1)[1].replace(" ", "")) and new[3].split()[1] != "GB00WEST12345698765432"


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org", "x", 7, "f"), (None, None, "y", 8, "g"), (1, "mail a@b.org", "z", 9, "h"), (2, "", "w", 1, "i")], "doc_id long, text string, d string, row long, found string")
    rows = surrogates.replace_entities(docs, "k").collect()
    assert surrogates.replace_entities(docs, "k").columns == [*docs.columns, "n_entities"]
    assert sorted((r.d, r.row, r.found, r.n_entities) for r in rows) == [("w", 1, "i", 0), ("x", 7, "f", 1), ("y", 8, "g", 0), ("z", 9, "h", 1)]
    assert len({r.text for r in rows if r.doc_id == 1}) == 1 and [r.text for r in rows if r.doc_id is None] == [None]


def test_against_brute_force(spark):
    """All texts of sf0.001 with planted entities: a dictionary of all draws gives the same texts, and all
    surrogates are distinct and new."""
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    planted = {i: f"{t} Write to p{i % 50}@mail.org or +1 (988) 555-{1000 + i % 40}, Frau Ada{'bcdfg'[i % 5]}a Meier{'xyz'[i % 3]}." for i, t in texts.items()}
    docs = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_entities) for r in surrogates.replace_entities(docs, "k").collect()}
    votes: dict = {}
    for t in planted.values():
        for _, _, kind, value, hint in surrogates.find_entities(t):
            votes.setdefault((kind, value), []).append(hint)

    def hint_of(kind, value):
        hints = votes[kind, value]
        if kind != "name":
            return ""
        known = surrogates.GENDER_OF.get(value)
        if not known and not any(h.startswith("given") for h in hints):
            return "family:n"
        f, m = (sum(h.endswith(f":{g}") for h in hints) for g in "fm")
        return "given:" + (known or ("f" if f > m else "m" if m > f else "n"))

    attempt = {e: 0 for e in votes}
    while True:
        draws = {e: surrogates.surrogate(*e, hint_of(*e), "k", attempt[e]) for e in votes}
        owner: dict = {}
        for e, x in draws.items():
            owner[e[0], x] = min(owner.get((e[0], x), (99, "")), (attempt[e], e[1])) if (e[0], x) in owner else (attempt[e], e[1])
        bad = [e for e, x in draws.items() if owner[e[0], x] != (attempt[e], e[1]) or (e[0], x) in votes]
        if not bad:
            break
        for e in bad:
            attempt[e] += 1
    assert len({(k, x) for (k, _), x in draws.items()}) == len(votes)
    for i, t in planted.items():
        found = surrogates.find_entities(t)
        assert got[i] == (surrogates.rewrite(t, "k", {e: (hint_of(*e), attempt[e]) for e in votes})[0], len(found)) and len(found) >= 4
