"""The engine's forms of the rules against the rules as they are fixed."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from enquira.functions import pii

PARTS = [
    "a@b.co1@c.de", "x.y@z", "me@site.org", "@home", "a@b@c.com", "12-34", "2020-2024", "2020–2024", "10.0.0.1", "+254 702 102 295", "(020) 712-345-678", "0712345678", "17000 pounds", "$1,200.50k", "kes 300",
    "1,000,000", "5 m", ",", "12 high street", "Park", "old mill ROAD", "box", "4-b lane", "twitter.com/ab", "facebook.com", "caf\u00e9", ".", "-", "(", "\u212a", "plaza.", "st. ", "\n", "\t", "ex\u00a0x",
]


def test_same_matches(spark):
    rng = random.Random(5)
    texts = [rng.choice(["", " ", "."]).join(rng.choice(PARTS) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for (m, fixed), (_, run) in zip(pii.RULES, pii._RUN):
        differ = F.regexp_replace("t", fixed, "[X]") != F.regexp_replace("t", run, "[X]")
        assert rows.where(differ | (F.regexp_count("t", F.lit(fixed)) != F.regexp_count("t", F.lit(run)))).take(1) == [], m
        assert rows.where(F.col("t").rlike(fixed)).limit(1).count() == 1, m


def test_a_long_word_is_read_once(spark):
    begun = time.time()
    found = spark.range(1).select(F.concat(F.repeat(F.lit("a"), 400_000), F.lit(" b@c.de")).alias("t")).select(pii.counts(F.col("t"))["EMAIL"]).first()[0]
    assert found == 1 and time.time() - begun < 20
