"""Small tables with the cases that every operator must survive."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} other{i}" for i in range(30_000)) + "."
PASSAGE = " ".join(f"shared{i}" for i in range(70)) + "."


def documents(spark, extra: bool = True):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a", 10),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a", 10),
        (2, "The quick brown fox jumps over the lazy dog near the old river bank today.", "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "en", "", 0),
        (5, "   \n\t ", "en", "b", 5),
        (6, "tie", "en", "b", 3),
        (7, "tie", "en", "b", 3),
        (None, "A text without an id but with some words in it.", "en", "c", 1),
        (8, LONG, "en", "c", len(LONG)),
        (9, f"First line here.\n{PASSAGE}\nLast line of nine.", "en", "c", 1),
        (10, f"Some other words before it stand {PASSAGE} and some words after it too.", "en", None, 1),
        (11, "<|endoftext|> Ünïcode ß 中文 emoji 😀 \x00 end", "de", "d", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for c in ("row", "node", "xx", "size", "kind", "held", "n", "_h", "rank"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 1), (8, 1, 0), (9, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
