"""Lines that stand in many documents are dropped from all of them.

Every text is split at line feeds and each line's key (ends stripped of the six ASCII space
characters, A-Z in lower case) is hashed to 128 bits.  Distinct (hash, document) rows are counted per
hash with partial sums; the lines of a hash over the threshold meet their documents again as
positions, and each text is put together from the positions that are left.  Texts are shuffled
once, for that last join; lines travel as hashes and numbers.  A line that stands in a third of
all documents is a hot key of one join, which Spark splits; the hashes over the threshold are
broadcast by Spark only if it finds them small.

Defined cases: a null or empty text is one empty line, and comes out empty; blank lines have an empty key and
stay while ``min_chars`` is at least 1; documents are told apart by doc_id, those without
one by their text, so rows that repeat a document count once and are each cleaned; texts and lines of any length are
kept whole; an empty table gives an empty result; all other columns stay as they are, and names of new columns
that clash with them get underscores before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names

MIN_DOCUMENTS = 10
MIN_CHARS = 1
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without space characters at its ends, A-Z in lower case and all else as it is."""
    bare = F.btrim(line, F.lit(SPACES))
    plain = F.octet_length(bare) == F.char_length(bare)  # ASCII only: the built-in lower case is A-Z alone
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashed(*columns: Column) -> Column:
    """128 bits: two 64-bit hashes with different seeds."""
    return F.struct(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("line"), *columns).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_repeated_lines(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``documents`` with the lines of each text that stay, and with ``n_lines`` and ``n_dropped``.

    A line goes if its key has ``min_chars`` code points or more and stands in ``min_documents`` documents or more.
    """
    n_lines, n_dropped = free_names(documents.columns, "n_lines", "n_dropped")
    row = hashed(F.col("doc_id"), F.col("text"))
    document = F.when(F.col("doc_id").isNotNull(), hashed(F.col("doc_id"))).otherwise(hashed(F.lit("no id"), F.col("text")))
    lines = documents.select(row.alias("row"), document.alias("document"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    lines = lines.select("row", "document", "pos", line_key(F.col("line")).alias("text")).where(F.char_length("text") >= min_chars)
    lines = lines.select("row", "document", "pos", hashed(F.col("text")).alias("key"))
    common = lines.select("key", "document").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("key")
    dropped = lines.select("row", "pos", "key").join(common, "key").groupBy("row").agg(F.collect_set("pos").alias("pos"))
    texts = documents.select(*(F.col(c) for c in documents.columns), row.alias("_row_of_lines"))
    dropped = dropped.select(F.col("row").alias("_row_of_lines"), F.col("pos").alias("_dropped_lines"))
    joined = texts.join(dropped, "_row_of_lines", "left")
    lines = lines_of(F.col("text"))
    gone = F.coalesce("_dropped_lines", F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    cleaned = F.when(F.size(gone) == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        *(cleaned.alias("text") if c == "text" else F.col(c) for c in documents.columns),
        F.size(lines).cast("long").alias(n_lines), F.size(gone).cast("long").alias(n_dropped),
    )


# ---- the registered query ---------------------------------------------------------------------


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents
), placed AS (
  SELECT doc_id, unnest(line) AS line, unnest(range(len(line))) AS pos FROM lines
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM placed
), common AS (
  SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {"op12_line_dedup": op12_line_dedup}
ORACLE_SQL = {"op12_line_dedup": ORACLE}
