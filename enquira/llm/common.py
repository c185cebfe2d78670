"""Shared helpers: the shared folder, lineage cuts, word splitting, prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words in JVM patterns: maximal runs without the six ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"

_LETTERS = bytes(range(256)).translate(None)
#: For bytes: ASCII upper case to lower case, ASCII punctuation to spaces.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else 32 if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else c
    for c in _LETTERS
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  A temporary one stands in for it only where none is
    set and everything runs in one JVM; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs, also those
    that follow the loss of an executor, start from its files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_words(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation, as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(WORD_TABLE).split()


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums within ``keys``, for groups of any size.

    ``bucket`` splits each group into runs that follow one another in its order
    (nulls first); a run is summed by one task and the totals of the runs, far fewer rows,
    are summed above that.  ``sums`` maps new column names to the summed ones.
    """
    totals = df.groupBy(*keys, bucket).agg(*(F.sum(c).alias(f"_run_{n}") for n, c in sums.items()))
    above = Window.partitionBy(*keys).orderBy(F.col(bucket).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *(F.col(k).alias(f"_key_{k}") for k in [*keys, bucket]),
        *(F.coalesce(F.sum(f"_run_{n}").over(above), F.lit(0)).alias(f"_off_{n}") for n in sums),
    )
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()))
    on = [inner[k].eqNullSafe(offsets[f"_key_{k}"]) for k in [*keys, bucket]]
    joined = inner.join(offsets, on, "left")
    return joined.select(*df.columns, *((F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums))


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n in taken:
            n = f"_{n}"
        out.append(n)
    return out


def ranked(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """The table range-sorted by ``order`` and written, with each row's number ``name`` in it (from 0).

    A row's number is its place in its range plus the sizes of the ranges before, one row each.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = cut(rows.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")), label)
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = rows.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(above), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "_range").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


def hash_sample(df: DataFrame, most: int, seed: int, *keys: str) -> DataFrame:
    """At most ``most`` rows of a table, the same ones in each run: those with the smallest
    hash of ``keys``.  Only about a fifth more rows than these are sorted."""
    rows = df.withColumn("_hash", F.xxhash64(F.lit(seed), *keys))
    n = rows.count()
    if n > most:
        share = min(1.0, 1.2 * most / n + 200.0 / n)
        rows = rows.where(F.pmod("_hash", F.lit(1 << 30)) < int(share * (1 << 30)))
    return rows.orderBy(F.pmod("_hash", F.lit(1 << 30)), "_hash", *keys).limit(most).drop("_hash")
