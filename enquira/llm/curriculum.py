"""Time-varying curriculum: sources mixed to target weights, ordered by training position.

Each source has a target in words.  Its documents follow one another in hash order and are
repeated until the target is met; the document at the boundary is taken in part.  A word
at offset ``a`` of a source's demand gets the training position ``t`` in [0, 1] at which
the source's integrated weight schedule reaches the share ``a / target``; the mix is the
table of takes, range-sorted by position.

The schedule of a source runs linearly from ``start`` to ``end`` (relative rates), so its
integral is quadratic and inverts in closed form.

Defined cases: a null text has no words, size 0 and takes 0, and so does an empty one; a very long
text is one document and is cut at a boundary only; null sources form one source, ordered last; repeated
rows are separate documents that follow one another (in ``mix``, which joins the texts back by
doc_id and text, they take alike); takes at one position follow one another by source, doc_id,
row and copy; other columns, whatever their names, are kept by ``mix`` and not read by ``assign``; an empty table gives an
empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, prefix_sums, ranked

WEIGHTS = (3.0, 1.0, 2.0)
#: Relative rates at the start and the end of training, repeated along the sources.
RAMPS = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets per source: weights in code-point order, stopped at ``most`` times the size.

    The water level rises until no further source is full: each round is one aggregate over the
    table of sources, and the driver sees its three sums only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked_ = ranked(per, [F.col("source").asc_nulls_last()], "source_no", "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("source_no") % len(weights) + 1).cast("int"))
    by = cut(ranked_.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double")), "mix-targets")
    level, n_full = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= level * F.col("weight")
        t = by.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("open"), F.sum(full.cast("int")).alias("n")).first()
        if not t["open"] or t["n"] == n_full:
            break
        level, n_full = (share * t["all"] - t["full"]) / t["open"], t["n"]
    target = F.least("cap", F.lit(level or 0.0) * F.col("weight")) if t["open"] else F.col("cap")
    return by.select("source", "source_no", "source_size", "weight", target.alias("target"))


def position_of(share: Column, start: Column, end: Column) -> Column:
    """Time at which the integral of a linear rate reaches a share of its whole."""
    whole = (start + end) / 2
    slope = end - start
    root = (F.sqrt(F.greatest(start * start + 2 * slope * whole * share, F.lit(0.0))) - start) / F.when(slope != 0, slope)
    return F.least(F.greatest(F.when(slope == 0, share).otherwise(root), F.lit(0.0)), F.lit(1.0))


def _keyed(documents: DataFrame, seed: int) -> DataFrame:
    return documents.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text"))


def assign(documents: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, ramps: tuple = RAMPS, seed: int = 11, run_rows: int = 50_000) -> DataFrame:
    """One row per document: ``_row`` (a number of its own), doc_id, source, size, source_size, target, taken, its
    hash ``_h`` and its takes as an array of (copy, words, position).  A source's offsets are summed
    in 1,024 runs, or more where a run would hold over ``run_rows`` documents."""
    sized = _keyed(documents, seed).select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "_h")
    sized = cut(sized.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    targets = source_targets(sized, weights, share, most)
    bits = max(10, math.ceil(math.log2(max(1, sized.count()) / run_rows)))
    order = [F.col("_h"), F.col("doc_id").asc_nulls_first(), F.col("_row")]
    placed = prefix_sums(sized.withColumn("_run", F.shiftright("_h", 64 - bits)), ["source"], "_run", order, {"_at": "size"})
    t = targets.withColumnRenamed("source", "_source")
    joined = placed.join(t, placed["source"].eqNullSafe(t["_source"]), "left")
    pick = (F.col("source_no") % len(ramps) + 1).cast("int")
    start, end = (F.element_at(F.array(*(F.lit(float(r[i])) for r in ramps)), pick) for i in (0, 1))
    takes = []
    for k in range(math.ceil(most)):
        at = F.col("_at") + k * F.col("source_size")
        words = F.least(F.greatest(F.round("target").cast("long") - at, F.lit(0)), F.col("size"))
        where = position_of(F.coalesce(F.try_divide(at, F.col("target")), F.lit(0.0)), start, end)
        takes.append(F.struct(F.lit(k).alias("copy"), words.cast("long").alias("words"), where.alias("position")))
    joined = joined.withColumn("takes", F.filter(F.array(*takes), lambda x: x["words"] > 0))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return joined.select("_row", "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "takes", "_h")


def training_order(assigned: DataFrame) -> DataFrame:
    """The mix as a table of takes (_row, doc_id, source, copy, words, position, rank), range-sorted by
    position; ``rank`` numbers them in training order, from 0."""
    takes = assigned.select("_row", "doc_id", "source", F.explode("takes").alias("t")).select("_row", "doc_id", "source", "t.*")
    return ranked(takes, [F.col("position"), F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_first(), F.col("_row"), F.col("copy")], "rank", "mix-order")


def mix(documents: DataFrame, partitions: int | None = None, seed: int = 11, **options) -> DataFrame:
    """The mix itself: the columns of ``documents`` with a row per whole take, range-sorted by
    training position; ``_copy``, ``_words`` and ``_position`` are added and replace columns of those names.
    The document at a source's boundary is taken whole if half of it or more is within the
    target.  Identical rows take alike."""
    documents = documents.drop("_copy", "_words", "_position")
    per = assign(documents, seed=seed, **options)
    takes = per.groupBy(F.col("doc_id").alias("k_doc"), F.col("_h").alias("k_hash")).agg(F.min(F.struct(-F.size("takes"), "takes", "size"))["takes"].alias("takes"), F.any_value("size").alias("size"))
    takes = takes.select("k_doc", "k_hash", F.explode(F.filter("takes", lambda x: 2 * x["words"] >= F.col("size"))).alias("take"))
    rows = documents.select(F.struct("*").alias("d"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))  # the document's columns in one: no name clashes
    joined = rows.join(takes, F.col("d.doc_id").eqNullSafe(F.col("k_doc")) & (F.col("h") == F.col("k_hash")))
    out = joined.select("d", "take")
    order = ["take.position", "d.source", "d.doc_id", "take.copy"]
    n = partitions or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = out.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ordered.select("d.*", F.col("take.copy").alias("_copy"), F.col("take.words").alias("_words"), F.col("take.position").alias("_position"))


def op6_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, summed up from the range-sorted takes, with all positions and ranks."""
    found = cut(assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")), "mix-assigned")
    at = F.struct("position", "rank")
    per = training_order(found).groupBy("_row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(at)).alias("at"))  # one take per copy
    out = found.drop("taken").join(per, "_row", "left")
    return out.select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        F.coalesce(F.col("at.position"), F.array().cast("array<double>")).alias("positions"), F.coalesce(F.col("at.rank"), F.array().cast("array<long>")).alias("ranks"),
    )


QUERIES = {"op6_curriculum": op6_curriculum}
