"""Resampling of counted cells: the work is resamples x cells, whatever the number of rows.

A bootstrap resample gives each row a Poisson(1) weight; the weights of the n equal rows of a cell add up to a Poisson(n)
one.  That is drawn as a sum over the bits of n, since Poisson(a + b) = Poisson(a) + Poisson(b): bits up to
2**EXACT_BIT by inversion of their distribution, in integers of 32 bits, larger ones as rounded normal values of the same mean and
variance.  Draws come from hashes of the resample, the cell's name and the bit, so reruns agree and SQL engines draw the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import hash32

EXACT_BIT = 5
#: Resamples drawn together.
BLOCK = 50


def poisson_steps(mean: int) -> list[int]:
    """The distribution's values as shares of 2**32; a draw h has as many events as steps at or below it."""
    out, total, k, p = [], 0.0, 0, math.exp(-mean)
    while (step := int((total + p) * 2**32)) < 2**32 and (p > 2**-60 or k < mean):
        total += p
        out.append(step)
        k += 1
        p *= mean / k
    return out


STEPS = [poisson_steps(1 << bit) for bit in range(EXACT_BIT + 1)]


def poisson(bit: Column, h: Column, h2: Column) -> Column:
    """A draw with mean 2**bit from two hashes of 32 bits."""
    steps = F.array(*(F.array(*(F.lit(x) for x in s)) for s in STEPS))
    mean = F.pow(F.lit(2.0), bit)
    normal = F.sqrt(-2 * F.log((h + 1) / F.lit(2.0**32))) * F.cos(h2 * F.lit(2 * math.pi / 2.0**32))
    rounded = F.greatest(F.floor(mean + F.sqrt(mean) * normal + 0.5), F.lit(0)).cast("long")
    return F.when(bit <= EXACT_BIT, F.size(F.filter(F.get(steps, bit.cast("int")), lambda x: x <= h)).cast("long")).otherwise(rounded)


def weights(cells: DataFrame, resamples: int, seed: str, name: str = "cell", count: str = "n") -> DataFrame:
    """(r, cell, w): every cell's weight in every resample; cells that weigh 0 are left out."""
    one = F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col(count).cast("double"))).cast("int") + 1)).alias("bit")
    rows = cells.select(F.col(name).alias("cell"), F.col(count).alias("_n"), one)
    rows = rows.where(F.floor(F.col("_n") / F.pow(F.lit(2.0), F.col("bit"))) % 2 == 1)
    # Few rows become many here: blocks of resamples are dealt out before they are drawn.
    blocks = rows.select("cell", "bit", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(BLOCK))).alias("from"))
    blocks = blocks.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell", "bit", "from")
    rows = blocks.select("cell", "bit", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + BLOCK, F.lit(resamples)) - 1)).alias("r"))
    key = [F.col("r"), F.col("cell"), F.col("bit")]
    drawn = rows.select("r", "cell", poisson(F.col("bit"), hash32(seed, *key), hash32(f"{seed}-2", *key)).alias("w"))
    return drawn.groupBy("r", "cell").agg(F.sum("w").alias("w")).where("w > 0")


def interval(v: Column) -> list[Column]:
    return [F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, F.lit(0.025)), 6).alias("low"), F.round(F.percentile(v, F.lit(0.975)), 6).alias("high")]


def paired_cells(pairs: DataFrame, resamples: int = 1000, seed: str = "s") -> DataFrame:
    """n, delta, mean, low and high of the differences b - a of (id, a, b), in millionths; resamples without any row do not count."""
    cells = pairs.select(F.round((F.col("b") - F.col("a")) * 1_000_000).cast("long").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    drawn = weights(cells, resamples, seed).groupBy("r").agg((F.sum(F.col("w") * F.col("cell")) / F.sum("w") / 1_000_000).alias("m"))
    point = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.sum(F.col("n") * F.col("cell")) / F.sum("n") / 1_000_000, 6).alias("delta"))
    return point.join(drawn.agg(*interval(F.col("m"))), F.lit(True))  # one row each


def gain_cells(rows: DataFrame, metrics: tuple[str, ...], base: str, resamples: int = 1000, seed: str = "g") -> DataFrame:
    """(stage, metric, mean, low, high) of the gains of every other stage over ``base``, per query of (query_id, stage, metrics ...).

    A cell is the list of a query's outcomes in all stages and metrics, so all intervals share a resample's draws; a query that
    a stage lacks counts as 0 there."""
    outcome = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("int").alias("x")) for m in metrics)))
    long = rows.select("query_id", "stage", outcome.alias("o")).select("query_id", F.concat_ws("/", "stage", "o.metric").alias("k"), F.col("o.x").alias("x"))
    hit = F.array_join(F.array_sort(F.collect_set(F.when(F.col("x") == 1, F.col("k")))), ",")
    cells = long.groupBy("query_id").agg(hit.alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    kinds = rows.select("stage").distinct().where(F.col("stage") != base).select("stage", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    held = F.split("cell", ",")

    def has(stage: Column) -> Column:
        return F.array_contains(held, F.concat_ws("/", stage, F.col("metric"))).cast("long")

    drawn = weights(cells, resamples, seed).join(F.broadcast(kinds), F.lit(True))  # a few stages and metrics
    gain = F.sum(F.col("w") * (has(F.col("stage")) - has(F.lit(base)))) / F.sum("w")
    return drawn.groupBy("r", "stage", "metric").agg(gain.alias("v")).groupBy("stage", "metric").agg(*interval(F.col("v")))


def f1_cells(pred: DataFrame, labels: list[int], resamples: int = 1000, seed: str = "f1", base: str = "real") -> DataFrame:
    """(b, variant, macro_f1, hot_f1) of every resample; b = -1 are the rows themselves.

    A cell is a label with the predictions of all variants, so variants share a resample's draws (paired)."""
    votes = F.array_sort(F.collect_set(F.struct("variant", "pred")))
    per = pred.groupBy("id", "label").agg(votes.alias("votes"))
    name = F.concat_ws(":", F.col("label"), F.array_join(F.transform("votes", lambda v: F.concat_ws("=", v["variant"], v["pred"])), ":"))
    cells = per.groupBy("label", "votes").agg(F.count("*").alias("n")).withColumn("cell", name)
    drawn = weights(cells, resamples, seed).select(F.col("r").cast("long").alias("b"), "cell", "w")
    drawn = drawn.unionByName(cells.select(F.lit(-1).cast("long").alias("b"), "cell", F.col("n").alias("w")))
    counted = drawn.join(cells.select("cell", "label", F.explode("votes").alias("v")), "cell")
    counted = counted.groupBy("b", "v.variant", "label", "v.pred").agg(F.sum("w").alias("n"))
    wide = counted.select("b", "variant", "label", "pred", "n", F.explode(F.array(*map(F.lit, labels))).alias("c"))
    tp = F.sum(F.when((F.col("label") == F.col("c")) & (F.col("pred") == F.col("c")), F.col("n")).otherwise(0))
    both = F.sum(F.when(F.col("label") == F.col("c"), F.col("n")).otherwise(0) + F.when(F.col("pred") == F.col("c"), F.col("n")).otherwise(0))
    f1 = wide.groupBy("b", "variant", "c").agg(F.when(both > 0, 2 * tp / both).otherwise(0.0).alias("f1"))
    return f1.groupBy("b", "variant").agg(F.avg("f1").alias("macro_f1"), F.max(F.when(F.col("c") == 2, F.col("f1"))).alias("hot_f1"))
