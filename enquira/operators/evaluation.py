"""Ranking metrics, run comparisons, resampling and corpus gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash32(seed: str, *parts: Column) -> Column:
    """The first 32 bits of an md5 as a number, the same in SQL engines."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def per_query(hits: DataFrame, gold: DataFrame, gate: float) -> DataFrame:
    """Top scores, rank of the gold document (NULL if not among the hits) and the decision."""
    top = hits.groupBy("query_id").agg(F.max("score").alias("top1"), F.max("cosine").alias("raw"))
    found = hits.join(gold.select("query_id", "gold_id"), "query_id").where(F.col("idx") == F.col("gold_id")).groupBy("query_id").agg(F.min("rank").alias("rank"))
    rows = gold.select("query_id", "category", "expected_abstain").join(top, "query_id", "left").join(found, "query_id", "left")
    abstain = F.coalesce(F.col("top1") < gate, F.lit(True))
    answerable = ~F.col("expected_abstain")
    return rows.select(
        "query_id", "category", "expected_abstain", F.coalesce("top1", F.lit(0.0)).alias("top1"), F.coalesce("raw", F.lit(0.0)).alias("raw"), "rank",
        abstain.alias("predicted_abstain"), (abstain == F.col("expected_abstain")).alias("correct"),
        F.coalesce(F.col("rank") <= 3, F.lit(False)).alias("recall3"), F.coalesce(F.col("rank") <= 5, F.lit(False)).alias("recall5"), (answerable & abstain).alias("false_abstention"),
    )


def _metrics() -> list[Column]:
    a = ~F.col("expected_abstain")

    def mean(value: Column) -> Column:
        return F.round(F.coalesce(F.avg(F.when(a, value)), F.lit(0.0)), 4)

    def ratio(top: Column, bottom: Column) -> Column:
        return F.round(F.when(F.count_if(bottom) > 0, F.count_if(top) / F.count_if(bottom)).otherwise(0.0), 4)

    p = F.col("predicted_abstain")
    return [
        mean(F.coalesce(F.col("rank") == 1, F.lit(False)).cast("double")).alias("rank1"), mean(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        mean(F.col("recall3").cast("double")).alias("recall3"), mean(F.col("recall5").cast("double")).alias("recall5"),
        ratio(p & ~a, p).alias("abstention_precision"), ratio(p & ~a, ~a).alias("abstention_recall"), ratio(p & a, a).alias("false_abstention_rate"),
    ]


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.col("expected_abstain")).alias("n_answerable"), *_metrics(), F.round(F.avg("top1"), 4).alias("mean_top1"), F.round(F.stddev_pop("top1"), 4).alias("std_top1"))


def by_category(rows: DataFrame, thin: int = 5) -> DataFrame:
    n = F.count_if(~F.col("expected_abstain"))
    picked = [m for m, name in zip(_metrics(), ("rank1", "mrr", "recall3")) if name]
    return rows.groupBy("category").agg(F.count("*").alias("n"), n.alias("n_answerable"), *picked, (n < thin).alias("thin"))


def threshold_sweep(hits: DataFrame, gold: DataFrame, gates: tuple = (0.2, 0.3, 0.4, 0.5, 0.6)) -> DataFrame:
    """Metrics at several gates: one search, then one pass with the gates exploded."""
    rows = per_query(hits, gold, 0.0).select("*", F.explode(F.array(*map(F.lit, gates))).alias("gate"))
    rows = rows.withColumn("predicted_abstain", (F.col("raw") == 0) | (F.col("top1") < F.col("gate")))
    return rows.groupBy("gate").agg(*_metrics())


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paired outcome of two runs per answerable query; not retrieved counts as last."""
    x = a.where(~F.col("expected_abstain")).select("query_id", F.col("rank").alias("rank_a"))
    y = b.where(~F.col("expected_abstain")).select("query_id", F.col("rank").alias("rank_b"))
    ra, rb = (F.coalesce(F.col(c), F.lit(1 << 30)) for c in ("rank_a", "rank_b"))
    return x.join(y, "query_id").select("query_id", "rank_a", "rank_b", F.when(rb < ra, "win").when(rb > ra, "loss").otherwise("tie").alias("outcome"), ((ra == 1) != (rb == 1)).alias("flip"))


def compare_summary(runs: DataFrame, cuts: tuple = (0.80, 0.60)) -> DataFrame:
    """Metrics of the runs a and b (column ``run``) and their difference (run "delta"), with mean cosines and the shares of
    answerable queries whose best cosine is above each cut."""
    a = ~F.col("expected_abstain")
    shares = [F.round(F.coalesce(F.avg(F.when(a, (F.col("raw") > c).cast("double"))), F.lit(0.0)), 4).alias(f"share_above_{int(100 * c)}") for c in cuts]
    per = runs.groupBy("run").agg(*_metrics(), F.round(F.avg("raw"), 4).alias("mean_raw"), F.round(F.avg(F.when(a, F.col("raw"))), 4).alias("mean_raw_answerable"), *shares)
    names = [c for c in per.columns if c != "run"]
    gap = per.groupBy().agg(*(F.round(F.sum(F.when(F.col("run") == "b", F.col(c)).otherwise(-F.col(c))), 4).alias(c) for c in names))
    return per.unionByName(gap.select(F.lit("delta").alias("run"), *names))


def paired_bootstrap(pairs: DataFrame, resamples: int = 1000, seed: str = "s", mode: str = "rows") -> DataFrame:
    """delta, mean and 95 % interval of the mean difference of (id, a, b) over resamples of rows, or of cells of equal
    differences (``mode="cells"``, for many rows: resamples x cells).

    Rows: row j of resample r is the row with the number of a hash of both; all draws are dealt over the tasks and joined with the
    numbered rows, so the work is resamples x rows of two integers.
    """
    from .mltables import rank_within
    from .resampling import paired_cells

    if mode == "cells":
        return paired_cells(pairs, resamples, seed)
    rows = pairs.select("id", (F.col("b") - F.col("a")).alias("diff"))
    numbered = rank_within(rows.withColumn("_g", F.lit(0)), "_g", hash32("number", F.col("id")), "id").select("diff", (F.col("rank") - 1).alias("i"))
    n = rows.count()
    draws = pairs.sparkSession.range(n * resamples).select(F.expr(f"id div {max(n, 1)}").alias("r"), F.expr(f"id % {max(n, 1)}").alias("j"))
    draws = draws.select("r", (hash32(seed, F.col("r"), F.col("j")) % max(n, 1)).alias("i"))
    means = draws.join(numbered, "i").groupBy("r").agg(F.avg("diff").alias("m"))
    ci = means.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("delta")).join(ci, F.lit(True))


def withhold(gold: DataFrame, corpus: DataFrame, share: float = 0.3, seed: str = "w") -> tuple[DataFrame, DataFrame]:
    """(withheld ids, reduced corpus): a share of the distinct needed ids, at least one, the first in hash order."""
    from .mltables import rank_within

    needed = gold.where(F.col("gold_id").isNotNull()).select(F.col("gold_id").alias("idx"), F.lit(0).alias("_g")).distinct()
    ranked = rank_within(needed, "_g", hash32(seed, F.col("idx")), "idx")
    gone = ranked.where(F.col("rank") <= F.greatest(F.floor(F.col("n") * share + 0.5), F.lit(1))).select("idx")
    return gone, corpus.join(gone, "idx", "left_anti")


def adaptation_report(stages: DataFrame, boot: DataFrame) -> DataFrame:
    """One row per stage (full, cold, restored, targeted): its metrics, the gain over the cold stage, the share of the loss that
    is recovered (NULL if nothing was lost), the gap that is left to the full restore, and the interval of the gain.

    ``stages`` has per-query rows with ``stage``; ``boot`` (stage, metric, low, high)."""
    per = stages.groupBy("stage").agg(*_metrics())
    marks = [F.max(F.when(F.col("stage") == s, F.col(m))).alias(f"{s}_{m}") for s in ("full", "cold", "restored") for m in ("recall3", "recall5")]
    joined = per.join(F.broadcast(per.agg(*marks)), F.lit(True))  # one row
    extra = []
    for m in ("recall3", "recall5"):
        lost, gained = F.col(f"full_{m}") - F.col(f"cold_{m}"), F.col(m) - F.col(f"cold_{m}")
        extra += [F.round(gained, 4).alias(f"gain_{m}"), F.round(F.when(lost != 0, gained / lost), 4).alias(f"recovery_{m}"), F.round(F.col(f"restored_{m}") - F.col(m), 4).alias(f"residual_{m}")]
    wide = boot.groupBy("stage").agg(*(F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{e}_{m}") for m in ("recall3", "recall5") for e in ("low", "high")))
    return joined.select(*per.columns, *extra).join(wide, "stage", "left")


def probe_gaps(rows: DataFrame) -> DataFrame:
    """Answerable probe queries whose document is missing or below rank 3, with the reason."""
    bad = rows.where(~F.col("expected_abstain") & (F.col("rank").isNull() | (F.col("rank") > 3)))
    return bad.select("query_id", "category", F.when(F.col("rank").isNull(), "not_retrieved").otherwise("low_rank").alias("reason"), F.col("predicted_abstain").alias("below_gate"))


def targeted_restore(gaps: DataFrame, probes: DataFrame, withheld: DataFrame, corpus: DataFrame) -> DataFrame:
    """Withheld ids that the probes need, and withheld ids of the categories of failing ones."""
    needed = probes.where(F.col("gold_id").isNotNull()).select(F.col("gold_id").alias("idx"))
    alike = corpus.join(gaps.select("category").distinct(), "category", "left_semi").select("idx")
    return withheld.join(needed, "idx", "left_semi").unionByName(withheld.join(alike, "idx", "left_semi")).distinct()
