"""Tables for model training: ids, alignment, splits, reports, imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import hash32
from .leads import FEATURES
from .quantiles import exact_quantiles
from .resampling import f1_cells

# The model's numeric and categorical columns; only sessions have engagement.
ENGAGEMENT = [
    "message_count", "avg_delay_s", "question_category_entropy", "visa_intent_mentioned",
    "returning_session", "session_word_count",
]
NUMERIC = ["funding_clarity", "funding_method_present", "has_english_test", "note_word_count", *ENGAGEMENT]
CATEGORICAL = [
    "passport_status", "qual_level", "destination_uk", "has_course", "has_intake",
    "study_gap_mentioned", "previous_application_mentioned",
]
LABELS = (0, 1, 2)


def category_text(c: Column, missing: str | None = "unknown") -> Column:
    """2, 2.0, "2" and "2.0" as "2"; missing and blank as ``missing``."""
    text = F.lower(F.trim(c.cast("string")))
    text = F.when(text.rlike(r"^-?\d+\.0+$"), F.regexp_extract(text, r"^(-?\d+)", 1)).otherwise(text)
    return F.coalesce(F.when(text.isin("", "nan"), None).otherwise(text), F.lit(missing).cast("string"))


def canonical_id(c: Column) -> Column:
    v = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(v).isin("", "nan", "none"), "").otherwise(F.regexp_replace(v, r"\.0+$", ""))


def lead_group_id(df: DataFrame) -> DataFrame:
    """A group per lead; rows without an id are groups of their own."""
    v = canonical_id(F.col("crm_id"))
    return df.withColumn("group_id", F.when(v == "", F.concat(F.lit("__row"), F.col("row_id").cast("string"))).otherwise(v))


def align_schema(*frames: DataFrame) -> DataFrame:
    """One table with the fixed columns (absent ones NULL) and known labels only."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    for c in (*FEATURES, *NUMERIC):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    columns = ["label", "source", *dict.fromkeys([*FEATURES, *NUMERIC])]
    return out.where(F.col("label").isin(*LABELS)).select(*columns)


def schema_report(df: DataFrame) -> DataFrame:
    """One row: rows, label counts, medians and modes (the least value on ties; missing is "unknown").

    The medians are found by passes over ``df`` when this is called (``exact_quantiles``), the rest when the result is read.
    """
    medians = exact_quantiles(df, NUMERIC)
    return df.agg(
        F.count("*").alias("n"), *(F.count_if(F.col("label") == k).alias(f"label_{k}") for k in LABELS),
        *(F.round(F.lit(medians[c]).cast("double"), 6).alias(f"median_{c}") for c in NUMERIC),
        *(F.mode(category_text(F.col(c)), deterministic=True).alias(f"mode_{c}") for c in CATEGORICAL),
    )


def rank_within(df: DataFrame, group: str, order: Column, tie: str, size: int = 256) -> DataFrame:
    """``rank`` (from 1) and ``n`` of the rows of each group in hash order.

    Groups may be large: rows are numbered in hash buckets, whose offsets are added.
    """
    rows = df.withColumn("_o", order).withColumn("_b", F.floor(F.col("_o") / ((1 << 32) // size)))
    counts = rows.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    inner = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_o", tie))
    return rows.withColumn("_r", inner).join(offsets, [group, "_b"]).withColumn("rank", F.col("_r") + F.col("_off")).drop("_o", "_b", "_r", "_off")


def stratified_split(df: DataFrame, test: float = 0.2, seed: str = "split") -> DataFrame:
    """``holdout`` for the first ``test`` of each label in hash order."""
    ranked = rank_within(df, "label", hash32(seed, F.col("row_id")), "row_id")
    return ranked.withColumn("holdout", F.col("rank") <= F.floor(F.col("n") * test + 0.5)).drop("rank", "n")


def fold_assign(df: DataFrame, k: int = 5, seed: str = "fold") -> DataFrame:
    """Stratified folds 0 to k - 1."""
    ranked = rank_within(df, "label", hash32(seed, F.col("row_id")), "row_id")
    return ranked.withColumn("fold", (F.pmod(F.col("rank") - 1, F.lit(k))).cast("int")).drop("rank", "n")


def fold_groups(df: DataFrame, k: int = 5, seed: str = "fold", group: str = "group_id") -> DataFrame:
    """Folds 0 to k - 1 of whole groups, stratified by the groups' majority labels."""
    groups = df.groupBy(group).agg(F.mode("label", deterministic=True).alias("_major"))
    ranked = rank_within(groups, "_major", hash32(seed, F.col(group)), group)
    return df.join(ranked.select(group, F.pmod(F.col("rank") - 1, F.lit(k)).cast("int").alias("fold")), group)


def grouped_split(df: DataFrame, test: float = 0.2, seed: str = "group") -> DataFrame:
    """``holdout`` by whole groups: per majority label, groups in hash order are taken while
    the rows before them are fewer than the share ``test``."""
    label = F.mode("label", deterministic=True).alias("major")
    groups = df.groupBy("group_id").agg(label, F.count("*").alias("size"))
    order = hash32(seed, F.col("group_id"))
    groups = groups.withColumn("_o", order).withColumn("_b", F.floor(F.col("_o") / (1 << 24)))
    totals = groups.groupBy("major", "_b").agg(F.sum("size").alias("_s"))
    upto = Window.partitionBy("major").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("major", "_b", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_off"), F.sum("_s").over(Window.partitionBy("major")).alias("_all"))
    inner = Window.partitionBy("major", "_b").orderBy("_o", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, ["major", "_b"])
    held = before.select("group_id", (F.col("_in") + F.col("_off") < F.col("_all") * test).alias("holdout"))
    return df.join(held, "group_id")


def split_overlap(split: DataFrame) -> DataFrame:
    """Holdout rows that have a row of the same lead in training."""
    train = split.where("not holdout").select("group_id").distinct().withColumn("_t", F.lit(True))
    held = split.where("holdout").join(train, "group_id", "left")
    n = F.count_if(F.col("_t").isNotNull())
    return held.agg(F.count("*").alias("holdout_rows"), n.alias("with_sibling"), F.round(n / F.count("*"), 6).alias("share"))


def leakage_report(split: DataFrame, used: DataFrame) -> DataFrame:
    """Rows a generator used, and how many of them are held out, with the first 25 ids."""
    hit = split.where("holdout").select("row_id").join(used.select("row_id").distinct(), "row_id", "left_semi")
    first = hit.orderBy("row_id").limit(25).agg(F.array_sort(F.collect_list("row_id")).alias("ids"))
    return used.agg(F.countDistinct("row_id").alias("used_rows")).join(hit.agg(F.count("*").alias("leaked_rows")), F.lit(True)).join(first, F.lit(True))


def class_weights(df: DataFrame, count: str | None = None) -> DataFrame:
    """n / (classes * rows of the class); ``count`` is the column of how many rows a row stands for."""
    counts = df.groupBy("label").agg((F.sum(count) if count else F.count("*")).alias("n"))
    every = Window.partitionBy()  # one row per class
    return counts.select("label", "n", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 6).alias("weight"))


def classification_report(pred: DataFrame) -> DataFrame:
    """Per class: confusion row, precision, recall, F1 (0 on zero division), support."""
    counts = pred.groupBy("label", "pred").agg(F.count("*").alias("n"))
    dim = counts.sparkSession.range(3).select(F.col("id").cast("int").alias("c"))
    rows = counts.join(dim, (F.col("label") == F.col("c")) | (F.col("pred") == F.col("c")), "right")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    hit = (F.col("label") == F.col("c")) & (F.col("pred") == F.col("c"))
    per = rows.groupBy("c").agg(
        total(hit).alias("tp"), total(F.col("label") == F.col("c")).alias("support"), total(F.col("pred") == F.col("c")).alias("predicted"),
        *(total((F.col("label") == F.col("c")) & (F.col("pred") == k)).alias(f"as_{k}") for k in LABELS),
    )
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    out = per.select("c", "support", "as_0", "as_1", "as_2", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))
    return out.withColumn("macro_f1", F.round(F.avg("f1").over(Window.partitionBy()), 6))


def imputation_table(df: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """(key, number, text): medians of numeric columns (0 where all are missing), modes of categories, rows per source
    and label; with a model's (feature, importance), the share that engagement has."""
    one = schema_report(df)

    def row(key: str, number: Column, text: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), number.cast("double").alias("number"), text.cast("string").alias("text"))

    none = F.lit(None)
    pairs = [row(f"median_{c}", F.coalesce(f"median_{c}", F.lit(0.0)), none) for c in NUMERIC] + [row(f"mode_{c}", none, F.col(f"mode_{c}")) for c in CATEGORICAL]
    pairs += [row(f"label_{k}", F.col(f"label_{k}"), none) for k in LABELS]
    out = one.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    out = out.unionByName(df.groupBy("source").agg(F.count("*").cast("double").alias("number")).select(F.concat(F.lit("rows_"), "source").alias("key"), "number", none.cast("string").alias("text")))
    if importance is not None:
        share = F.round(F.sum(F.when(F.col("feature").isin(ENGAGEMENT), F.col("importance")).otherwise(0.0)), 4)
        out = out.unionByName(importance.agg(share.alias("number")).select(F.lit("engagement_importance_share").alias("key"), "number", none.cast("string").alias("text")))
    return out


def imputation_drift(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose values differ or that one side lacks."""
    value = F.coalesce("text", F.col("number").cast("string"))
    a, b = stored.select("key", value.alias("stored")), new.select("key", value.alias("recomputed"))
    return a.join(b, "key", "full_outer").where(~F.col("stored").eqNullSafe(F.col("recomputed")))


def soft_label_expand(rows: DataFrame, *keep: str) -> DataFrame:
    """Each row once with its label (weight 1), and once per class with its probability; rows
    without a positive sum keep the label there too.  Columns to ``keep`` go along."""
    total = F.col("w_cold") + F.col("w_warm") + F.col("w_hot")
    soft = F.array(*(
        F.struct(F.lit(k).alias("label"), F.when(total > 0, F.col(c) / total).otherwise((F.col("label") == k).cast("double")).alias("weight"), F.lit("soft").alias("kind"))
        for k, c in enumerate(("w_cold", "w_warm", "w_hot"))
    ))
    hard = F.array(F.struct(F.col("label").alias("label"), F.lit(1.0).alias("weight"), F.lit("hard").alias("kind")))
    return rows.select("id", *keep, F.explode(F.concat(hard, soft)).alias("_soft")).select("id", *keep, "_soft.label", F.round("_soft.weight", 9).alias("weight"), "_soft.kind")


def rule_code(label: Column) -> Column:
    return F.when(label == "Cold", 0).when(label == "Warm", 1).otherwise(2)


def label_agreement(scored: DataFrame) -> DataFrame:
    """Share of rows whose rule label equals the given one, overall (-1) and per class."""
    same = (rule_code(F.col("lead_label")) == F.col("label")).cast("double")
    per = scored.where("label >= 0").rollup("label").agg(F.count("*").alias("n"), F.round(F.avg(same), 6).alias("agreement"))
    return per.withColumn("label", F.coalesce("label", F.lit(-1)))


def generated_agreement(rows: DataFrame) -> DataFrame:
    """How generated labels agree with the label model, the rubric and the label of their source row; overall (-1) and
    per class.

    ``rows`` has label, source_label, lead_label (of the rubric) and the model's pred and p_cold, p_warm, p_hot."""

    def share(same: Column) -> Column:
        return F.round(F.avg(same.cast("double")), 6)

    per = rows.rollup("label").agg(
        F.count("*").alias("n"), share(F.col("pred") == F.col("label")).alias("vs_model"), share(rule_code(F.col("lead_label")) == F.col("label")).alias("vs_rubric"),
        share(F.col("source_label") == F.col("label")).alias("vs_source"), F.round(F.avg(F.greatest("p_cold", "p_warm", "p_hot")), 6).alias("mean_confidence"),
    )
    return per.withColumn("label", F.coalesce("label", F.lit(-1)))


def uniform(seed: str, *parts: Column) -> Column:
    return hash32(seed, *parts) / float(1 << 32)


def bootstrap_with_sampled_labels(pool: DataFrame, n: int, seed: str = "boot") -> DataFrame:
    """n draws of pool rows by hash, with a label drawn from the row's probabilities."""
    size = pool.agg(F.count("*").alias("size"))
    numbered = rank_within(pool.withColumn("_g", F.lit(0)), "_g", hash32("number", F.col("id")), "id").drop("_g", "n")
    draws = pool.sparkSession.range(n).join(F.broadcast(size), F.lit(True))  # one row
    draws = draws.select(F.col("id").alias("draw"), (hash32(seed, F.col("id")) % F.col("size") + 1).alias("rank"))
    total = F.col("w_cold") + F.col("w_warm") + F.col("w_hot")
    u = uniform(f"{seed}-label", F.col("draw"))
    label = F.when(total <= 0, F.col("label")).when(u < F.col("w_cold") / total, 0).when(u < (F.col("w_cold") + F.col("w_warm")) / total, 1).otherwise(2)
    return draws.join(numbered, "rank").select("draw", F.col("id").alias("source_row_id"), F.col("label").alias("source_label"), label.alias("label"))


def seed_robustness(results: DataFrame, baseline: str = "real", keys: tuple[str, ...] = ()) -> DataFrame:
    """Per keys and variant, the gain over the baseline of the same keys and seed: mean, least, most, count and tier.

    ``results`` has (keys, variant, seed, macro_f1), such as the ``macro_f1`` rows of an experiment grid."""
    base = results.where(F.col("variant") == baseline).select(*keys, "seed", F.col("macro_f1").alias("_base"))
    rows = results.where(F.col("variant") != baseline).join(base, [*keys, "seed"]).select(*keys, "variant", (F.col("macro_f1") - F.col("_base")).alias("delta"))
    per = rows.groupBy(*keys, "variant").agg(F.round(F.avg("delta"), 6).alias("mean"), F.round(F.min("delta"), 6).alias("least"), F.round(F.max("delta"), 6).alias("most"), F.count("*").alias("n"))
    tier = (
        F.when(F.col("least") > 0.02, "ROBUST").when((F.col("least") > 0) & (F.col("most") > 0.15) & (F.col("least") < 0.05), "PARTIALLY")
        .when(F.col("least") <= 0, "SEED-SENSITIVE").otherwise("INCONCLUSIVE")
    )
    return per.withColumn("tier", tier)


def _f1_rows(pred: DataFrame, resamples: int, seed: str) -> DataFrame:
    spark = pred.sparkSession
    # A row of all variants' predictions is a cell, of which there are few: draws meet it by number and are counted at once.
    votes = F.array_sort(F.collect_list(F.struct("variant", "pred")))
    per = pred.groupBy("id", "label").agg(votes.alias("votes"))
    name = F.concat_ws(":", F.col("label"), F.array_join(F.transform("votes", lambda v: F.concat_ws("=", v["variant"], v["pred"])), ":"))
    rows = rank_within(per.select("id", name.alias("cell")).withColumn("_g", F.lit(0)), "_g", hash32("number", F.col("id")), "id").select("cell", F.col("rank").alias("i"))
    n = rows.count()
    draws = spark.range(n * resamples).select((F.col("id") / n).cast("long").alias("b"), F.expr(f"id % {max(n, 1)}").alias("j")) if n else spark.range(0).select(F.col("id").alias("b"), F.col("id").alias("j"))
    drawn = draws.select("b", (hash32(seed, F.col("b"), F.col("j")) % n + 1).alias("i")).join(rows, "i").groupBy("b", "cell").agg(F.count("*").alias("times"))
    drawn = drawn.unionByName(rows.groupBy("cell").agg(F.count("*").alias("times")).select(F.lit(-1).cast("long").alias("b"), "cell", "times"))  # -1: the rows themselves
    kinds = per.select("label", "votes").distinct().select("label", "votes", name.alias("cell")).select("cell", "label", F.explode("votes").alias("v"))
    cells = drawn.join(kinds, "cell").groupBy("b", "v.variant", "label", "v.pred").agg(F.sum("times").alias("n"))
    wide = cells.select("b", "variant", "label", "pred", "n", F.explode(F.array(*map(F.lit, LABELS))).alias("c"))
    tp = F.sum(F.when((F.col("label") == F.col("c")) & (F.col("pred") == F.col("c")), F.col("n")).otherwise(0))
    both = F.sum(F.when(F.col("label") == F.col("c"), F.col("n")).otherwise(0) + F.when(F.col("pred") == F.col("c"), F.col("n")).otherwise(0))
    per = wide.groupBy("b", "variant", "c").agg(F.when(both > 0, 2 * tp / both).otherwise(0.0).alias("f1"))
    return per.groupBy("b", "variant").agg(F.avg("f1").alias("macro_f1"), F.max(F.when(F.col("c") == 2, F.col("f1"))).alias("hot_f1"))


def bootstrap_f1_ci(pred: DataFrame, resamples: int = 1000, seed: str = "f1", base: str = "real", mode: str = "rows") -> DataFrame:
    """95 % intervals of macro-F1 and the F1 of the class 2 per variant, and of their differences from ``base``, over resamples
    of rows, or of cells of equal label and predictions (``mode="cells"``, for many rows: resamples x cells).

    ``pred`` has (id, label, variant, pred).  All variants share a resample's rows (paired): row j of resample b is the row with
    the number of a hash of both.  A resample's rows are counted per (label, pred) cell before anything else is done with them.
    """
    marks = f1_cells(pred, LABELS, resamples, seed, base) if mode == "cells" else _f1_rows(pred, resamples, seed)
    against = marks.where(F.col("variant") == base).select("b", F.col("macro_f1").alias("m0"), F.col("hot_f1").alias("h0"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in (
        ("macro_f1", F.col("macro_f1")), ("hot_f1", F.col("hot_f1")), ("delta_macro_f1", F.col("macro_f1") - F.col("m0")), ("delta_hot_f1", F.col("hot_f1") - F.col("h0"))
    ))))
    long = marks.join(against, "b").select("b", "variant", kinds.alias("x")).select("b", "variant", "x.metric", "x.v").where(~((F.col("variant") == base) & F.col("metric").startswith("delta")))
    v = F.when(F.col("b") >= 0, F.col("v"))
    out = long.groupBy("variant", "metric").agg(
        F.round(F.max(F.when(F.col("b") < 0, F.col("v"))), 6).alias("point"), F.round(F.avg(v), 6).alias("mean"),
        F.round(F.percentile(v, F.lit(0.025)), 6).alias("low"), F.round(F.percentile(v, F.lit(0.975)), 6).alias("high"),
    )
    return out.withColumn("significant", F.col("metric").startswith("delta") & ((F.col("low") > 0) | (F.col("high") < 0)))


def macro_f1_by(pred: DataFrame, *keys: str) -> DataFrame:
    """Macro-F1 over the three labels for every group of keys."""
    cells = pred.groupBy(*keys, "label", "pred").agg(F.count("*").alias("n"))
    rows = cells.select(*keys, "label", "pred", "n", F.explode(F.array(*map(F.lit, LABELS))).alias("c"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    per = rows.groupBy(*keys, "c").agg(total((F.col("label") == F.col("c")) & (F.col("pred") == F.col("c"))).alias("tp"), (total(F.col("label") == F.col("c")) + total(F.col("pred") == F.col("c"))).alias("both"))
    return per.groupBy(*keys).agg(F.round(F.avg(F.when(F.col("both") > 0, 2 * F.col("tp") / F.col("both")).otherwise(0.0)), 9).alias("macro_f1"))
