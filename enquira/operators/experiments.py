"""The augmentation study as one grid: variants x feature sets x seeds on one stored matrix per feature set.

Splits of all seeds are tags of that matrix, fits run at the same time, and only their scores reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from enquira.sources.shared import stored

from .matrix import build_matrix, with_columns
from .mltables import grouped_split, soft_label_expand, stratified_split
from .models import PROBABILITIES, fold_scores, label_model, predict_proba, train_model, with_weights

FEATURE_SETS = {"full": {}, "no-engagement": {"drop_engagement": True}, "no-english": {"drop_english": True}}
SCHEMA = "split string, feature_set string, variant string, seed int, metric string, score double, n_train long, n_holdout long"
REAL, DISTILLED = "real", "distilled"

#: Makes synthetic rows from training rows and a seed.
Generator = Callable[[DataFrame, int], DataFrame]


@dataclass
class Cell:
    feature_set: str
    variant: str
    seed: int
    train: DataFrame
    test: DataFrame
    names: list[str]


def tagged(real: DataFrame, seeds: list[int], split: str) -> DataFrame:
    """The rows with ``holdout_<seed>`` for every seed, by rows ("rows") or by whole lead groups ("grouped")."""
    rows = real
    for seed in seeds:
        held = grouped_split(real, seed=f"group-{seed}") if split == "grouped" else stratified_split(real, seed=f"split-{seed}")
        rows = rows.join(held.select("row_id", F.col("holdout").alias(f"holdout_{seed}")).hint("merge"), "row_id")  # a row each: too many to broadcast
    return rows


def soft_rows(train: DataFrame, scored: DataFrame) -> DataFrame:
    """Training rows of a matrix once with their label and once per class with the label model's probability as weight;
    classes are balanced over all of these rows."""
    soft = scored.select("row_id", F.array(*PROBABILITIES).alias("_soft")).hint("merge")
    return expanded(train.join(soft, "row_id"), "_soft")


def expanded(train: DataFrame, soft: str) -> DataFrame:
    """``soft_rows`` of training rows that have the probabilities in the array column ``soft``."""
    keep = [c for c in train.columns if c not in ("row_id", "label", soft)]
    asked = train.select(F.col("row_id").alias("id"), "label", *keep, *(F.col(soft)[k].alias(w) for k, w in enumerate(("w_cold", "w_warm", "w_hot"))))
    rows = with_weights(soft_label_expand(asked, *keep).select(F.col("id").alias("row_id"), "label", *keep, F.col("weight").alias("share")))
    return rows.withColumn("weight", F.col("weight") * F.col("share")).drop("share")


def check_sources(synthetic: DataFrame, held: DataFrame) -> None:
    """Synthetic rows made of held-out rows (``source_row_id``) are an error."""
    if "source_row_id" in synthetic.columns and synthetic.join(held.select(F.col("row_id").alias("source_row_id")).hint("merge"), "source_row_id", "left_semi").take(1):
        raise AssertionError("held-out rows were used for generation")


def cells_of(real: DataFrame, generators: dict[str, Generator], seeds: list[int], feature_sets: list[str], distill: dict | None) -> list[Cell]:
    """All cells; ``real`` is tagged.  ``distill`` are the label model's options, None leaves the distilled variant out."""
    out = []
    made = {}
    rows = real
    for seed in seeds:
        train, held = real.where(~F.col(f"holdout_{seed}")), real.where(f"holdout_{seed}")
        if distill is not None:
            ask, _ = build_matrix(train, drop_engagement=True)
            scored = stored(predict_proba(label_model(train, **distill), ask).select("row_id", F.array(*PROBABILITIES).alias(f"soft_{seed}")), "soft")
            # beside the rows from here on, so no fit joins by row; a row's id is far smaller than its estimate says, too much to broadcast
            rows = rows.join(scored.hint("merge"), "row_id", "left")
        made[seed] = {}
        for name, generate in generators.items():
            synthetic = stored(generate(train, seed), "synthetic")
            check_sources(synthetic, held)
            made[seed][name] = synthetic
    for feature_set in feature_sets:
        options = FEATURE_SETS[feature_set]
        matrix, names = build_matrix(rows, **options)
        matrix = stored(matrix, "grid")
        for seed in seeds:
            train, test = matrix.where(~F.col(f"holdout_{seed}")), matrix.where(f"holdout_{seed}")
            out.append(Cell(feature_set, REAL, seed, train, test, names))
            if distill is not None:
                out.append(Cell(feature_set, DISTILLED, seed, expanded(train.select("row_id", "label", f"soft_{seed}", *names), f"soft_{seed}"), test, names))
            for name, synthetic in made[seed].items():
                more, more_names = build_matrix(synthetic, **options)
                every = list(dict.fromkeys([*names, *more_names]))
                both = with_columns(train, every).select("label", *every).unionByName(with_columns(more, every).select("label", *every))
                out.append(Cell(feature_set, name, seed, both, test, every))
    return out


def experiment_grid(
    real: DataFrame, generators: dict[str, Generator], seeds: list[int], feature_sets: tuple[str, ...] = ("full", "no-engagement"),
    split: str = "rows", kind: str = "rf", distill: dict | None = None, at_once: int = 4, **options,
) -> DataFrame:
    """(split, feature_set, variant, seed, metric, score, n_train, n_holdout): macro-F1 and the F1 of every class on the real holdout of
    each seed, of models of the real training rows ("real"), with the rows of each generator, and with soft labels ("distilled").

    ``real`` has row_id, group_id, label and the features.  A seed drives its split, its label model and its generators; medians come from each
    frame on its own.  ``at_once`` fits run at the same time."""
    spark = real.sparkSession
    rows = stored(tagged(real, seeds, split), "tagged")
    cells = cells_of(rows, generators, seeds, list(feature_sets), {"trees": 100} | distill if distill is not None else None)

    def run(cell: Cell) -> list[tuple]:
        model = train_model(cell.train, cell.names, kind, **options)
        found = stored(predict_proba(model, with_columns(cell.test, cell.names)).select("label", "pred"), "scores")
        sizes = cell.train.count(), found.count()
        return [(split, cell.feature_set, cell.variant, cell.seed, r["metric"], float(r["score"]), *sizes) for r in fold_scores(found).collect()]  # four rows

    with ThreadPoolExecutor(at_once) as pool:
        found = [row for part in pool.map(inheritable_thread_target(spark)(run), cells) for row in part]
    return spark.createDataFrame(found, SCHEMA)


def union_scores(real: DataFrame, synthetic: DataFrame, split: str = "rows", seed: int = 42, kind: str = "rf", drop_engagement: bool = False, **options) -> DataFrame:
    """(metric, score) of a model fitted and scored on a split of real and synthetic rows together; synthetic rows are groups of their own."""
    last = real.agg(F.max("row_id")).first()[0] or 0
    more = synthetic.withColumn("row_id", F.monotonically_increasing_id() + last + 1)
    more = more.withColumn("group_id", F.concat(F.lit("synthetic-"), F.col("row_id").cast("string")))
    every = stored(real.unionByName(more.select(*(c if c in more.columns else F.lit(None).cast(real.schema[c].dataType).alias(c) for c in real.columns))), "union")
    matrix, names = build_matrix(tagged(every, [seed], split), drop_engagement=drop_engagement)
    matrix = stored(matrix, "union-matrix")
    model = train_model(matrix.where(~F.col(f"holdout_{seed}")), names, kind, **options)
    return fold_scores(predict_proba(model, matrix.where(f"holdout_{seed}")).select("label", "pred")).select("metric", F.round("score", 6).alias("score"))


def deltas(results: DataFrame, *keys: str, baseline: str = REAL) -> DataFrame:
    """(keys, variant, seed, delta): the gain over the baseline of the same keys and seed, of (keys, variant, seed, macro_f1)."""
    base = results.where(F.col("variant") == baseline).select(*keys, "seed", F.col("macro_f1").alias("_base"))
    return results.where(F.col("variant") != baseline).join(base, [*keys, "seed"]).select(*keys, "variant", "seed", (F.col("macro_f1") - F.col("_base")).alias("delta"))


def distill_check(results: DataFrame, augmented: str, distilled: str = DISTILLED, keys: tuple[str, ...] = ("feature_set",), band: float = 0.02) -> DataFrame:
    """Per keys and seed what the augmented variant gains beyond the distilled one; ``confirmed`` if that is within the band, so
    that soft labels alone explain the gain."""
    per = deltas(results, *keys).groupBy(*keys, "seed").agg(*(F.max(F.when(F.col("variant") == v, F.col("delta"))).alias(c) for v, c in ((augmented, "d_augmented"), (distilled, "d_distilled"))))
    rest = F.col("d_augmented") - F.col("d_distilled")
    return per.select(*keys, "seed", *(F.round(c, 6).alias(c) for c in ("d_augmented", "d_distilled")), F.round(rest, 6).alias("increment"), F.coalesce(F.abs(rest) < band, F.lit(False)).alias("confirmed"))


def split_comparison(by_rows: DataFrame, grouped: DataFrame, keys: tuple[str, ...] = ("feature_set",)) -> DataFrame:
    """Per keys and variant the mean, least and most gain over the seeds that both row-level and grouped results have."""

    def side(results: DataFrame, name: str) -> DataFrame:
        return deltas(results, *keys).select(*keys, "variant", "seed", F.col("delta").alias(name))

    both = side(by_rows, "rows").join(side(grouped, "grouped"), [*keys, "variant", "seed"])
    figures = [f(c).alias(f"{c}_{n}") for c in ("rows", "grouped") for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))]
    per = both.groupBy(*keys, "variant").agg(F.count("*").alias("n_seeds"), *figures)
    return per.select(*keys, "variant", "n_seeds", *(F.round(c, 6).alias(c) for c in per.columns if c.startswith(("rows_", "grouped_"))))
