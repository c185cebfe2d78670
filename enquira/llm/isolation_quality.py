"""Quality rules and an isolation forest over the statistics that the rules use.

Statistics of every whole text are computed in one scan.  The forest isolates rows by
random splits; rows with short paths are anomalous.  Its trees are fitted on a bounded,
hash-chosen set of rows (``trees * per_tree``, the subsampling that the method itself
prescribes); every row is scored.  The threshold on the anomaly score is calibrated on
all labelled rows, from counts per score step.

Defined cases: a null or empty text has no words, so its statistics are 0 and the base
rule rejects it; rows with one doc_id are judged separately, each by its own text; a null
doc_id is kept as it is and finds no label; without usable labels the share ``default_share``
of rows that pass the base rules is rejected; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hash_sample

_SYMBOL = re.compile(r"[#*$%&|<>]")
_PUNCT_ENDS = tuple(".,;:!?")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_distinct", "n_ends"]
FEATURES = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "end_share", "words_per_line"]


def text_stats(text: str | None) -> tuple:
    """The contract's counts, then lines, distinct words and words with final punctuation."""
    if not text:
        return (0,) * 8
    lines = text.split("\n")
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at the six ASCII space characters only
    if not words:
        return (0, 0, len(_SYMBOL.findall(text)), 0, 0, 0, 0, 0)
    seen: set[str] = set()
    dup = n_lines = 0
    for line in lines:
        if line and line.encode("utf-8", "surrogatepass").split():
            n_lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    spaces = sum(map(text.count, " \t\n\r\x0b\x0c"))
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    n = len(words)
    repeat = 0
    if n >= 4:
        m = len(ids)
        if m < 2_000_000:
            key = (w[:-2] * m + w[1:-1]) * m + w[2:]
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            hit = count[inverse] > 1
        else:
            tri = list(zip(words, words[1:], words[2:]))
            count = Counter(tri)
            hit = np.fromiter((count[t] > 1 for t in tri), bool, n - 2)
        covered = np.zeros(n, bool)
        covered[:-2] |= hit
        covered[1:-1] |= hit
        covered[2:] |= hit
        repeat = int(covered.sum())
    ends = sum(data.count(e) for e in (b". ", b".\n", b"? ", b"! ", b"?\n", b"!\n")) + data.endswith((b".", b"!", b"?"))
    return (n, len(text) - spaces, len(_SYMBOL.findall(text)), dup, repeat, n_lines, len(ids), ends)


def statistics(documents: DataFrame) -> DataFrame:
    """One row of counts per row of ``documents`` (doc_id, text)."""

    def run(batches):
        for pdf in batches:
            rows = [text_stats(t) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=COUNTS + EXTRA, dtype="int64")
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS + EXTRA)
    return documents.select("doc_id", "text").mapInPandas(run, schema)


def with_features(stats: DataFrame) -> DataFrame:
    """Ratios for the forest; base_failed by the contract's two rules."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return stats.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / n).alias("mean_word"),
        (F.col("n_symbols") / n).alias("symbol_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        # distinct words fall with length in any text; the exponent evens that out
        (F.col("n_distinct") / F.pow(n, F.lit(0.9))).alias("distinct_share"),
        (F.col("n_ends") / n).alias("end_share"),
        F.log1p(n / lines).alias("words_per_line"),
    )


def grow_forest(rows: np.ndarray, trees: int, per_tree: int, seed: int) -> list[tuple]:
    """Isolation trees as arrays (feature, cut, left, right, path length at leaves)."""
    rng = np.random.default_rng(seed)
    forest = []
    if not len(rows):
        return forest
    for _ in range(trees):
        take = rng.choice(len(rows), min(per_tree, len(rows)), replace=False)
        limit = max(1, math.ceil(math.log2(max(2, len(take)))))
        nodes: list[list] = []

        def grow(index: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + expected_path(len(index))])
            if depth >= limit or len(index) <= 1:
                return at
            low, high = rows[index].min(0), rows[index].max(0)
            open_ = np.flatnonzero(high > low)
            if not len(open_):
                return at
            f = int(rng.choice(open_))
            split = float(rng.uniform(low[f], high[f]))
            side = rows[index, f] < split
            nodes[at][:2] = [f, split]
            nodes[at][2] = grow(index[side], depth + 1)
            nodes[at][3] = grow(index[~side], depth + 1)
            return at

        grow(take, 0)
        forest.append(tuple(np.array(c) for c in zip(*nodes)))
    return forest


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def path_scores(forest: list[tuple], x: np.ndarray, per_tree: int) -> np.ndarray:
    """Anomaly scores in (0, 1): 2 ** -(mean path / expected path)."""
    if not forest or not len(x):
        return np.zeros(len(x))
    total = np.zeros(len(x))
    for feature, split, left, right, path in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(f, 0)] < split[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        total += path[at]
    return 2.0 ** (-(total / len(forest)) / max(expected_path(per_tree), 1e-9))


def filter_quality(
    documents: DataFrame,
    labels: DataFrame | None = None,
    trees: int = 100,
    per_tree: int = 256,
    seed: int = 7,
    good_loss: float = 0.01,
    default_share: float = 0.05,
) -> DataFrame:
    """Statistics, base verdict, anomaly score and verdict for every row.

    Of the thresholds that lose at most the share ``good_loss`` of labelled good rows,
    the one that rejects most labelled bad rows is taken.
    """
    spark = documents.sparkSession
    stats = cut(with_features(statistics(documents)), "quality-stats")
    passing = stats.where(~F.col("base_failed")).select("doc_id", *FEATURES)
    sample = hash_sample(passing, trees * per_tree, seed, "doc_id", *FEATURES).toPandas()
    forest = grow_forest(sample[FEATURES].to_numpy(float), trees, per_tree, seed)
    held = spark.sparkContext.broadcast(forest)

    def score(batches):
        for pdf in batches:
            s = path_scores(held.value, pdf[FEATURES].to_numpy(float), per_tree)
            yield pdf[["doc_id", *COUNTS, "base_failed"]].assign(anomaly=np.round(s, 4))

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double"
    scored = cut(stats.select("doc_id", *COUNTS, "base_failed", *FEATURES).mapInPandas(score, schema), "quality-scores")
    threshold = calibrate(scored, labels, good_loss, default_share)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold)))


def calibrate(scored: DataFrame, labels: DataFrame | None, good_loss: float, default_share: float) -> float:
    """A threshold from counts per score step (at most 10,001 rows reach the driver)."""
    rows = scored.where(~F.col("base_failed"))
    steps = None
    if labels is not None:
        known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
        steps = (
            rows.join(known, "doc_id")
            .groupBy("anomaly")
            .agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.sum((F.col("quality") <= 0).cast("long")).alias("bad"))
            .toPandas()
            .sort_values("anomaly", ascending=False)
        )
    if steps is None or not len(steps) or steps["bad"].sum() == 0 or steps["good"].sum() == 0:
        share = rows.groupBy("anomaly").count().toPandas().sort_values("anomaly", ascending=False)
        if not len(share):
            return 2.0
        ok = share[share["count"].cumsum() <= default_share * share["count"].sum()]
        return float(ok["anomaly"].iloc[-1]) if len(ok) else 2.0
    good, bad = steps["good"].cumsum(), steps["bad"].cumsum()
    ok = steps[(good <= good_loss * steps["good"].sum()) & (bad > 0)]
    if not len(ok):
        return 2.0
    gained = bad[ok.index] / steps["bad"].sum() - good[ok.index] / steps["good"].sum()
    return float(steps.loc[gained.idxmax(), "anomaly"])


def op9_isolation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")


QUERIES = {"op9_isolation_quality": op9_isolation_quality}
