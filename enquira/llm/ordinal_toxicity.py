"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

``P(grade >= k) = sigmoid(w . x - theta_k)`` with one weight vector and ordered thresholds
``theta_1 < theta_2 < ...``; the expected severity is the sum of these probabilities.
Features are the distinct words of a text (lower case, no punctuation) and their beginnings of 3 to 6
bytes, hashed to ``2 ** BITS`` places; none is left out.  A feature's value is ``g / (g + 20)``, where
``g`` is its likelihood ratio for toxic against clean fitting rows: features that chance explains
stay small, so that single words of the fitting rows are not learned by heart.

Grades come from the labels: the toxic label itself (0, 1, ...), and one more for a toxic row whose
quality label is 0, at most ``grades``.  The model has one threshold per grade that occurs; where
the labels know clean and toxic only, there are two grades and the severity is the probability of the
upper one.

The model is fitted on at most ``most_toxic`` toxic and ``most_clean`` clean labelled rows,
chosen by hash (the driver gets their features, 4 bytes each); every row of ``documents`` is scored,
over its whole text.

Defined cases: null and empty texts have no features and get the grade of their margin 0, which is
clean; a very long text is one bag of features; without both kinds of labels (or with an empty label table)
nothing is judged toxic; labels with a null doc_id or toxic value are not used, a null quality counts as
good; a doc_id with several labels takes the highest toxic and the lowest quality one; repeated rows
are scored alike; of equally probable grades above 0 the lower one is taken; other columns are kept, the
columns added replace those of the same names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hash_sample, plain_words
from .hashing import SpanHashes, mix

GRADES = 3
MOST_TOXIC = 3_000
MOST_CLEAN = 6_000
BITS = 18
BEGINNINGS = (3, 4, 5, 6)
AT_ONCE = 1 << 20


def text_features(text: str | None) -> np.ndarray:
    """Sorted places of a text's words and beginnings of words."""
    words = plain_words(text) if text else []
    found = []
    for s in range(0, len(words), 50_000):
        h = SpanHashes(words[s : s + 50_000])
        found.append(h.bytes_from(h.begins, h.ends))
        for n in BEGINNINGS:
            longer = h.begins[h.ends - h.begins > n]
            found.append(mix(h.bytes_from(longer, longer + n) + np.uint64(n)))
    return np.unique(np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32) if found else np.zeros(0, np.int32)


class Bags:
    """Sparse rows of present features."""

    def __init__(self, bags: list[np.ndarray]):
        self.cols = np.concatenate([*bags, np.zeros(0, np.int32)])
        self.ends = np.cumsum([0, *map(len, bags)])
        self.n = len(bags)
        # rows taken together, about AT_ONCE features each
        at = np.searchsorted(self.ends, np.arange(AT_ONCE, self.ends[-1], AT_ONCE))
        self.cuts = np.unique(np.r_[0, at, self.n])

    def _parts(self):
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            size = np.diff(self.ends[a : b + 1])
            yield a, b, self.cols[self.ends[a] : self.ends[b]], np.repeat(np.arange(b - a), size)

    def times(self, v: np.ndarray) -> np.ndarray:
        """Sums of v over each row's features."""
        out = np.zeros(self.n)
        for a, b, cols, rows in self._parts():
            out[a:b] = np.bincount(rows, weights=v[cols], minlength=b - a)
        return out

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Sums of x over each feature's rows."""
        out = np.zeros(1 << BITS)
        for a, b, cols, rows in self._parts():
            out += np.bincount(cols, weights=x[a:b][rows], minlength=len(out))
        return out


class OrdinalModel:
    """Weights of the features and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thetas: np.ndarray):
        self.weights, self.thetas = weights, thetas

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        """(rows, grades): P(grade >= k)."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thetas[None, :], -40, 40)))


def evidence(bags: Bags, toxic: np.ndarray) -> np.ndarray:
    """The likelihood ratio of every feature, for toxic against clean rows."""
    n1, n0 = float(toxic.sum()), float((~toxic).sum())
    c1, c0 = bags.turned(toxic.astype(float)), bags.turned((~toxic).astype(float))
    q = (c1 + c0) / (n1 + n0)

    def term(seen, expected):
        return np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    return np.maximum(term(c1, n1 * q) + term(n1 - c1, n1 * (1 - q)) + term(c0, n0 * q) + term(n0 - c0, n0 * (1 - q)), 0.0)


def fit_ordinal(bags: Bags, grade: np.ndarray, scale: np.ndarray, grades: int, l2: float = 0.1, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights (times the features' values) and thresholds by maximum penalised likelihood, in
    accelerated gradient steps (Adam).  Thresholds are kept ordered by writing them as a first
    value plus positive gaps."""
    n, n_words = len(grade), len(scale)
    theta = np.zeros(n_words + grades)
    w, first, gaps = slice(0, n_words), n_words, slice(n_words + 1, n_words + grades)
    share = np.clip(np.mean(grade >= 1), 1e-6, 1 - 1e-6)
    theta[first] = -np.log(share / (1 - share))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    at = np.arange(n)
    for step in range(1, steps + 1):
        margin = bags.times(theta[w] * scale)
        cuts = theta[first] + np.r_[0, np.cumsum(np.exp(theta[gaps]))]
        above = 1 / (1 + np.exp(-np.clip(margin[:, None] - cuts[None, :], -40, 40)))
        full = np.c_[np.ones(n), above, np.zeros(n)]
        p = np.maximum(full[at, grade] - full[at, grade + 1], 1e-12)
        slope = full * (1 - full)
        up, down = slope[at, grade] / p, slope[at, grade + 1] / p
        g = np.zeros_like(theta)
        g[w] = bags.turned((down - up) / n) * scale + l2 * theta[w] / n
        d_cut = np.array([(np.where(grade == k, up, 0) - np.where(grade == k - 1, down, 0)).sum() / n for k in range(1, grades + 1)])
        g[first] = d_cut.sum()
        g[gaps] = np.cumsum(d_cut[::-1])[::-1][1:] * np.exp(theta[gaps])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[w] * scale, theta[first] + np.r_[0, np.cumsum(np.exp(theta[gaps]))]


def fit_grades(bags: list[np.ndarray], grade: np.ndarray) -> OrdinalModel:
    """Fit on features present and grades; there are as many thresholds as the highest grade."""
    if not len(grade) or (grade > 0).all() or not (grade > 0).any():
        return OrdinalModel(np.zeros(1 << BITS), np.full(1, 40.0))
    order = sorted(range(len(bags)), key=lambda i: (grade[i], bags[i].tobytes()))  # the same sums in each run
    rows, grade = Bags([bags[i] for i in order]), grade[order]
    g = evidence(rows, grade > 0)
    return OrdinalModel(*fit_ordinal(rows, grade, g / (g + 20), int(grade.max())))


def fit_model(fitting: DataFrame) -> OrdinalModel:
    """Fit on a table (text, grade)."""

    def bags(batches):
        for pdf in batches:
            yield pd.DataFrame({"grade": pdf["grade"], "features": [text_features(t).tobytes() for t in pdf["text"]]})

    rows = fitting.mapInPandas(bags, "grade int, features binary").toArrow()
    return fit_grades([np.frombuffer(b, np.int32) for b in rows["features"].to_pylist()], rows["grade"].to_numpy().astype(np.int64))


def score_documents(documents: DataFrame, labels: DataFrame, grades: int = GRADES, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, cutoff: float = 0.25, seed: int = 5) -> DataFrame:
    """Rows of ``documents`` with severity (expected grade), p_toxic, is_toxic (p_toxic at
    least ``cutoff``) and grade (0 unless is_toxic, then the most probable one above 0); all
    other columns are kept.  Columns of these names in the input are replaced."""
    spark = documents.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    severe = F.least(F.col("toxic") + F.coalesce((F.col("quality") <= 0).cast("int"), F.lit(0)), F.lit(grades)).cast("int")
    known = known.select(F.col("doc_id").alias("k_doc"), F.when(F.col("toxic") > 0, severe).otherwise(0).alias("grade"))
    picked = hash_sample(known.where("grade > 0"), most_toxic, seed, "k_doc").unionByName(hash_sample(known.where("grade = 0"), most_clean, seed, "k_doc"))
    # at most most_toxic + most_clean rows of two numbers
    fitting = documents.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("k_doc"))
    fitting = cut(fitting.select("text", "grade"), "toxicity-fit")
    model = spark.sparkContext.broadcast(fit_model(fitting))

    names = ["severity", "grade", "p_toxic", "is_toxic"]
    kept = [c for c in documents.columns if c not in names]

    def score(texts):
        m = model.value
        p = m.at_least(np.array([m.weights[text_features(t)].sum() for t in texts], dtype=float))
        whole = np.c_[np.ones(len(p)), p, np.zeros(len(p))]
        toxic = p[:, 0] >= cutoff
        grade = np.where(toxic, 1 + np.argmax((whole[:, :-1] - whole[:, 1:])[:, 1:], axis=1), 0).astype(np.int64)
        return pd.DataFrame({"severity": p.sum(1), "grade": grade, "p_toxic": p[:, 0].copy(), "is_toxic": toxic})

    # only the text goes to Python; the other columns stay where they are
    judge = F.pandas_udf(score, "severity double, grade long, p_toxic double, is_toxic boolean", F.PandasUDFType.SCALAR)
    judged = documents.select(F.struct(*kept).alias("d"), judge("text").alias("judged"))
    return judged.select("d.*", "judged.*")


def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


QUERIES = {"op7_ordinal_toxicity": op7_ordinal_toxicity}
