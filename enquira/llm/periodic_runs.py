"""Periodic runs of words: stretches that repeat one passage at least three times in a row.

A run is a stretch of consecutive words with smallest period q, at least ``min_words`` and
``MIN_REPEATS`` * q words long, that no neighbouring word extends.  All runs of a text are found from
longest common extensions (LCE): the words around i and i + q agree over ``back`` words before
and ``ahead`` words from there on, so the run is known from one pair of positions inside it.

LCEs come from a difference cover: only the suffixes at sampled positions (residues of a cover
modulo ``V``) are sorted, by blocks of ``V`` words and then by doubling; two positions reach
sampled ones after fewer than ``V`` words, which are compared, and the rest is a range minimum over
the neighbours' common prefixes in a sparse table.  It is built only for texts where some pair
agrees that far.  Pairs are taken from a harmonic grid: for period q every
max(min_words - q, (MIN_REPEATS - 1) * q)-th position, O(n log n) in all, since every run of
that period covers such a point.

Every text is worked on by itself in the task that reads it: no shuffle, memory a small multiple
of the longest text.

Defined cases: a null, empty or blank text has no words, no run and an empty collapsed text; texts of
any length are searched whole, with the grid dealt in blocks of ``GRID`` points; rows that
repeat a doc_id, and equal texts, are each searched for themselves; a null doc_id is kept; an empty
table gives an empty result; of runs that cover the same words the smallest period counts; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_WORDS = 24
MIN_REPEATS = 3
#: Modulus and step of the difference cover {0 .. STEP-1} and {STEP, 2 STEP, ...}: every residue is STEP * k - j.
V, STEP = 64, 8
GRID = 1 << 20
#: Pairs compared at once, V words each.
AT_ONCE = 1 << 13

COVER = np.unique(np.r_[np.arange(STEP), np.arange(0, V, STEP)])
_SAMPLED = np.isin(np.arange(2 * V) % V, COVER)
#: For residues r and s the fewest words after which both are sampled.
DELTA = np.array([[next(d for d in range(V) if _SAMPLED[r + d] and _SAMPLED[s + d]) for s in range(V)] for r in range(V)])


class Extensions:
    """Longest common extensions of positions of one sequence of numbers from 1 on."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.concatenate([words, np.zeros(2 * V, words.dtype)])  # the end differs from all words
        self.table: list[np.ndarray] = []

    def block(self, at: np.ndarray) -> np.ndarray:
        return self.words[at[:, None] + np.arange(V)]

    def sort(self) -> None:
        """Ranks of the sampled suffixes and the table of their neighbours' common prefixes."""
        n = self.n
        at = np.flatnonzero(_SAMPLED[np.arange(n) % V])
        place = np.zeros(n, np.int64)
        place[at] = np.arange(len(at))
        rows = np.ascontiguousarray(self.block(at).astype(">u4")).view(np.dtype((np.void, 4 * V))).ravel()
        rank = np.unique(rows, return_inverse=True)[1].astype(np.int64) + 1
        levels, k = [(V, rank)], V
        while rank.max() < len(at):
            later = at + k
            following = np.where(later < n, rank[place[np.minimum(later, n - 1)]], 0)
            rank = np.unique(rank * (len(at) + 1) + following, return_inverse=True)[1].astype(np.int64) + 1
            k *= 2
            levels.append((k, rank))
        order = np.argsort(rank, kind="stable")
        left, right = at[order[:-1]].copy(), at[order[1:]].copy()
        common = np.zeros(len(left), np.int64)
        for k, rank in reversed(levels):
            both = np.flatnonzero((left < n) & (right < n))
            same = both[rank[place[left[both]]] == rank[place[right[both]]]]
            for x in (left, right, common):
                x[same] += k
        for a in range(0, len(left), AT_ONCE):
            x, y = np.minimum(left[a : a + AT_ONCE], n), np.minimum(right[a : a + AT_ONCE], n)
            common[a : a + AT_ONCE] += np.logical_and.accumulate(self.block(x) == self.block(y), axis=1).sum(1)
        self.rank = np.zeros(n, np.int64)
        self.rank[at] = rank_of = np.empty(len(at), np.int64)
        rank_of[order] = np.arange(len(at))
        self.rank[at] = rank_of
        self.table = [common]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and from j on, i < j."""
        return np.concatenate([self._lce(i[a : a + AT_ONCE], j[a : a + AT_ONCE]) for a in range(0, len(i), AT_ONCE)]) if len(i) else np.zeros(0, np.int64)

    def _lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        delta = DELTA[i % V, j % V]
        out = np.minimum(np.logical_and.accumulate(self.block(i) == self.block(j), axis=1).sum(1), delta)
        on = np.flatnonzero((out == delta) & (j + delta < self.n))
        if len(on):
            if not self.table:
                self.sort()
            x, y = self.rank[i[on] + delta[on]], self.rank[j[on] + delta[on]]
            x, y = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((y - x).astype(np.float64))[1] - 1
            for k in np.unique(level):
                w = np.flatnonzero(level == k)
                out[on[w]] += np.minimum(self.table[k][x[w]], self.table[k][y[w] - (1 << int(k))])
        return np.minimum(out, self.n - j)


def grid(n: int, min_words: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid positions and their periods, for the periods from ``first`` to before ``last``."""
    q = np.arange(first, last)
    step = np.maximum(min_words - q, (MIN_REPEATS - 1) * q)
    count = -(-(n - q) // step)
    ends = np.cumsum(count)
    nth = np.arange(ends[-1]) - np.repeat(ends - count, count)
    return nth * np.repeat(step, count), np.repeat(q, count)


def find_runs(words: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of numbers from 1 on, by start and period."""
    n = len(words)
    none = np.zeros((0, 3), np.int64)
    if n < min_words:
        return none
    ahead = Extensions(words)
    back = Extensions(words[::-1])
    found, first = [], 1
    most = n // MIN_REPEATS
    while first <= most:
        last = first + 1
        points = n // max(min_words - first, 2 * first) + 1
        while last <= most and points < GRID:
            points += n // max(min_words - last, 2 * last) + 1
            last += 1
        if not found and first == 1 and n < 50_000:  # one block; the loop above is for long texts
            last = most + 1
        i, q = grid(n, min_words, first, last)
        first = last
        j = i + q
        keep = np.flatnonzero(words[i] == words[j])
        i, j, q = i[keep], j[keep], q[keep]
        # A run's agreement is longer than a word, so the word before or the word after agrees too.
        keep = np.flatnonzero((ahead.words[i + 1] == ahead.words[j + 1]) | (ahead.words[i - 1] == ahead.words[j - 1]))
        i, j, q = i[keep], j[keep], q[keep]
        if not len(i):
            continue
        after = ahead.lce(i, j)
        before = back.lce(n - j, n - i)
        length = after + before + q
        keep = length >= np.maximum(min_words, MIN_REPEATS * q)
        found.append(np.stack([(i - before)[keep], length[keep], q[keep]], axis=1))
    runs = np.concatenate(found) if found else none
    if not len(runs):
        return none
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)]  # the smallest period of each stretch
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers from 1 on."""
    ids = dict.fromkeys(words)
    ids = dict(zip(ids, range(1, len(ids) + 1)))
    return np.fromiter(map(ids.__getitem__, words), np.int32, len(words))


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by spaces, without the repeats of runs: their first period stays."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every (doc_id, text); ``runs`` has (start, length, period) in words."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def search(batches):
        for pdf in batches:
            out, size = [], 0
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                words = text.encode("utf-8", "replace").split() if text else []  # bytes split at the six ASCII space characters only
                runs = find_runs(numbered(words), min_words)
                collapsed = collapse(words, runs).decode()
                size += len(collapsed)
                out.append((doc, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], collapsed))
                if size > 1 << 23:
                    yield frame(out)
                    out, size = [], 0
            if out:
                yield frame(out)

    def frame(rows):
        doc, n, runs, collapsed = zip(*rows)
        return pd.DataFrame({"doc_id": pd.Series([None if pd.isna(d) else d for d in doc], dtype="object"), "n_words": n, "runs": list(runs), "collapsed": collapsed})

    return documents.select("doc_id", "text").mapInPandas(search, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


# ---- the registered query ---------------------------------------------------------------------


def planted_text() -> Column:
    """The text, or, for doc_ids whose crc32 ends in 0, its words with a repeated passage from word a on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    passage = F.array_repeat(F.slice(words, a + 1, p), (3 + g % 8).cast("int"))
    planted = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(passage), F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(planted, " ")).otherwise(F.col("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted_text().alias("text"))

    def larger(x: Column, y: Column) -> Column:
        order = [(y["length"] * x["period"], x["length"] * y["period"]), (x["start"], y["start"]), (x["period"], y["period"])]
        out = F.lit(0)
        for a, b in reversed(order):
            out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
        return out

    best = F.get(F.array_sort("runs", larger), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = periodic_runs(documents).select("doc_id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
