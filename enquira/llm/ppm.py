"""Language-model scores by prediction by partial matching (PPM).

A text is coded as its words, joined by single spaces and closed by one end symbol: a stream of
bytes.  Each byte is predicted in the context of the ``ORDER`` bytes before it, which reach
across words (``ORDER`` start marks stand before a text).  The trie of contexts is a table of
counts (order, context, symbol) over the bytes of all training texts.  A symbol that occurs ``c``
times in a context with ``n`` occurrences of ``d`` distinct symbols costs
``-log((c - 1/2) / n)``; any other one first pays for an escape, ``-log(d / 2 / n)`` (method D),
and is then coded in the next shorter context, without the symbols of the longer one (symbol
exclusion: they leave ``c``, ``n`` and ``d``).  An unknown context is passed over.  Below order 0
all bytes that are left are equally likely.  All probabilities of a context's 252 possible
symbols add up to 1, so ``score`` is the log10 probability of the token sequence.

How it runs.  One pass over the texts counts longest grams (context and symbol, six bytes, as
one long) and words, summed up in each task and then by key.  Spark derives the shorter orders from the
longest grams, and one cost per distinct gram.  A second pass adds up the costs of every text.
The most frequent grams and words, at most ``most_grams`` and ``most_words``, go to the tasks as
a hash table; all other grams and words of a text are joined with the tables of costs and
counts by key, so nothing is cut off and what is broadcast stays bounded.

The base score is the smoothed unigram of the contract; it is no probability (a word that no training
text holds is not spelled out), so on little data, where many words are new, it may be higher than
the score.

Words are lower-cased in A-Z only and split at the six ASCII space characters.

Defined cases: a null text is empty: it has the end as its only token; a null doc_id is
trained on and not held out; repeated rows are trained on and scored separately; a very long text is coded
in slices whose contexts overlap; equally frequent grams are broadcast together or not at all;
other columns of the table are not read, whatever their names;
without training rows every count is 0 and symbols are equally likely; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .hashing import CodeTable

ORDER = 5
SYMBOLS = 252  # bytes less four of the space characters, which separate words
START, SPACE, END = b"\r", b" ", b"\n"
FOLDS, HELD = 7, 2
SLICE = 1 << 20


def held_out() -> Column:
    """Rows that are not trained on."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def portions(batches, most: int = SLICE):
    """Batches in parts of about ``most`` characters, since a text's words take ten times its memory."""
    for pdf in batches:
        part = np.cumsum([len(t) if t else 0 for t in pdf["text"]]) // most
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(pdf) else []
        for s, e in zip(edges[:-1], edges[1:]):
            yield pdf.iloc[s:e]


def gram_codes(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The longest gram at every byte of some streams, and the stream it belongs to; a gram's
    lowest byte is the symbol, earlier bytes are above it."""
    data = np.frombuffer(b"".join(START * ORDER + s for s in streams), np.uint8).astype(np.int64)
    size = np.array([len(s) for s in streams], np.int64)
    own = np.repeat(np.arange(len(streams)), size)
    pos = np.arange(len(own)) + (own + 1) * ORDER
    code = np.zeros(len(data), np.int64)
    for k in range(ORDER + 1):
        code[k:] |= data[: len(data) - k] << (8 * k)
    return code[pos], own


def slices(streams: list[bytes]):
    """(first stream, codes, owners) of streams taken together up to ``SLICE`` bytes; a longer
    stream is cut into parts, each after the bytes before it."""
    at = 0
    while at < len(streams):
        if len(streams[at]) > SLICE:
            s = streams[at]
            for begin in range(0, len(s), SLICE):
                before = min(begin, ORDER)
                code, own = gram_codes([s[begin - before : begin + SLICE]])
                yield at, code[before:], own[before:]
            at += 1
            continue
        stop, size = at, 0
        while stop < len(streams) and size + len(streams[stop]) <= SLICE:
            size += len(streams[stop])
            stop += 1
        yield (at, *gram_codes(streams[at:stop]))
        at = stop


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate([p[0] for p in parts])
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[first], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], first)


def counts(documents: DataFrame, keep: int = 1_000_000) -> DataFrame:
    """(word, code, n): occurrences in training rows of every word (code is null) and of
    every longest gram (word is null); grams of held-out rows alone have n = 0.  A task adds
    up to ``keep`` different ones before it hands them on."""

    def run(batches):
        _TABLES.clear()  # of a run before
        words: Counter = Counter()
        grams: list[list] = [[], []]  # held out, trained on
        waiting = 0

        def out(all_: bool):
            nonlocal waiting
            if all_ or len(words) > keep // 8:
                yield pd.DataFrame({"word": list(words), "code": pd.array([None] * len(words), "Int64"), "n": list(words.values())})
                words.clear()
            for train in (0, 1):
                if grams[train]:
                    code, n = _summed(grams[train])
                    grams[train] = [(code, n)]
                    if all_ or len(code) > keep:
                        yield pd.DataFrame({"word": None, "code": code, "n": n * train})
                        grams[train] = []
            waiting = 0

        for pdf in portions(batches):
            for train in (0, 1):
                found = [tokens(t) for t in pdf.loc[pdf["train"] == bool(train), "text"]]
                if train:
                    for ws in found:
                        words.update(ws)
                for _, code, _ in slices([SPACE.join(ws) + END for ws in found]):
                    some, n = np.unique(code, return_counts=True)
                    grams[train].append((some, n))
                    waiting += len(some)
                    if waiting > 2 * keep:
                        yield from out(False)
        yield from out(True)

    rows = documents.select("text", (~held_out()).alias("train")).mapInPandas(run, "word binary, code long, n long")
    return rows.groupBy("word", "code").agg(F.sum("n").alias("n"))


def _low(code: Column, k: Column) -> Column:
    """The last k + 1 bytes of a gram."""
    return code.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (8 * (k + 1)).cast("int")) - 1)


def _context(low: Column) -> Column:
    return F.shiftright(low, 8)


def context_trie(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the longest grams (code, n > 0): symbols (k, low, c) of every order k and contexts
    (k, ctx, n, d, e), where e counts, one order below, the symbols that the context has."""
    rows = grams.where("n > 0").select("n", "code", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k"))
    symbols = cut(rows.groupBy("k", _low(F.col("code"), F.col("k")).alias("low")).agg(F.sum("n").alias("c")), "ppm-symbols")
    up = symbols.withColumn("ctx", _context(F.col("low")))
    contexts = up.groupBy("k", "ctx").agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    below = symbols.select((F.col("k") + 1).alias("k"), F.col("low").alias("short"), F.col("c").alias("below"))
    excluded = up.where("k > 0").withColumn("short", _low(F.col("low"), F.col("k") - 1)).join(below, ["k", "short"]).groupBy("k", "ctx").agg(F.sum("below").alias("e"))
    return symbols, cut(contexts.join(excluded, ["k", "ctx"], "left"), "ppm-contexts")


def gram_costs(grams: DataFrame) -> DataFrame:
    """(code, n, cost): log10 probability of every gram's symbol in its context."""
    symbols, contexts = context_trie(grams)
    longest = contexts.where(F.col("k") == ORDER)
    seen = grams.where("n > 0").withColumn("ctx", _context(F.col("code"))).withColumnRenamed("n", "own").join(longest, "ctx")
    seen = seen.select("code", F.col("own").alias("n"), F.log10((F.col("own") - 0.5) / F.col("n")).alias("cost"))

    walk = grams.where("n = 0").select("code", F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("k"))
    walk = walk.withColumn("low", _low(F.col("code"), F.col("k"))).withColumn("ctx", _context(F.col("low")))
    walk = walk.join(contexts, ["k", "ctx"]).join(symbols, ["k", "low"], "left")
    steps = F.sort_array(F.collect_list(F.struct("k", "c", "n", "d", F.coalesce("e", F.lit(0)).alias("e"))), asc=False)  # one per order
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("ex"), F.lit(0).cast("long").alias("dx"))

    def step(a, x):
        n, d = x["n"] - a["ex"], x["d"] - a["dx"]
        hit = a["cost"] + F.log10((x["c"] - 0.5) / n)
        escape = a["cost"] + F.when(d > 0, F.log10(0.5 * d / n)).otherwise(0.0)
        return (
            F.when(a["done"], a)
            .when(x["c"].isNotNull(), F.struct(hit.alias("cost"), F.lit(True).alias("done"), a["ex"].alias("ex"), a["dx"].alias("dx")))
            .otherwise(F.struct(escape.alias("cost"), F.lit(False).alias("done"), x["e"].alias("ex"), x["d"].alias("dx")))
        )

    ended = walk.groupBy("code").agg(F.aggregate(steps, start, step).alias("r"))
    unseen = grams.where("n = 0").select("code", "n").join(ended, "code", "left")  # without training rows there is no context
    last = F.col("r.cost") - F.log10(SYMBOLS - F.col("r.dx"))
    cost = F.when(F.col("r").isNull(), -math.log10(SYMBOLS)).when(F.col("r.done"), F.col("r.cost")).otherwise(last)
    return seen.unionByName(unseen.select("code", "n", cost.alias("cost")))


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows of n > 0 above the least count that leaves at most ``most``, from counts per step of log2(n)."""
    step = F.floor(F.log2("n") * 16).cast("int")
    taken, least = 0, 1 << 30
    for r in table.where("n > 0").groupBy(step.alias("step")).count().orderBy(F.col("step").desc()).collect():
        taken += r["count"]
        if taken > most:
            break
        least = r["step"]
    return table.where((F.col("n") > 0) & (step >= least))


_TABLES: dict = {}


def _tables(held) -> tuple[CodeTable, dict, np.ndarray]:
    """The broadcast tables, built once per worker."""
    key = held.value[0]
    if key not in _TABLES:
        _TABLES.clear()
        _, codes, costs, words, log_count = held.value
        _TABLES[key] = (CodeTable(codes, costs), {w: i for i, w in enumerate(words)}, log_count)
    return _TABLES[key]


def score_documents(documents: DataFrame, most_grams: int = 1_000_000, most_words: int = 100_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    spark = documents.sparkSession
    counted = cut(counts(documents), "ppm-counts")
    words = counted.where("word is not null").select("word", "n")
    costs = cut(gram_costs(counted.where("code is not null").select("code", "n")), "ppm-costs")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    ends = documents.where(~held_out()).count()
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    log_total = math.log10(n + v + 1)

    top_grams = most_frequent(costs, most_grams).select("code", "cost").toArrow()
    top_words = most_frequent(words, most_words).toArrow()
    held = spark.sparkContext.broadcast((
        uuid.uuid4().hex, top_grams["code"].to_numpy(), top_grams["cost"].to_numpy(),
        top_words["word"].to_pylist(), np.log10(top_words["n"].to_numpy() + 1.0),
    ))
    del top_grams, top_words

    def run(batches):
        table, index, log_count = _tables(held)
        for pdf in portions(batches):
            out = []
            found = [tokens(t) for t in pdf["text"]]
            for ws in found:
                at = np.fromiter((index.get(w, -1) for w in ws), np.int64, len(ws))
                hit = at[at >= 0]
                rare = Counter(ws[i] for i in np.flatnonzero(at < 0).tolist())
                out.append((len(ws), len(hit), log_count[hit].sum(), list(rare), list(rare.values())))
            streams = [SPACE.join(ws) + END for ws in found]
            score = np.zeros(len(streams))
            others: list[list] = [[] for _ in streams]
            for first, code, own in slices(streams):
                value, known = table.get(code)
                sums = np.bincount(own, weights=value)
                score[first : first + len(sums)] += sums
                lost = np.flatnonzero(~known)
                if len(lost):
                    edges = np.flatnonzero(np.r_[True, own[lost][1:] != own[lost][:-1], True])
                    for s, e in zip(edges[:-1], edges[1:]):
                        others[first + own[lost[s]]].append(code[lost[s:e]])
            codes = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.int64),) * 2 for x in others]
            cols = list(zip(*out)) if out else [[]] * 5
            parts = dict(zip(["words", "known", "log_count", "rare", "times"], cols))
            yield pd.DataFrame({
                "row": pdf["row"].array, "doc_id": pdf["doc_id"].array, "held": pdf["held"].array, **parts, "score": score, "n_bytes": [len(s) for s in streams],
                "codes": pd.Series([c for c, _ in codes], dtype=object), "code_times": pd.Series([t for _, t in codes], dtype=object),
            })

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", held_out().alias("held"))
    schema = f"row long, doc_id {kind}, held boolean, words long, known long, log_count double, rare array<binary>, times array<long>, score double, n_bytes long, codes array<long>, code_times array<long>"
    rows = cut(rows.mapInPandas(run, schema), "ppm-documents")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    rare = rare.join(words.where("n > 0"), "word").groupBy("row").agg(F.sum("times").alias("r_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("r_log"))
    other = rows.select("row", F.explode(F.arrays_zip("codes", "code_times")).alias("r")).select("row", F.col("r.codes").alias("code"), F.col("r.code_times").alias("times"))
    other = other.join(costs, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("r_cost"))
    zero = F.lit(0)
    joined = rows.drop("rare", "times", "codes", "code_times").join(rare, "row", "left").join(other, "row", "left")
    return joined.select(
        "doc_id", F.col("held").alias("held_out"), (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("r_known", zero) + F.lit(int(ends > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_count") + F.coalesce("r_log", zero) + math.log10(ends + 1) - (F.col("words") + 1) * log_total).alias("base_score"),
        (F.col("score") + F.coalesce("r_cost", zero)).alias("score"), "n_bytes",
    )


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_ppm": op2_ppm}
