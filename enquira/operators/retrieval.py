"""Search over an inverted index and over vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from enquira.functions.text import tokenize


def terms(tokens: Column) -> Column:
    """Tokens and pairs of neighbouring tokens."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, F.filter(pairs, lambda p: p.contains(" ")))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(key, tokenize(F.col(text)).alias("_t")).select(key, F.explode(terms(F.col("_t"))).alias("term"))
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf_index(docs: DataFrame, key: str = "idx", text: str = "document") -> tuple[DataFrame, DataFrame]:
    """Postings (key, term, w) with vectors of length 1, and (term, idf)."""
    counts = term_counts(docs, key, text)
    n = docs.agg(F.count("*").alias("n_docs"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n), F.lit(True))  # one row
    idf = df.select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / length).alias("w")), idf


def top_k(scored: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def query_vectors(queries: DataFrame, idf: DataFrame, qkey: str = "query_id", qtext: str = "query") -> DataFrame:
    """(query, term, qw): vectors of length 1 over the terms that the index knows."""
    q = term_counts(queries, qkey, qtext).join(idf, "term").select(qkey, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    return q.select(qkey, "term", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(qkey)))).alias("qw"))


def term_impacts(postings: DataFrame) -> DataFrame:
    """(term, df, max_w): in how many documents a term stands and its largest weight in one."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("max_w"))


def skipping_scores(q: DataFrame, postings: DataFrame, impacts: DataFrame, n_docs: int, k: int, common: float, qkey: str, key: str) -> DataFrame:
    """(query, document, s) of all documents that can be among a query's k best, without reading the postings of common terms
    for queries that they cannot decide.

    The other terms give partial sums, whose k-th best no result falls below.  All common terms of a query add at most their
    largest weights.  Where that alone stays below the k-th best, a document without another term is out, and only the documents
    that can still reach it have their common terms looked up, by term and document.  Other queries read those postings in full.
    """
    q = q.join(impacts, "term").withColumn("often", F.col("df") > F.lit(common * n_docs))
    rare, often = q.where("not often"), q.where("often")
    partial = rare.select(qkey, "term", "qw").join(postings, "term").groupBy(qkey, key).agg(F.sum(F.col("qw") * F.col("w")).alias("s"))
    by_score = Window.partitionBy(qkey).orderBy(F.col("s").desc(), key)
    kth = partial.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") == k).select(qkey, F.col("s").alias("kth"))
    limits = q.groupBy(qkey).agg(F.sum(F.when(F.col("often"), F.col("qw") * F.col("max_w")).otherwise(0.0)).alias("rest"))
    limits = limits.join(kth, qkey, "left").select(qkey, "rest", "kth", (F.col("rest") + SLACK < F.coalesce("kth", F.lit(0.0))).alias("safe"))
    limits = limits.withColumn("safe", F.col("safe") | (F.col("rest") == 0))
    reach = partial.join(limits, qkey).where(~F.col("safe") | (F.col("s") + F.col("rest") + SLACK >= F.coalesce("kth", F.lit(0.0))))
    more = often.select(qkey, "term", "qw").join(limits.select(qkey, "safe"), qkey)
    looked = reach.where("safe").select(qkey, key).join(more.where("safe").drop("safe"), qkey).join(postings, ["term", key])
    in_full = more.where("not safe").drop("safe").join(postings, "term")
    added = looked.select(qkey, key, (F.col("qw") * F.col("w")).alias("s")).unionByName(in_full.select(qkey, key, (F.col("qw") * F.col("w")).alias("s")))
    return reach.select(qkey, key, "s").unionByName(added).groupBy(qkey, key).agg(F.sum("s").alias("s"))


#: Above the rounding of sums.
SLACK = 1e-8


def zero_hits(found: DataFrame, queries: DataFrame, keys: DataFrame, k: int, qkey: str, qtext: str, key: str) -> DataFrame:
    """``found`` with documents of cosine 0, in their order, for queries with a text and fewer than k hits."""
    first = keys.select(key).distinct().orderBy(key).limit(2 * k)  # k of these are no hits of a query that has fewer than k
    asked = queries.where(F.trim(F.coalesce(qtext, F.lit(""))) != "").select(qkey)
    short = asked.join(found.groupBy(qkey).agg(F.count("*").alias("_have")), qkey, "left").withColumn("_have", F.coalesce("_have", F.lit(0))).where(F.col("_have") < k)
    fill = short.join(F.broadcast(first), F.lit(True)).join(found.select(qkey, key), [qkey, key], "left_anti")  # 2k rows
    fill = fill.withColumn("rank", (F.row_number().over(Window.partitionBy(qkey).orderBy(key)) + F.col("_have")).cast("int")).where(F.col("rank") <= k)
    return found.unionByName(fill.select(qkey, key, F.lit(0.0).alias("cosine"), "rank"))


def tfidf_search(
    queries: DataFrame, postings: DataFrame, idf: DataFrame, k: int = 5, qkey: str = "query_id", qtext: str = "query", key: str = "idx", common: float | None = None, pad_zero: bool = False
) -> DataFrame:
    """Hits (query, document, cosine, rank) of the k best documents with a positive cosine.

    The join is on the term, so its work follows the postings of the queries' terms.  With ``common``, terms that stand in
    more than this share of the documents are read only where they can change the k best (the same hits, see ``skipping_scores``).
    Cosines are compared at 9 digits; ties go to the earlier document.  ``pad_zero`` fills up with documents of cosine 0.
    """
    q = query_vectors(queries, idf, qkey, qtext)
    if common is None:
        sums = q.join(postings, "term").groupBy(qkey, key).agg(F.sum(F.col("qw") * F.col("w")).alias("s"))
    else:
        sums = skipping_scores(q, postings, term_impacts(postings), postings.select(key).distinct().count(), k, common, qkey, key)
    found = top_k(sums.select(qkey, key, F.round(F.least("s", F.lit(1.0)), 9).alias("cosine")), qkey, "cosine", key, k)
    return zero_hits(found, queries, postings, k, qkey, qtext, key) if pad_zero else found


def keyword_bonus(hits: DataFrame, queries: DataFrame, faq: DataFrame, bonus: float = 0.10) -> DataFrame:
    """score = min(1, cosine + bonus per keyword found in the query); ranks stay."""
    joined = hits.join(queries.select("query_id", F.lower("query").alias("_q")), "query_id").join(faq.select("idx", "keywords"), "idx")
    found = F.size(F.filter("keywords", lambda k: F.col("_q").contains(F.lower(k))))
    return joined.select("query_id", "idx", "rank", "cosine", F.round(F.least(F.col("cosine") + bonus * found, F.lit(1.0)), 4).alias("score"))


#: Characters of a keyword that are looked up before the keyword itself is.
GRAM = 4


def keyword_hits(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, idx), a row per keyword of (idx, kw) that a query text of (query_id, _q) contains, in any case.

    A keyword meets the queries that hold its first characters, by a join; only these are searched for all of it.  Equal keywords
    are looked up once."""
    kw = keywords.where("kw <> ''").select("idx", F.lower("kw").alias("_k"))
    distinct = kw.select("_k").distinct().select("_k", F.substring("_k", 1, GRAM).alias("_g"))

    def cut(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.char_length("_q")), lambda i: F.substr(F.col("_q"), i, F.lit(n)))

    grams = F.filter(F.array_distinct(F.concat(*map(cut, range(1, GRAM + 1)))), lambda g: g != "")
    held = queries.where("_q <> ''").select("query_id", "_q", F.explode(grams).alias("_g"))
    return held.join(distinct, "_g").where(F.col("_q").contains(F.col("_k"))).select("query_id", "_k").join(kw, "_k").select("query_id", "idx")


def overlap_search(queries: DataFrame, faq: DataFrame, k: int = 5) -> DataFrame:
    """Shared tokens per query token, plus 0.5 per keyword found in the query."""
    q = queries.select("query_id", F.lower("query").alias("_q"), F.array_distinct(tokenize(F.col("query"))).alias("qt"))
    d = faq.select("idx", "keywords", F.array_distinct(tokenize(F.col("document"))).alias("dt"))
    shared = (
        q.select("query_id", F.explode("qt").alias("t"))
        .join(d.select("idx", F.explode("dt").alias("t")), "t")
        .groupBy("query_id", "idx")
        .agg(F.count("*").alias("shared"))
    )
    boosts = keyword_hits(q.select("query_id", "_q"), d.select("idx", F.explode("keywords").alias("kw"))).groupBy("query_id", "idx").agg(F.count("*").alias("boosts"))
    both = shared.join(boosts, ["query_id", "idx"], "full_outer").join(q.select("query_id", F.size("qt").alias("n")), "query_id")
    score = F.coalesce("shared", F.lit(0)) / F.greatest("n", F.lit(1)) + 0.5 * F.coalesce("boosts", F.lit(0))
    return top_k(both.select("query_id", "idx", F.round(score, 4).alias("score")), "query_id", "score", "idx", k)


def unit(v: Column) -> Column:
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.nullif(length, F.lit(0.0)))


def dot_score(a: str, b: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return F.round(F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0)), 4)


#: Random directions, and in how many buckets a vector lies and a query looks.
DIRECTIONS, BUCKETS, PROBES = 2048, 36, 36


def direction_buckets(directions: int, most: int, seed: int = 0):
    """A column function: the ``most`` random directions that a vector points along best, each a bucket."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def buckets(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        filled = [i for i, v in enumerate(vectors) if v is not None and len(v) and np.isfinite(np.asarray(v, float)).all()]
        sizes = {len(vectors.iloc[i]) for i in filled}
        for size in sizes:
            rows = [i for i in filled if len(vectors.iloc[i]) == size]
            planes = np.random.default_rng([seed, size]).standard_normal((size, directions)).astype(np.float32)
            planes /= np.linalg.norm(planes, axis=0)
            for at in range(0, len(rows), 1024):
                part = rows[at : at + 1024]
                along = np.stack([np.asarray(vectors.iloc[i], np.float32) for i in part]) @ planes
                best = np.argpartition(-along, min(most, directions) - 1, axis=1)[:, :most]
                for i, x in zip(part, best.astype(np.int32)):
                    out[i] = x
        return pd.Series(out)

    return buckets


def vector_candidates(queries: DataFrame, docs: DataFrame, directions: int = DIRECTIONS, buckets: int = BUCKETS, probes: int = PROBES) -> DataFrame:
    """Distinct pairs (query_id, idx) that share a bucket, of (query_id, qv) and (idx, dv)."""
    placed = docs.select("idx", F.explode(direction_buckets(directions, buckets)("dv")).alias("bucket"))
    looked = queries.select("query_id", F.explode(direction_buckets(directions, probes)("qv")).alias("bucket"))
    return looked.join(placed, "bucket").where("query_id <> idx").select("query_id", "idx").distinct()


#: Documents and queries of a cell of the exact search, queries scored at once, and what rounding to 4 digits may hide.
CHUNK, QUERY_BLOCK, AT_ONCE, MARGIN = 20_000, 4_000, 256, 1.1e-4


def _filled(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, with zeros after their end, and their lengths; those that are null or have no direction are zeros."""
    out, sizes = np.zeros((len(vectors), width)), np.zeros(len(vectors), np.int64)
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            sizes[i] = len(v)
            row = np.array([np.nan if x is None else x for x in v], float) if v.dtype == object else v
            out[i, : len(v)] = row
    return out, sizes


def _best_pairs(k: int):
    """A function of the queries (query_id, qv) and documents (idx, dv) of a cell: (query_id, idx, score), the k best documents of each query.

    Products of blocks in single precision find what can be among them; these are added up again as ``dot_score`` adds, in double precision."""

    def best(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        out = []
        width = max((len(v) for s in (queries["qv"], docs["dv"]) for v in s if v is not None), default=0)
        docs = docs.sort_values("idx")
        (q, q_size), (d, d_size) = _filled(queries["qv"], width), _filled(docs["dv"], width)
        asked, ids = queries["query_id"].to_numpy(), docs["idx"].to_numpy()
        # a product with a null is null, which counts as 0; vectors without a direction have only nulls
        q_none, d_none = np.isnan(q).any(1), np.isnan(d).any(1)
        q32, d32 = np.nan_to_num(q).astype(np.float32), np.nan_to_num(d).astype(np.float32).T.copy()
        one_size = len(set(q_size) | set(d_size)) <= 1
        for at in range(0, len(asked) if len(ids) else 0, AT_ONCE):
            near = np.clip(q32[at : at + AT_ONCE] @ d32, 0.0, 1.0)
            if not one_size:
                near[q_size[at : at + AT_ONCE, None] != d_size[None, :]] = 0.0
            if d_none.any() or q_none.any():
                near[:, d_none], near[q_none[at : at + AT_ONCE]] = 0.0, 0.0
            most = min(k + 1, near.shape[1])  # the query itself may be one of them
            least = np.partition(near, near.shape[1] - most, axis=1)[:, near.shape[1] - most]
            for i in range(len(near)):
                some = np.flatnonzero(near[i] >= least[i] - MARGIN)
                some = some[ids[some] != asked[at + i]]
                total = np.zeros(len(some))
                for c in range(width):
                    total += d[some, c] * q[at + i, c]
                total[(d_size[some] != q_size[at + i]) | np.isnan(total)] = 0.0
                total = np.clip(total, 0.0, 1.0)
                keep = np.unique(np.concatenate([np.argsort(-np.round(total + e, 4), kind="stable")[:k] for e in (-1e-12, 1e-12)])) if len(some) else some
                out.append(pd.DataFrame({"query_id": asked[at + i], "idx": ids[some[keep]], "score": total[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": asked[:0], "idx": ids[:0], "score": np.zeros(0)})

    return best


def _cells_of(queries: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a ``cell``: every query meets every document in one cell, of bounded size."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks, blocks = max(parts, -(-docs.count() // CHUNK)), max(1, -(-queries.count() // QUERY_BLOCK))

    def number(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n))

    q = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_o")).select("query_id", "qv", (number("query_id", blocks) * chunks + F.col("_o")).alias("cell"))
    d = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o")).select("idx", "dv", (F.col("_o") * chunks + number("idx", chunks)).alias("cell"))
    return q, d


def vector_search(queries: DataFrame, docs: DataFrame, k: int = 5, mode: str = "exact", directions: int = DIRECTIONS, buckets: int = BUCKETS, probes: int = PROBES) -> DataFrame:
    """The k documents with the largest dot product of unit vectors, clipped to [0, 1]; ties go to the smaller id.

    ``mode="exact"``: the queries are a stated set against all rows.  Blocks of queries meet chunks of rows in cells of bounded size,
    and each cell gives k hits a query; the products are queries x rows by nature.

    ``mode="candidates"``, for many queries against many rows: every vector lies in the buckets of the ``buckets`` random directions
    that it points along best, a query looks into its ``probes`` best ones, and what they share is scored exactly, bucket by bucket: no
    pair leaves its bucket but the k best of a query there.  The work is about queries x rows x buckets x probes / directions: more
    directions suit more rows.  Of equal vectors only the k + 1 with the smallest ids can be among the k best, so no more of them enter
    a bucket.  Vectors without a length are in no bucket.
    """
    q = queries.select(F.col("vec_id").alias("query_id"), unit(F.col("embedding")).alias("qv"))
    d = docs.select(F.col("vec_id").alias("idx"), unit(F.col("embedding")).alias("dv"))
    if mode == "candidates":
        nth = F.row_number().over(Window.partitionBy("dv").orderBy("idx"))
        d = d.withColumn("_nth", nth).where(F.col("_nth") <= k + 1).drop("_nth")
        q = q.select("*", F.explode(direction_buckets(directions, probes)("qv")).alias("cell"))
        d = d.select("*", F.explode(direction_buckets(directions, buckets)("dv")).alias("cell"))
    else:
        q, d = _cells_of(q, d)
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, idx {d.schema['idx'].dataType.simpleString()}, score double"
    best = _best_pairs(k)
    found = q.groupBy("cell").cogroup(d.groupBy("cell")).applyInPandas(lambda a, b: best(a, b), schema)
    scored = found.groupBy("query_id", "idx").agg(F.round(F.max("score"), 4).alias("score"))
    return top_k(scored, "query_id", "score", "idx", k)


def top1_confidence(queries: DataFrame, hits: DataFrame, score: str = "score") -> DataFrame:
    best = hits.groupBy("query_id").agg(F.max(score).alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("confidence"))


def document_hashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.sha2(F.col(text), 256).alias("sha"))


def corpus_fingerprint(docs: DataFrame, model: str, key: str, text: str, levels: tuple = (6, 4, 2)) -> DataFrame:
    """16 hex digits that change with any document, key or model: row hashes are combined by their first digits, then
    by fewer of them, so no group holds more than 256 parts above the first level and none a share of the corpus."""
    rows = document_hashes(docs, key, text).select(F.sha2(F.concat_ws(":", F.col(key).cast("string"), "sha"), 256).alias("h")).select("h", F.col("h").alias("p"))
    for digits in levels:
        parts = F.array_sort(F.collect_list(F.struct("p", "h")))
        rows = rows.groupBy(F.substring("p", 1, digits).alias("p")).agg(F.sha2(F.concat_ws("", F.transform(parts, lambda x: x["h"])), 256).alias("h"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("p", "h"))).alias("all"))
    return one.select(F.substring(F.sha2(F.concat_ws("|", F.lit(model), F.concat_ws("", F.transform("all", lambda x: x["h"]))), 256), 1, 16).alias("fingerprint"))


def stale_documents(docs: DataFrame, cache: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of documents whose text is not in the cache (key, sha)."""
    return document_hashes(docs, key, text).join(cache, [key, "sha"], "left_anti")
