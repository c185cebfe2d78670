"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from enquira.functions.text import STOPWORDS, tokenize
from enquira.operators import retrieval as R

from .adapters import table, view
from .entries import query

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _toks(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: t NOT IN ({_STOP}))"


def _grams(src: str, key: str, text: str) -> str:
    """SQL: (key, term, tf) of tokens and neighbouring pairs."""
    return f"""SELECT {key}, term, count(*) AS tf FROM (
      SELECT {key}, unnest(t || [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) AS term FROM (SELECT {key}, {_toks(text)} AS t FROM {src})) GROUP BY {key}, term"""


_FAQ = "(SELECT *, concat_ws(' ', question, answer, kw1, kw2) AS document FROM a_corpus)"
_IDF = f"SELECT term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM ({_grams(_FAQ, 'idx', 'document')}) GROUP BY term) CROSS JOIN (SELECT count(*) AS n FROM a_corpus)"
_POST = f"SELECT idx, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY idx)) AS w FROM (SELECT idx, c.term, tf * idf AS raw FROM ({_grams(_FAQ, 'idx', 'document')}) c JOIN ({_IDF}) i ON c.term = i.term)"
_QV = f"SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS qw FROM (SELECT query_id, c.term, tf * idf AS raw FROM ({_grams('a_gold', 'query_id', 'query')}) c JOIN ({_IDF}) i ON c.term = i.term)"
HITS = f"""SELECT query_id, idx, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, idx) AS rank FROM (
  SELECT query_id, idx, round(least(sum(qw * w), 1), 9) AS cosine FROM ({_QV}) q JOIN ({_POST}) p ON q.term = p.term GROUP BY query_id, idx)) WHERE rank <= 5"""
SCORED = f"""SELECT h.query_id, h.idx, h.rank, h.cosine, round(least(h.cosine + CAST(0.1 AS DOUBLE) * ((CASE WHEN contains(lower(g.query), lower(c.kw1)) THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(g.query), lower(c.kw2)) THEN 1 ELSE 0 END)), 1), 4) AS score
  FROM ({HITS}) h JOIN a_gold g ON h.query_id = g.query_id JOIN a_corpus c ON h.idx = c.idx"""
BOTH = ("a_corpus", "a_gold")


def faq(spark, d):
    rows = view(spark, d, "a_corpus")
    return rows.select("*", F.array("kw1", "kw2").alias("keywords"), F.concat_ws(" ", "question", "answer", "kw1", "kw2").alias("document"))


def gold(spark, d):
    return view(spark, d, "a_gold")


def hits(spark, d):
    postings, idf = R.tfidf_index(faq(spark, d))
    return R.tfidf_search(gold(spark, d), postings, idf)


def scored_hits(spark, d):
    return R.keyword_bonus(hits(spark, d), gold(spark, d), faq(spark, d))


@query("tokenize", f"SELECT doc_id, array_to_string({_toks('text')}, ' ') AS tokens FROM documents")
def q_tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tokenize(F.col("text")), " ").alias("tokens"))


@query("tfidf_index", f"SELECT idx, term, round(w, 6) AS w FROM ({_POST})", ("a_corpus",))
def tfidf_index(spark, d):
    return R.tfidf_index(faq(spark, d))[0].select("idx", "term", F.round("w", 6).alias("w"))


@query("tfidf_search", f"SELECT query_id, idx, round(cosine, 4) AS score, rank FROM ({HITS})", BOTH)
def tfidf_search(spark, d):
    return hits(spark, d).select("query_id", "idx", F.round("cosine", 4).alias("score"), "rank")


@query("tfidf_search_skipping", f"SELECT query_id, idx, round(cosine, 4) AS score, rank FROM ({HITS})", BOTH)
def tfidf_search_skipping(spark, d):
    """The same hits with terms of more than a tenth of the documents read only where they matter."""
    postings, idf = R.tfidf_index(faq(spark, d))
    return R.tfidf_search(gold(spark, d), postings, idf, common=0.1).select("query_id", "idx", F.round("cosine", 4).alias("score"), "rank")


_PADDED = f"""SELECT query_id, idx, round(cosine, 4) AS score, rank FROM (SELECT g.query_id, c.idx, coalesce(s.cosine, 0) AS cosine, row_number() OVER (PARTITION BY g.query_id ORDER BY coalesce(s.cosine, 0) DESC, c.idx) AS rank
  FROM a_gold g CROSS JOIN a_corpus c LEFT JOIN (SELECT query_id, idx, round(least(sum(qw * w), 1), 9) AS cosine FROM ({_QV}) q JOIN ({_POST}) p ON q.term = p.term GROUP BY query_id, idx) s ON g.query_id = s.query_id AND c.idx = s.idx WHERE trim(g.query) <> '') WHERE rank <= 25"""


@query("tfidf_search_padded", _PADDED, BOTH)
def tfidf_search_padded(spark, d):
    """The 25 best documents of every query, filled up with documents of cosine 0."""
    postings, idf = R.tfidf_index(faq(spark, d))
    return R.tfidf_search(gold(spark, d), postings, idf, k=25, pad_zero=True).select("query_id", "idx", F.round("cosine", 4).alias("score"), "rank")


@query("keyword_bonus", f"SELECT query_id, idx, rank, score FROM ({SCORED})", BOTH)
def keyword_bonus(spark, d):
    return scored_hits(spark, d).drop("cosine")


_QT = f"(SELECT query_id, lower(query) AS q, list_distinct({_toks('query')}) AS qt FROM a_gold)"
_DT = f"(SELECT idx, kw1, kw2, list_distinct({_toks('document')}) AS dt FROM {_FAQ})"
_OVER = f"""SELECT query_id, idx, round(len(list_intersect(qt, dt))::DOUBLE / greatest(len(qt), 1) + CAST(0.5 AS DOUBLE) * b, 4) AS score FROM (
  SELECT query_id, idx, qt, dt, (CASE WHEN kw1 <> '' AND contains(q, lower(kw1)) THEN 1 ELSE 0 END) + (CASE WHEN kw2 <> '' AND contains(q, lower(kw2)) THEN 1 ELSE 0 END) AS b FROM {_QT} CROSS JOIN {_DT})
  WHERE len(list_intersect(qt, dt)) > 0 OR b > 0"""
OVERLAP = f"SELECT * FROM (SELECT query_id, idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM ({_OVER})) WHERE rank <= 5"


def overlap_hits(spark, d):
    return R.overlap_search(gold(spark, d), faq(spark, d))


@query("overlap_search", OVERLAP, BOTH)
def overlap_search(spark, d):
    return overlap_hits(spark, d)


_UNIT = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings"


@query(
    "vector_search",
    f"""SELECT query_id, idx, score FROM (SELECT query_id, idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rn FROM (
      SELECT q.vec_id AS query_id, e.vec_id AS idx, round(least(greatest(list_dot_product(q.v, e.v), 0), 1), 4) AS score FROM ({_UNIT}) q JOIN ({_UNIT}) e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)) WHERE rn <= 5""",
)
def vector_search(spark, d):
    rows = table(spark, d, "embeddings")
    return R.vector_search(rows.where("vec_id % 20 = 0"), rows).select("query_id", "idx", "score")


@query("vector_search_candidates")
def vector_search_candidates(spark, d):
    """The same search over hash buckets; its recall is tested against the exact one."""
    rows = table(spark, d, "embeddings")
    return R.vector_search(rows.where("vec_id % 20 = 0"), rows, mode="candidates").select("query_id", "idx", "score")


@query("top1_confidence", f"SELECT g.query_id, coalesce(max(s.score), 0) AS confidence FROM a_gold g LEFT JOIN ({SCORED}) s ON g.query_id = s.query_id GROUP BY g.query_id", BOTH)
def top1_confidence(spark, d):
    return R.top1_confidence(gold(spark, d), scored_hits(spark, d))


_PRINTS = "SELECT h, h AS p FROM (SELECT sha256(CAST(doc_id AS VARCHAR) || ':' || sha256(text)) AS h FROM documents)"
for _digits in (6, 4, 2):
    _PRINTS = f"SELECT sha256(string_agg(h, '' ORDER BY p, h)) AS h, substr(p, 1, {_digits}) AS p FROM ({_PRINTS}) GROUP BY substr(p, 1, {_digits})"


@query("corpus_fingerprint", f"SELECT substr(sha256('model-1|' || string_agg(h, '' ORDER BY p, h)), 1, 16) AS fingerprint FROM ({_PRINTS})")
def corpus_fingerprint(spark, d):
    return R.corpus_fingerprint(table(spark, d, "documents"), "model-1", "doc_id", "text")


@query("stale_documents", "SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 2 = 1 OR doc_id % 6 = 0")
def stale_documents(spark, d):
    docs = table(spark, d, "documents")
    # a cache that lacks odd ids and has older texts for every sixth
    old = F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))
    cache = R.document_hashes(docs.where("doc_id % 2 = 0").withColumn("text", old), "doc_id", "text")
    return R.stale_documents(docs, cache, "doc_id", "text")
