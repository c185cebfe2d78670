"""Repeated passages by paragraph MinHash banding.

Paragraphs are the lines of a text with at least five words.  Each gets a MinHash signature
over its five-word windows, banded for high recall: five bands of three rows, so exact copies
always collide and paragraphs with a Jaccard similarity of 0.8 do with probability 0.97.
Colliding paragraphs are verified by exact Jaccard similarity of at least 0.8 and clustered by
components, first neighbours, then all of different clusters (``components.remaining_links``).  Of a
cluster that spans documents, the paragraph of the first document stays.

A passage may also stand inside a longer paragraph.  Texts are therefore cut into pieces as
well, at line ends and at words whose hash is the least of the ``RADIUS`` words on either side;
the cuts depend on nearby words alone, so the passage gives the same inner pieces
everywhere.  Pieces of five words or more that occur in several documents are clusters of equal pieces:
two 64-bit hashes, one over their bytes and one over their words, must both agree.

Repeats are reported with the words of their run of consecutive repeats.  The operator reports all of
them unless ``run_words`` asks for longer runs; the registered query asks for ``RUN_WORDS`` words, so that
short common lines are left alone.  With unrelated surroundings, an exact passage of 51 words inside
longer lines leaves that many with probability 0.99.

Defined cases: null and empty texts have no paragraphs; texts of any length are cut whole; lines of
fewer than five words are no paragraphs; repeats within one doc_id alone form no cluster; repeated rows are
each reported; of equal paragraphs the first by doc_id, text hash and place stays; other columns are not
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .components import all_components, colliding_pairs
from .hashing import SpanHashes, mix, window_hashes

WORDS = 5
RADIUS = 4
BANDS, ROWS = 5, 3
NEAR = 2
SIMILARITY = 0.8
RUN_WORDS = 25

_rng = np.random.default_rng(411)
_MULTIPLY = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


#: Words that are hashed together, whole texts.
AT_ONCE = 20_000


def split_words(text: str | None) -> tuple[list[bytes], list[int]]:
    """Words of a text, and the last word of each of its lines (-1 before the first word)."""
    words: list[bytes] = []
    ends = []
    for line in (text or "").lower().encode("utf-8", "replace").split(b"\n"):
        words += line.split()
        ends.append(len(words) - 1)
    return words, ends


def least_around(h: np.ndarray, radius: int) -> np.ndarray:
    """Minima of all stretches of 2 * radius + 1 values."""
    width, size, least = 2 * radius + 1, 1, h
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(h) - width + 1], least[width - size :][: len(h) - width + 1])


class Cut:
    """Words of some texts, one after another; first and last words of their lines and of their pieces, of those
    with at least five words.  ``begins`` has the first word of each text, and the number of all words."""

    def __init__(self, *texts: str | None, split: list | None = None):
        self.words: list[bytes] = []
        ends, begins = [], [0]
        for words, last in split or map(split_words, texts):
            ends += [len(self.words) + e for e in last]
            self.words += words
            begins.append(len(self.words))
        self.begins = np.array(begins)
        self.lines = self.pieces = (np.zeros(0, np.int64),) * 2
        if len(self.words) < WORDS:
            return
        self.hashes = SpanHashes(self.words)
        h = self.hashes.windows(1)
        # the texts lie apart, so that no word is compared with another text's
        at = np.arange(len(h)) + RADIUS * np.repeat(np.arange(1, len(begins)), np.diff(self.begins))
        padded = np.full(len(h) + RADIUS * len(begins), np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[at] = h
        least = np.flatnonzero(least_around(padded, RADIUS)[at - RADIUS] == h)
        self.lines = self._spans(np.array(ends))
        self.pieces = self._spans(np.r_[least, ends])

    def _spans(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = np.unique(last[last >= 0])
        first = np.r_[0, last[:-1] + 1]
        enough = last - first + 1 >= WORDS
        return first[enough], last[enough]

    def rows(self) -> tuple[np.ndarray, ...]:
        """Of all lines, then all pieces: kind, text, number in its text, first and last word there, two hashes; bands of the lines."""
        first, last = (np.concatenate(x) for x in zip(self.lines, self.pieces))
        kind = np.repeat([0, 1], [len(self.lines[0]), len(self.pieces[0])])
        text = np.searchsorted(self.begins, first, side="right") - 1
        new = np.r_[True, (text[1:] != text[:-1]) | (kind[1:] != kind[:-1])]
        number = np.arange(len(first)) - np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))
        node, more = self.hashes.spans(first, last).view(np.int64), self.hashes.word_sums(first, last).view(np.int64)
        return kind, text, number, first - self.begins[text], last - self.begins[text], node, more, band_values(self.hashes, *self.lines).view(np.int64)


def band_values(hashes: SpanHashes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(paragraphs, bands): hashes of ROWS minima over the five-word windows."""
    h = hashes.windows(WORDS)
    edges = np.column_stack([first, last - WORDS + 2]).ravel()
    out = np.zeros((len(first), BANDS), np.uint64)
    h = np.r_[h, np.uint64(0)]  # so that the last edge is a valid index
    if not len(first):
        return out
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat(mix(h * _MULTIPLY[k] + _ADD[k]), edges)[::2]
        out[:, k // ROWS] = mix(out[:, k // ROWS] * np.uint64(31) + least + np.uint64(k // ROWS))
    return out


def paragraph_table(documents: DataFrame) -> DataFrame:
    """(kind, doc_id, xx, no, first, last, node, more, b0...): lines with their bands, and pieces; node and
    more are two hashes of the words."""
    names = [f"b{k}" for k in range(BANDS)]

    def groups(texts):
        at, split, size = [], [], 0
        for k, text in enumerate(texts):
            at.append(k)
            split.append(split_words(text))
            size += len(split[-1][0])
            if size >= AT_ONCE:
                yield np.array(at), Cut(split=split)
                at, split, size = [], [], 0
        if at:
            yield np.array(at), Cut(split=split)

    def run(batches):
        for pdf in batches:
            doc, xx = pdf["doc_id"], pdf["xx"].to_numpy()
            doc = (doc.astype(object) if doc.isna().any() else doc).to_numpy()
            parts, size = [], 0
            for at, c in groups(pdf["text"]):
                if len(c.lines[0]) + len(c.pieces[0]):
                    kind, text, *rest = c.rows()
                    parts.append((kind, doc[at[text]], xx[at[text]], *rest))
                    size += len(kind)
                if size >= 50_000:
                    yield _frame(parts, names)
                    parts, size = [], 0
            if parts:
                yield _frame(parts, names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.xxhash64("text").alias("xx"), "text")
    return rows.mapInPandas(run, f"kind int, doc_id {kind}, xx long, no int, first int, last int, node long, more long, " + ", ".join(f"{n} long" for n in names))


def _frame(parts: list, names: list[str]) -> pd.DataFrame:
    kind, doc, xx, no, first, last, node, more, lines = (np.concatenate(x) for x in zip(*parts))
    out = pd.DataFrame({"kind": kind, "doc_id": doc, "xx": xx, "no": no, "first": first, "last": last, "node": node, "more": more})
    bands = np.zeros((len(names), len(out)), np.int64)
    bands[:, kind == 0] = lines.T
    for k, n in enumerate(names):
        out[n] = pd.arrays.IntegerArray(bands[k], kind != 0)
    return out


def _verifier(texts: DataFrame, similarity: float):
    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("words").alias("wa"))
        right = texts.select(F.col("node").alias("b"), F.col("words").alias("wb"))

        def run(batches):
            for pdf in batches:
                ok = []
                for x, y in zip(pdf["wa"], pdf["wb"]):
                    s, t = (set(window_hashes(bytes(w).split(b" "), WORDS).tolist()) for w in (x, y))
                    ok.append(len(s & t) >= similarity * len(s | t))
                yield pdf.loc[np.array(ok, bool), ["a", "b"]]

        return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInPandas(run, "a long, b long")

    return verify


def _texts_of(documents: DataFrame, places: DataFrame) -> DataFrame:
    """Words of paragraphs; ``places`` has one (doc_id, xx, first, last) per node."""

    def run(batches):
        for pdf in batches:
            words = []
            for text, spots in zip(pdf["text"], pdf["spots"]):
                found, _ = split_words(text)
                words.append([{"node": s["node"], "words": b" ".join(found[s["first"] : s["last"] + 1])} for s in spots])
            yield pd.DataFrame({"found": words})

    spots = places.groupBy("doc_id", "xx").agg(F.collect_list(F.struct("node", "first", "last")).alias("spots"))
    spots = spots.withColumnRenamed("doc_id", "_doc").withColumnRenamed("xx", "_xx")
    rows = documents.select("doc_id", F.xxhash64("text").alias("xx"), "text")
    joined = rows.join(spots, rows["doc_id"].eqNullSafe(spots["_doc"]) & (rows["xx"] == spots["_xx"]))
    found = joined.select("text", "spots").mapInPandas(run, "found array<struct<node:long,words:binary>>")
    return found.select(F.explode("found").alias("f")).groupBy("f.node").agg(F.any_value("f.words").alias("words"))


def _line_clusters(documents: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """(node, cluster) of the lines whose cluster spans documents."""
    bands = [f"b{k}" for k in range(BANDS)]
    nodes = cut(
        lines.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), *(F.any_value(b).alias(b) for b in bands)), "line-nodes"
    )
    pairs = cut(colliding_pairs(nodes.select("node", F.explode(F.array(*bands)).alias("value")), NEAR), "line-pairs")

    def texts_of(ends: DataFrame) -> DataFrame:
        # grouped before the join, so that a line of very many documents is summed up in each task
        places = lines.groupBy("node").agg(F.min(F.struct("doc_id", "xx", "first", "last")).alias("at")).join(ends, "node")
        return cut(_texts_of(documents, places.select("node", "at.doc_id", "at.xx", "at.first", "at.last")), "line-texts")

    met = pairs.where("not end")
    texts = texts_of(met.select(F.col("a").alias("node")).unionByName(met.select(F.col("b").alias("node"))).distinct())
    labels, _ = all_components(
        pairs, _verifier(texts, similarity), sketches=nodes.select("node", F.array(*bands).alias("sk")), small=NEAR + 2,
        texts_of=lambda ends: texts_of(ends).withColumnRenamed("words", "text"),
        features=lambda words: np.unique(window_hashes(bytes(words).split(b" "), WORDS)),
        bound=lambda common, n, m: common >= similarity * (n + m - common),
    )
    member = nodes.select("node", "low", "high").join(labels, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    spread = member.groupBy("cluster").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    return member.select("node", "cluster").join(spread.select("cluster"), "cluster")


def repeated_passages(documents: DataFrame, similarity: float = SIMILARITY, run_words: int = WORDS) -> DataFrame:
    """One row per repeated paragraph or piece: doc_id, kind (line or piece), first_word,
    last_word, passage_words (of the run), first_doc (the first document with it), removed."""
    table = cut(paragraph_table(documents), "paragraphs")
    lines = _line_clusters(documents, table.where("kind = 0"), similarity)
    pieces = table.where("kind = 1").groupBy("node", "more").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    any_ = F.lit(None).cast("long")  # lines are compared by their texts
    clusters = lines.select(F.lit(0).alias("c_kind"), F.col("node").alias("c_node"), any_.alias("c_more"), "cluster").unionByName(
        pieces.select(F.lit(1).alias("c_kind"), F.col("node").alias("c_node"), F.col("more").alias("c_more"), F.col("node").alias("cluster"))
    )
    clusters = cut(clusters, "paragraph-clusters")
    place = ["kind", "doc_id", "xx", "no", "first", "last"]
    same = (F.col("node") == F.col("c_node")) & (F.col("kind") == F.col("c_kind"))
    found = table.join(clusters, same).where(F.col("c_more").isNull() | (F.col("c_more") == F.col("more"))).select(*place, "cluster", F.coalesce("c_more", F.lit(0)).alias("more"))
    by_doc = Window.partitionBy("kind", "doc_id", "xx").orderBy("no")
    found = found.withColumn("run", F.col("no") - F.dense_rank().over(by_doc))
    same_run = Window.partitionBy("kind", "doc_id", "xx", "run")
    found = found.withColumn("run_words", F.max("last").over(same_run) - F.min("first").over(same_run) + 1)
    found = cut(found.where(F.col("run_words") >= run_words), "paragraph-runs")
    own = F.struct("doc_id", "xx", "no")
    key = ["kind", "cluster", "more"]
    # written, so that the join can split the rows of a very common paragraph
    keeper = cut(found.groupBy(*(F.col(k).alias(f"k_{k}") for k in key)).agg(F.min(own).alias("keeper")), "paragraph-keepers")
    out = found.join(keeper, [F.col(k) == F.col(f"k_{k}") for k in key])
    return out.select(
        "doc_id", F.when(F.col("kind") == 0, "line").otherwise("piece").alias("kind"), F.col("first").alias("first_word"), F.col("last").alias("last_word"),
        F.col("run_words").alias("passage_words"), F.col("keeper.doc_id").alias("first_doc"), (own != F.col("keeper")).alias("removed"),
    )


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), run_words=RUN_WORDS)


QUERIES = {"op4_paragraph_dedup": op4_paragraph_dedup}
