"""Near-duplicate documents by Order MinHash.

A text becomes the sequence of its five-word windows, each labelled with how often it has
occurred before.  For every one of ``FUNCTIONS`` hash functions the ``KEPT`` windows with the
smallest hashes are sampled and kept in text order; every two of them, in that order, make one sketch
value.  Equal values need the same windows in the same order, so they follow the edit
similarity and not only the shared vocabulary; and two samples that agree on any two of their
windows share a value, whichever others they hold.

Candidates come from sorted values (``components.colliding_pairs``), then from all texts of
different classes that share a value (``components.remaining_links``), and are
verified by banded alignment of the words: 1 - edits / longer length must be at
least ``similarity``, and cells farther from the diagonal than the allowed edits are never
computed.  Texts with the same words are one class from the start.

Recall: a changed word breaks five windows, so at an edit similarity of 0.8 about a third of the
windows, a Jaccard similarity of 0.2, is left. There two samples of four agree on two windows or more with a probability of about
0.25, and on all of the functions together practically always at 0.85 and above.

Defined cases: words are lower-cased and split at white space; a text without words
(null, empty) is no duplicate of anything; texts of one to four words have one window and
match only equal texts; texts of any length are sketched and aligned whole; rows that repeat a doc_id
belong to the classes of their texts; the class id is the least doc_id of its rows, and its row of the
least text hash is the one to keep; other columns, whatever their names, are kept by ``deduplicate``
and not read by ``near_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .components import all_components, colliding_pairs
from .hashing import mix, occurrence_numbers, window_hashes

WORDS = 5
FUNCTIONS = 10
KEPT = 4
NEAR = 3
SIMILARITY = 0.8

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split() if text else []


def labels_of(h: np.ndarray) -> np.ndarray:
    return mix(h + occurrence_numbers(h) * np.uint64(0x9E3779B97F4A7C15))


def labelled_words(text: str) -> np.ndarray:
    """Distinct hashes, as many as the text has words."""
    return labels_of(window_hashes(words_of(text), 1))


def similar(x: str, y: str, similarity: float) -> bool:
    return aligned(window_hashes(words_of(x), 1), window_hashes(words_of(y), 1), similarity)


def order_sketch(h: np.ndarray) -> np.ndarray:
    """The values of a sequence of window hashes: per hash function, one for every two of its sampled windows
    in text order.  A single window is a value of its own."""
    if len(h) == 1:
        return mix(h + np.uint64(1))
    label = labels_of(h)
    keep = min(KEPT, len(h))
    first, second = np.triu_indices(keep, 1)
    out = []
    step = max(1, (1 << 22) // len(h))
    for s in range(0, FUNCTIONS, step):
        rows = label[None, :] * _MULTIPLY[s : s + step, None] + _ADD[s : s + step, None]
        rows ^= rows >> np.uint64(29)
        at = np.argpartition(rows, keep - 1, axis=1)[:, :keep] if keep < len(h) else np.tile(np.arange(keep), (len(rows), 1))
        at.sort(axis=1)
        out.append(mix(mix(h[at[:, first]]) * np.uint64(31) + h[at[:, second]]).ravel())
    return np.concatenate(out)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the edit distance is at most (1 - similarity) of the longer sequence."""
    n, m = len(a), len(b)
    most = int((1 - similarity) * max(n, m) + 1e-9)
    if abs(n - m) > most:
        return False
    if n == m and int((a != b).sum()) <= most:
        return True
    lo = min(n, m)
    differ = np.flatnonzero(a[:lo] != b[:lo])
    head = int(differ[0]) if len(differ) else lo
    a, b = a[head:], b[head:]
    lo = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:lo] != b[::-1][:lo])
    tail = int(differ[0]) if len(differ) else lo
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b)) <= most
    values, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    gap = np.bincount(inverse[: len(a)], minlength=len(values)) - np.bincount(inverse[len(a) :], minlength=len(values))
    if max(int(gap[gap > 0].sum()), int(-gap[gap < 0].sum())) > most:
        return False
    parts = sorted([inverse[: len(a)].tolist(), inverse[len(a) :].tolist()], key=len)
    return _within_band(*parts, most)


def _within_band(a: list[int], b: list[int], most: int) -> bool:
    """Over a band that doubles until the distance fits in it or ``most`` does; b is the longer one."""
    band = min(most, max(64, 2 * (len(b) - len(a))))
    while _distance(a, b, band) > band:
        if band >= most:
            return False
        band = min(most, 2 * band)
    return True


def _distance(a: list[int], b: list[int], band: int) -> int:
    """Edit distance if at most ``band``, else some larger number.

    Cell (i, j) compares b's first i words with a's first j.  The cells of a column within ``band`` of
    the diagonal are the bits of one integer, bit k the row j - band + k, so a column takes a dozen
    operations on integers: ``up`` and ``down`` tell whether a cell is one more or one less than
    the cell above it, ``same`` whether it equals the cell diagonally before it.
    """
    width = 2 * band + 1
    full = (1 << width) - 1
    top = 1 << (width - 1)
    gap = len(b) - len(a)
    ends = 1 << (band + gap)  # the diagonal that ends in the last cell
    cost = gap
    up, down = full & ~((1 << band) - 1), 0  # column 0 counts b's words; rows above it are no cells
    at: dict[int, tuple[int, int]] = {}  # word -> its places in b as bits, from a first place on
    for i in range(min(band, len(b))):
        bits, base = at.get(b[i], (0, i))
        at[b[i]] = (bits | 1 << (i - base), base)
    for j in range(len(a)):
        i = j + band
        if i < len(b):  # enters the band
            bits, base = at.get(b[i], (0, i))
            at[b[i]] = (bits | 1 << (i - base), base)
        low = j - band
        equal = 0
        if a[j] in at:
            bits, base = at[a[j]]
            if base < low:
                bits >>= low - base
                if bits:
                    at[a[j]] = (bits, low)
                else:
                    del at[a[j]]
                base = low
            equal = bits << (base - low)
        same = (((equal & up) + up) ^ up) | equal | down
        right = down | (full & ~(same | up))
        left = same & up
        if not same & ends:
            cost += 1
            if cost > band:
                return cost
        below = (same & full) >> 1
        up = (left | ~(below | right)) & full | top
        down = below & right & ~top
    return cost


def sketch_table(documents: DataFrame) -> DataFrame:
    """(doc_id, xx, node, sk, size): node is a hash of the words, null without any; sk are the distinct
    values, function by function; size is the number of words."""

    def run(batches):
        for pdf in batches:
            nodes, sks, sizes = [], [], []
            for text in pdf["text"]:
                words = words_of(text)
                sizes.append(len(words))
                if not words:
                    nodes.append(None)
                    sks.append(None)
                    continue
                nodes.append(int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "big", signed=True))
                values = order_sketch(window_hashes(words, WORDS)).view(np.int64)
                sks.append(values[np.sort(np.unique(values, return_index=True)[1])])
            sketch = {"node": pd.array(nodes, "Int64"), "sk": pd.Series(sks, dtype=object), "size": sizes}
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "xx": pdf["xx"], **sketch})

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.xxhash64("text").alias("xx"), "text")
    return rows.mapInPandas(run, f"doc_id {kind}, xx long, node long, sk array<long>, size long")


def _verifier(texts: DataFrame, similarity: float):
    """Keeps the pairs whose texts align; ``texts`` is (node, text)."""

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

        def run(batches):
            for pdf in batches:
                words = {}  # a node's hashes, once a batch

                def hashed(node, text):
                    if node not in words:
                        words[node] = window_hashes(words_of(text), 1)
                    return words[node]

                ok = [aligned(hashed(a, x), hashed(b, y), similarity) for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"])]
                yield pdf.loc[np.array(ok, bool), ["a", "b"]]

        return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")

    return verify


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``documents``: doc_id, class_id, n_links (similar texts that the
    row's own text was linked with), n_copies (rows with the same words), keep (one row of
    each class)."""
    table = cut(sketch_table(documents), "omh-sketches")
    known = table.where("node is not null")
    nodes = cut(
        known.groupBy("node").agg(F.min(F.struct("doc_id", "xx")).alias("at"), F.any_value("sk").alias("sk"), F.any_value("size").alias("size"), F.count("*").alias("n_copies")), "omh-nodes"
    )
    # beside each value one of another function, so that texts which agree on both become neighbours
    step = KEPT * (KEPT - 1) // 2
    other = F.transform("sk", lambda x, i: F.struct(x.alias("value"), F.element_at("sk", (i + step) % F.size("sk") + 1).alias("then")))

    def bound(common, n, m):
        longer = np.maximum(n, m)
        return common >= longer - np.floor((1 - similarity) * longer + 1e-9)

    values = nodes.select("node", "size", F.explode(other).alias("x")).select("node", "size", "x.*")
    pairs = cut(colliding_pairs(values, NEAR, lambda n, m: bound(np.minimum(n, m), n, m)), "omh-pairs")
    rows = documents.select("doc_id", F.xxhash64("text").alias("xx"), "text")

    def texts_of(ends: DataFrame) -> DataFrame:
        places = nodes.join(ends, "node").select("node", F.col("at.doc_id").alias("_doc"), F.col("at.xx").alias("_xx"))
        texts = rows.join(places, rows["doc_id"].eqNullSafe(places["_doc"]) & (rows["xx"] == places["_xx"]))
        return cut(texts.groupBy("node").agg(F.first("text").alias("text")), "omh-texts")

    met = pairs.where("not end")
    texts = texts_of(met.select(F.col("a").alias("node")).unionByName(met.select(F.col("b").alias("node"))).distinct())
    labels, links = all_components(
        pairs, _verifier(texts, similarity), sketches=nodes.select("node", "sk", "size"), texts_of=texts_of, features=labelled_words, bound=bound,
        similar=lambda x, y: similar(x, y, similarity), small=NEAR + 2, ratio=min(similarity, 0.99),
    )

    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    member = (
        nodes.select("node", F.col("at.doc_id").alias("first_doc"), "n_copies")
        .join(labels, "node", "left")
        .join(degree, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    # written, so that the join below can split the rows of a large class
    least = cut(member.groupBy("component").agg(F.min(F.struct("first_doc", "node")).alias("least")), "omh-least")
    member = cut(
        member.join(least, "component").select(
            F.col("node").alias("_node"), F.col("least.first_doc").alias("class_id"), F.col("least.node").alias("_keeper"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies",
        ), "omh-members",
    )
    keepers = nodes.select(F.col("node").alias("_knode"), F.col("at.doc_id").alias("_kdoc"), F.col("at.xx").alias("_kxx"))
    out = table.drop("sk", "size").join(member, table["node"] == member["_node"], "left").join(keepers, F.col("_keeper") == F.col("_knode"), "left")
    first = F.col("doc_id").eqNullSafe(F.col("_kdoc")) & F.col("xx").eqNullSafe(F.col("_kxx"))
    return out.select(
        "doc_id", "xx",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        (F.col("node").isNull() | first).alias("keep"), F.col("node").isNotNull().alias("has_words"),
    )


def deduplicate(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``documents`` less all but one row of each class; rows without words all stay."""
    found = near_duplicates(documents, similarity).where("keep")
    kept = found.groupBy(F.col("doc_id").alias("k_doc"), F.col("xx").alias("k_hash")).agg(F.count("*").alias("n"), F.any_value("has_words").alias("has_words"))
    kept = kept.select("k_doc", "k_hash", (F.col("has_words") & (F.col("n") > 1)).alias("repeats"))
    rows = documents.select(F.struct("*").alias("d"), F.xxhash64("text").alias("h"))  # the document's columns in one: no name clashes
    joined = cut(rows.join(kept, F.col("d.doc_id").eqNullSafe(F.col("k_doc")) & (F.col("h") == F.col("k_hash"))), "omh-kept")
    single = joined.where("not repeats")
    once = joined.where("repeats").withColumn("id", F.col("d.doc_id")).dropDuplicates(["id", "h"]).drop("id")
    return single.unionByName(once).select("d.*")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "n_links", "n_copies", "keep")


QUERIES = {"op1_order_minhash": op1_order_minhash}
