"""Benchmark decontamination by latent semantic retrieval.

Passages and benchmark items become TF-IDF vectors over the words of all items; document frequencies
are counted over all documents, and every word keeps a positive weight.  A distributed randomised SVD of
all items, which are what is searched for, gives one vector per word: its place in the latent space of ``rank``
dimensions and, for what that space leaves out, ``SKETCH`` random projections, so that no item
is without a vector.  There is one such space, however many items there are.

Every document is then searched whole: windows of 32 and 64 words at steps of 16 are projected, and
windows with a cosine of at least ``cosine`` to an item and at least ``cover`` of its weight are
candidates.  Items of more than 96 words are cut into parts that are searched one by one; a part
found stands for the place of its whole item.  Overlapping candidates of an item join to a region, which
is verified by the longest common subsequence of words: at least ``lcs`` of the item, and at
least ``answer_lcs`` of its answer (its last sentence of five words or more).

The words' hashes (12 bytes each), at most ``ROWS`` vectors, on which words are dealt by hash, and
``block_items`` items at a time are sent to the tasks; items beyond that are searched in further scans.

Defined cases: null and empty texts match nothing; items without a word cannot be found and are
left out; repeated items are each reported; repeated rows are reported alike, once per doc_id; very long
texts are searched in whole; of equally good regions the one with the higher cosine, then the
later one is reported; other columns of both tables are kept or not read, whatever their names; empty
tables give an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, plain_words
from .hashing import CodeTable, word_hashes

STEP = 16
WIDTHS = (2, 4)
LONGEST = 96
PART = 64
ROWS = 1 << 16
SKETCH = 64
GROUP_WORDS = 100_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence by bit rows: one addition per element of b."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def answer_words(text: str) -> list[bytes]:
    """Words of the last sentence of at least five words, or of the whole text."""
    for part in reversed(_SENTENCE.split(text)):
        words = plain_words(part)
        if len(words) >= 5:
            return words
    return plain_words(text)


def parts_of(words: list) -> list[tuple[int, int]]:
    """First and last + 1 words of the parts that are searched: one, if a window holds the item."""
    n = 1 if len(words) <= LONGEST else -(-len(words) // PART)
    edges = [len(words) * k // n for k in range(n + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def item_vocabulary(benchmark: DataFrame) -> np.ndarray:
    """Sorted hashes of the distinct words of all items."""

    def run(batches):
        for pdf in batches:
            found = [word_hashes(plain_words(t)) for t in pdf["text"] if t]
            yield pd.DataFrame({"h": np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)})

    return np.sort(benchmark.select("text").mapInPandas(run, "h long").distinct().toPandas()["h"].to_numpy(np.int64))


class Vocabulary:
    """Rows of the item words, by hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        dealt, row = np.unique(hashes.view(np.uint64) % np.uint64(ROWS), return_inverse=True)
        self.size, self.row = len(dealt), row.astype(np.int32)
        self._table = None

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The row of every word, -1 for words of no item."""
        if self._table is None:
            self._table = CodeTable(self.hashes, self.row.astype(float))
        value, known = self._table.get(word_hashes(words))
        return np.where(known, value, -1).astype(np.int64)


def groups(pdf: pd.DataFrame, most: int = GROUP_WORDS):
    """The texts of a batch as lists of (position in the batch, words), about ``most`` words each."""
    group, size = [], 0
    for k, text in enumerate(pdf["text"]):
        if text:
            words = plain_words(text)
            if words:
                group.append((k, words))
                size += len(words)
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


def document_frequencies(documents: DataFrame, held) -> tuple[np.ndarray, int]:
    """Documents with each row's words, and all documents; ``held`` is the broadcast vocabulary."""
    size = held.value.size

    def run(batches):
        vocabulary = held.value
        count = np.zeros(size + 1, np.int64)
        for pdf in batches:
            count[size] += len(pdf)
            for group in groups(pdf):
                row = vocabulary.rows([w for _, ws in group for w in ws])
                own = np.repeat(np.arange(len(group)), [len(ws) for _, ws in group])
                key = np.unique((own * size + row)[row >= 0])
                count[:size] += np.bincount(key % size, minlength=size)
        some = np.flatnonzero(count)
        yield pd.DataFrame({"term": some, "df": count[some]})

    rows = documents.select("text").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    found = np.zeros(size + 1, np.int64)
    found[rows["term"].to_numpy(np.int64)] = rows["df"]
    return found[:size], int(found[size])


def randomised_svd(rows: DataFrame, size: int, rank: int, seed: int = 3, passes: int = 2, over: int = 16) -> np.ndarray:
    """Right singular vectors (size x rank) of a table of sparse rows (terms array<long>,
    weights array<float>).

    Each pass multiplies by A'A: tasks add up their share for each term, the shares are
    summed by term, and the driver orthogonalises a matrix of size x (rank + over).
    """
    spark = rows.sparkSession
    width = min(rank + over, size)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for _ in range(passes + 1):
        held = spark.sparkContext.broadcast(q.astype(np.float32))

        def run(batches):
            part: dict[int, np.ndarray] = {}
            for pdf in batches:
                for t, w in zip(pdf["terms"], pdf["weights"]):
                    for term, share in zip(t.tolist(), np.outer(w, w @ held.value[t]).astype(np.float64)):
                        if term in part:
                            part[term] += share
                        else:
                            part[term] = share
            some = np.array(sorted(part), np.int64)
            for at in range(0, len(some), 1000):
                yield pd.DataFrame({"chunk": some[at : at + 1000] // 32, "term": some[at : at + 1000], "v": [part[t] for t in some[at : at + 1000].tolist()]})

        def add(pdf):
            v = np.stack(pdf["v"])
            terms, inverse = np.unique(pdf["term"], return_inverse=True)
            total = np.zeros((len(terms), v.shape[1]))
            np.add.at(total, inverse, v)
            return pd.DataFrame({"term": terms, "v": list(total)})

        shares = rows.mapInPandas(run, "chunk long, term long, v array<double>")
        summed = shares.groupBy("chunk").applyInPandas(add, "term long, v array<double>").toPandas()
        y = np.zeros((size, width))
        if len(summed):
            y[summed["term"].to_numpy(np.int64)] = np.stack(summed["v"])
        q = np.linalg.svd(y, full_matrices=False)[0]
    return q[:, :rank]


def latent_space(benchmark: DataFrame, held, idf: np.ndarray, rank: int) -> np.ndarray:
    """One weighted vector per row of the vocabulary, from all items: their best ``rank`` dimensions keep most of the
    inner products that any window can have with them."""
    size = len(idf)

    def sparse(row: np.ndarray) -> tuple[list, list]:
        terms, tf = np.unique(row[row >= 0], return_counts=True)
        return terms.tolist(), (tf * idf[terms]).tolist()

    def frame(rows: list) -> pd.DataFrame:
        rows = [r for r in rows if r[0]]
        return pd.DataFrame({"terms": pd.Series([r[0] for r in rows], dtype=object), "weights": pd.Series([r[1] for r in rows], dtype=object)})

    def items(batches):
        for pdf in batches:
            yield frame([sparse(held.value.rows(ws)) for group in groups(pdf) for _, ws in group])

    schema = "terms array<long>, weights array<float>"
    # written once for the passes of the decomposition
    fit = cut(benchmark.select("text").mapInPandas(items, schema), "svd-items")
    fit = fit.coalesce(max(8, fit.count() // 50_000))
    q = randomised_svd(fit, size, min(rank, size))
    rest = np.random.default_rng(5).choice([-1.0, 1.0], (size, SKETCH)) / np.sqrt(SKETCH)
    return (np.hstack([q, rest - q @ (q.T @ rest)]) * idf[:, None]).astype(np.float32)


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    rank: int = 192,
    cosine: float = 0.4,
    cover: float = 0.35,
    lcs: float = 0.55,
    answer_lcs: float = 0.4,
    block_items: int = 5000,
) -> DataFrame:
    """Rows (doc_id, item_id, cosine, lcs, answer_lcs, first_word, last_word)."""
    spark = documents.sparkSession
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((documents, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, lcs double, answer_lcs double, first_word long, last_word long"
    documents, benchmark = documents.select("doc_id", "text"), benchmark.select("item_id", "text")
    hashes = item_vocabulary(benchmark)
    if not len(hashes):
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(Vocabulary(hashes))
    df, n_docs = document_frequencies(documents, held)
    idf = np.log((n_docs + 1) / (df + 1)) + 0.1
    vectors = spark.sparkContext.broadcast(latent_space(benchmark, held, idf, rank))
    blocks = max(1, -(-benchmark.count() // block_items))
    found = None
    for k in range(blocks):
        items = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).where("text is not null").toPandas()
        part = _leaks_of_block(documents, items.sort_values("item_id").reset_index(drop=True), held, vectors, schema, cosine, cover, lcs, answer_lcs)
        found = part if found is None else found.unionByName(part)
    return found


def _leaks_of_block(documents, items, held, vectors, schema, cosine, cover, lcs, answer_lcs) -> DataFrame:
    spark = documents.sparkSession
    words = [plain_words(t) for t in items["text"]]
    parts = [(i, a, b) for i, ws in enumerate(words) for a, b in parts_of(ws)]
    queries = np.stack([vectors.value[held.value.rows(words[i][a:b])].sum(0) for i, a, b in parts]) if parts else np.zeros((0, vectors.value.shape[1]), np.float32)
    norms = np.linalg.norm(queries, axis=1)
    state = spark.sparkContext.broadcast((queries / np.maximum(norms, 1e-9)[:, None], norms, parts, words, [answer_words(t) for t in items["text"]], items["item_id"].tolist()))

    def search(batches):
        for pdf in batches:
            for group in groups(pdf):
                yield _search_group(group, pdf["doc_id"], held.value, vectors.value, state.value, cosine, cover, lcs, answer_lcs)

    leaks = documents.mapInPandas(search, schema)
    best = F.max(F.struct("lcs", "cosine", "answer_lcs", "first_word", "last_word")).alias("m")
    return leaks.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.cosine", "m.lcs", "m.answer_lcs", "m.first_word", "m.last_word")


def block_vectors(row: np.ndarray, block: np.ndarray, n: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows' vectors in each of n blocks (``block`` is sorted): slots of the blocks, 0 without
    any row, and the sums by slot."""
    count = np.bincount(block, minlength=n)
    used = np.flatnonzero(count)
    slot = np.zeros(n, np.int64)
    slot[used] = np.arange(1, len(used) + 1)
    sums = np.zeros((len(used) + 1, vectors.shape[1]), np.float32)
    begin = np.cumsum(count[used]) - count[used]
    for k in range(int(count.max(initial=0))):  # at most STEP words a block
        some = np.flatnonzero(count[used] > k)
        sums[some + 1] += vectors[row[begin[some] + k]]
    return slot, sums


def _search_group(group: list, doc_ids, vocabulary: Vocabulary, vectors: np.ndarray, state: tuple, cosine: float, cover: float, lcs: float, answer_lcs: float) -> pd.DataFrame:
    """All verified regions of some documents."""
    queries, norms, searched, item_words, answers, item_ids = state
    # documents lie one after another in blocks of STEP words, with empty blocks between
    sizes = np.array([len(ws) for _, ws in group])
    n_blocks = -(-sizes // STEP) + WIDTHS[-1]
    begin = np.cumsum(n_blocks) - n_blocks
    at = int(n_blocks.sum())
    row = vocabulary.rows([w for _, ws in group for w in ws])
    block = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // STEP + np.repeat(begin, sizes)
    hit = row >= 0
    slot, sums = block_vectors(row[hit], block[hit], at + WIDTHS[-1], vectors)
    regions: dict[tuple[int, int], list] = {}
    size = max(1, min(4096, 20_000_000 // max(1, len(searched))))
    for width in WIDTHS if len(searched) else ():
        windows = np.flatnonzero(np.convolve(slot > 0, np.ones(width), "full")[width - 1 :][:at] > 0)
        for s in range(0, len(windows), size):
            w = windows[s : s + size]
            x = sums[slot[w]]
            for k in range(1, width):
                x += sums[slot[w + k]]
            length = np.linalg.norm(x, axis=1)
            inner = x @ queries.T
            i, j = np.nonzero(inner >= (cosine * length)[:, None])
            near = inner[i, j] >= cover * norms[j]
            i, j = i[near], j[near]
            cos = inner[i, j] / np.maximum(length[i], 1e-9)
            for a, b, c in zip(i.tolist(), j.tolist(), cos.tolist()):
                first = int(w[a])
                doc = int(np.searchsorted(begin, first, side="right")) - 1
                lo = (first - int(begin[doc])) * STEP
                item, begins, ends = searched[b]
                before, after = (x + x // 4 for x in (begins, len(item_words[item]) - ends))  # the rest of the item, with room for changes
                regions.setdefault((doc, item), []).append((lo - STEP - before, lo + (width + 1) * STEP + after, c))
    out = []
    for (doc, item), spans in regions.items():
        ws = group[doc][1]
        spans.sort()
        merged: list[list] = []
        for lo, hi, c in spans:
            lo, hi = max(lo, 0), min(hi, len(ws))
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
                merged[-1][2] = max(merged[-1][2], c)
            else:
                merged.append([lo, hi, c])
        for lo, hi, c in merged:
            share = lcs_length(item_words[item], ws[lo:hi]) / len(item_words[item])
            if share < lcs:
                continue
            answer = lcs_length(answers[item], ws[lo:hi]) / len(answers[item])
            if answer >= answer_lcs:
                out.append((doc_ids.iloc[group[doc][0]], item_ids[item], c, share, answer, lo, hi - 1))
    return pd.DataFrame(out, columns=["doc_id", "item_id", "cosine", "lcs", "answer_lcs", "first_word", "last_word"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``documents`` without a leak; rows with a null doc_id cannot be told apart
    and are kept unless a leak with a null doc_id is found."""
    bad = find_leaks(documents, benchmark, **options).select(F.col("doc_id").alias("leaked_doc")).distinct()
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["leaked_doc"]), "left_anti")


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op8_latent_decontamination": op8_latent_decontamination}
