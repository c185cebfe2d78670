"""Connected components of an edge table, and candidate pairs from sorted sketches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node is connected with.

    Each round links every node with the least label around it and then with that label's
    own label, so chains shorten by half; only minima per node are shuffled, whatever a
    node's degree.  Rounds end when no label changes.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = cut(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = cut(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("m"))
        near = labels.join(around, "node").select("node", "component", F.least("component", "m").alias("m"))
        # hook: a label takes the least label that any of its nodes has seen
        near = cut(near, "near")
        # written, so that the join can split the rows of a large component
        hooks = cut(near.groupBy(F.col("component").alias("c")).agg(F.min("m").alias("h")), "hooks")
        hooked = near.join(hooks, F.col("component") == F.col("c")).select("node", F.least("m", "h").alias("component"), F.col("component").alias("was"))
        # jump: follow the label of the label
        jump = hooked.select(F.col("node").alias("c"), F.col("component").alias("j"))
        new = hooked.join(jump, F.col("component") == F.col("c"), "left").select("node", F.least("component", F.coalesce("j", "component")).alias("component"), "was")
        new = cut(new, "labels")
        labels = new.select("node", "component")
        if new.where("component <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle")


def _end(value: int) -> pd.DataFrame:
    return pd.DataFrame({"a": [value], "b": [0], "agree": [0], "end": [True]})


def colliding_pairs(rows: DataFrame, near: int = 2, may=None) -> DataFrame:
    """Pairs (a, b, agree) of nodes that share a value; ``rows`` is (node, value), with ``then`` and size if wanted.

    Rows are range-sorted by value (and by ``then``, another value of the node, so that nodes which
    agree on both become neighbours) and node, so that a hot value is dealt over many tasks; a
    node is paired with the ``near`` nodes before it and with the first node of its run in the
    same task, so pairs grow with the nodes.  ``agree`` counts the shared values at which a pair
    met.  Rows with ``end`` hold in ``a`` the first and last value of a task, whose runs may be cut; what
    such and longer runs leave out is left to ``remaining_links``.  ``may`` tells by both sizes whether a pair can be
    similar; others are not returned.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["value", *(c for c in rows.columns if c == "then"), "node"]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    columns = ["node", "value", *(["size"] if may else [])]

    def pair(batches):
        tail = None
        for pdf in batches:
            held = [pdf[c].to_numpy(np.int64) for c in columns]
            old = 0
            if tail is not None:
                old = len(tail[0])
                held = [np.concatenate([t, x]) for t, x in zip(tail, held)]
            node, value = held[:2]
            first = np.maximum.accumulate(np.where(np.r_[True, value[1:] != value[:-1]], np.arange(len(node)), 0))
            at = np.arange(old, len(node))
            at = at[first[at] < at]
            i = np.concatenate([first[at], *(np.maximum(at - lag, first[at]) for lag in range(1, near + 1))])
            j = np.tile(at, near + 1)
            x, y = node[i], node[j]
            ok = x != y
            if may:
                ok &= may(held[2][i], held[2][j])
            yield pd.DataFrame({"a": np.minimum(x, y)[ok], "b": np.maximum(x, y)[ok]}).drop_duplicates().assign(agree=1, end=False)
            if tail is None:
                yield _end(value[0])
            last = len(node) - 1
            keep = np.unique(np.r_[first[last], np.arange(max(first[last], last - near + 1), last + 1)])
            tail = [x[keep] for x in held]
        if tail is not None:
            yield _end(tail[1][-1])

    found = ordered.select(*columns).mapInPandas(pair, "a long, b long, agree int, end boolean")
    return found.groupBy("a", "b", "end").agg(F.sum("agree").cast("int").alias("agree"))


def verified_components(pairs: DataFrame, verify, best: int = 2) -> tuple[DataFrame, DataFrame]:
    """Components over the pairs that ``verify`` keeps, and the links found.

    First the ``best`` pairs of every node with earlier nodes are verified; of the others,
    all that do not lie inside one component already are verified next, so no link between
    components is lost and large groups need few comparisons.  ``verify`` takes pairs (a, b)
    and returns those that are similar.
    """
    from pyspark.sql import Window

    pairs = cut(pairs, "pairs")
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.col("agree").desc(), "a"))
    ranked = cut(pairs.withColumn("rank", rank), "ranked")
    links = cut(verify(ranked.where(F.col("rank") <= best).select("a", "b")), "links")
    labels = components(links)
    left = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    right = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    open_ = ranked.where(F.col("rank") > best).join(left, "a", "left").join(right, "b", "left")
    rest = cut(open_.where(F.col("ca").isNull() | F.col("cb").isNull() | (F.col("ca") != F.col("cb"))).select("a", "b"), "rest")
    more = cut(verify(rest), "links")
    links = links.unionByName(more)
    if more.limit(1).count():
        labels = components(links)
    return labels, links


def _salted(rows: DataFrame, few: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """A join by keys with very unequal numbers of nodes."""
    dealt = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(dealt, [*keys, "_salt"]).drop("_salt")


def _common(arrays: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many values the arrays ``left`` and the arrays ``right`` have in common, per pair; an array's values are distinct."""
    common = np.zeros((len(left), len(right)), np.float32)
    owner, value = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays]), np.unique(np.concatenate(arrays), return_inverse=True)[1]
    shared = np.bincount(value, minlength=1) > 1
    column = np.cumsum(shared) - 1
    owner, value = owner[shared[value]], column[value[shared[value]]]
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    for c in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(value, [c, c + width])
        held = np.zeros((len(arrays), width), np.float32)
        held[owner[s:e], value[s:e] - c] = 1
        common += held[left] @ held[right].T
    return common


SIGNATURE_BITS = (1 << 10, 1 << 14)


def signature(hashes: np.ndarray) -> bytes:
    """Parities of the numbers of distinct hashes at each of 2**k places, about two places a hash.  Texts whose
    signatures differ in d places have at least d features that only one of them has."""
    least, most = SIGNATURE_BITS
    bits = min(most, max(least, 1 << (2 * len(hashes)).bit_length()))
    at = (hashes.astype(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of words, all as long as the shortest: a half of one laid over the other is the shorter one."""
    size = min(map(len, signatures))
    out = np.empty((len(signatures), size // 8), np.uint64)
    for k, x in enumerate(signatures):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size // 8), axis=0)
    return out


def _most_common(signatures: list[bytes], size: np.ndarray, left: np.ndarray, right: np.ndarray, at_once: int = 1 << 21) -> np.ndarray:
    """How many features the texts ``left`` and ``right`` can have in common at most, by sizes and signatures."""
    n, m = size[left][:, None], size[right][None, :]
    words = _folded(signatures)
    x, y = words[left], words[right]
    differ = np.empty((len(left), len(right)), np.int64)
    step = max(1, at_once // max(1, y.size))
    for k in range(0, len(left), step):
        differ[k : k + step] = np.bitwise_count(x[k : k + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
    return np.minimum(np.minimum(n, m), (n + m - differ) // 2)


def remaining_links(
    sketches: DataFrame, labels: DataFrame, ends: DataFrame, texts_of, features, bound, similar=None, min_agree: int = 1, small: int = 4, block: int = 512,
    ratio: float | None = None,
) -> DataFrame | None:
    """Links (a, b) between components that the pass over neighbours has not met, or None.

    ``sketches`` is (node, sk array<long>), ``labels`` (node, component), ``ends`` (value) the
    runs that may be cut.  Nodes that share a value of their sketch make a run.  Of all runs
    that hold several components and more than ``small`` nodes, or that may be cut, every two
    nodes of different components are compared, once, at the first value that they share,
    if they share at least ``min_agree``.  So the components over these links
    and the former ones are those over all similar pairs that share values.

    A run is dealt into blocks of about ``block`` nodes, a component of that size into blocks
    of its own; every two blocks that hold different components meet in one task, so a
    large component costs no more than its nodes.  Nodes bring a signature of their features along, from which
    ``bound`` rules out most pairs without their texts (an exact filter); texts are joined to the nodes of the pairs
    that are left.  Inside a task, pairs that its links connect already are not compared.

    With ``ratio`` a sketch is a set of values, whatever their places (``min_agree`` is 1), and ``sketches`` has the
    column size, the number of a text's features; texts are similar only if the smaller size is at least
    ``ratio`` of the larger.  A run is split by classes of sizes before it is dealt: a node lies in its own class
    and in the next one, so two nodes that can be similar meet in the class of the larger, and a value that texts
    of all lengths share costs no comparisons between lengths.  A class that holds nodes of the one before alone is passed over.

    ``texts_of`` maps (node) to (node, text), ``features`` a text
    to an array of distinct hashes; ``bound`` tells by the number of common hashes and both
    sizes whether a pair may be similar, ``similar`` (by texts) whether it is.
    """
    run, tile = ["band", "value"], ["band", "value", "lo", "hi"]
    known = sketches.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if ratio is None:
        rows = known.select("node", "component", F.posexplode("sk").alias("band", "value"))
    else:
        rows = known.select("node", "component", F.lit(0).alias("band"), F.explode("sk").alias("value"))
    runs = rows.groupBy(*run).agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    cut_ = runs.where(F.col("n") <= small).join(F.broadcast(ends.select("value").distinct()), "value", "left_semi")  # two values a task at most
    runs = cut(runs.where(F.col("n") > small).select(*run).unionByName(cut_.select(*run)), "open-runs")
    if runs.limit(1).count() == 0:
        return None
    # one row per node, with its open runs: all that its rows below need is joined to it here, once
    nodes = _salted(rows, runs, run).groupBy("node").agg(F.any_value("component").alias("component"), F.collect_set(F.struct(*run)).alias("open"))
    if ratio is None:
        nodes = nodes.join(sketches.select("node", "sk"), "node")
    else:
        # the values of open runs alone tell where two nodes meet first; of other values a sketch need not be carried
        nodes = nodes.withColumn("sk", F.col("open.value"))
    nodes = cut(nodes, "open-nodes")
    texts = texts_of(nodes.select("node"))

    def sign(batches):
        for pdf in batches:
            found = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "size": [len(x) for x in found], "signature": [signature(x) for x in found]})

    signed = texts.select("node", "text").mapInPandas(sign, "node long, size long, signature binary")
    nodes = cut(nodes.join(signed, "node"), "open-values")
    members = nodes.withColumn("x", F.explode("open")).select("node", "component", "sk", "size", "signature", "x.*")
    if ratio is None:
        members = members.withColumn("larger", F.lit(True))
    else:
        class_ = F.floor(F.log("size") / F.log(F.lit(1 / ratio)) + 1e-9).cast("int")
        members = members.withColumn("class", class_).withColumn("band", F.explode(F.array("class", F.col("class") + 1))).withColumn("larger", F.col("class") == F.col("band")).drop("class")
    parts = members.groupBy(*run, "component").agg(F.count("*").alias("n"), F.max("larger").alias("larger"))
    few, large = F.col("n") < block, F.struct("component", F.ceil(F.col("n") / block).cast("int").alias("k"))
    shape = parts.groupBy(*run).agg(
        F.sum(F.when(few, F.col("n")).otherwise(0)).alias("few"), F.collect_list(F.when(~few, large)).alias("large"), F.count("*").alias("parts"), F.max("larger").alias("larger")
    ).where("parts > 1 and larger")

    def numbered(home, k):
        return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(home.alias("home"), F.xxhash64(home, i).alias("id")))

    pool = F.when(F.col("few") > 0, numbered(F.lit(None).cast("long"), F.ceil(F.col("few") / block).cast("int"))).otherwise(F.array())
    blocks = F.concat(F.flatten(F.transform("large", lambda x: numbered(x["component"], x["k"]))), pool)
    shape = cut(shape.select(*run, blocks.alias("blocks")), "open-blocks")
    own = F.filter("blocks", lambda x: x["home"] == F.col("component"))
    home = F.when(F.size(own) > 0, own).otherwise(F.filter("blocks", lambda x: x["home"].isNull()))
    met = F.filter("blocks", lambda x: x["home"].isNull() | (x["home"] != F.col("component")))
    placed = _salted(members.drop("larger"), shape, run).withColumn("block", home[F.pmod(F.xxhash64(F.lit(1), "node"), F.size(home)).cast("int")]["id"])
    if ratio is not None:
        placed = placed.withColumn("sk", F.filter("sk", lambda x: x < F.col("value")))
    placed = placed.withColumn("other", F.explode(F.transform(met, lambda x: x["id"]))).drop("blocks")
    placed = placed.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")

    carried = [*tile, "block", "node", "component", "sk", "size", "signature"]

    def pairs_of(pdf):
        component, block_ = pdf["component"].to_numpy(), pdf["block"].to_numpy()
        left = np.flatnonzero(block_ == pdf["lo"].iloc[0])
        right = np.flatnonzero(block_ == pdf["hi"].iloc[0])
        ok = component[left][:, None] != component[right][None, :]
        if pdf["lo"].iloc[0] == pdf["hi"].iloc[0]:
            ok = np.triu(ok, 1)
        if not ok.any():
            return left, right, ok
        size = pdf["size"].to_numpy()
        n, m = size[left][:, None], size[right][None, :]
        ok &= bound(_most_common(pdf["signature"].tolist(), size, left, right), n, m)
        if ratio is not None:
            ok &= np.floor(np.log(np.maximum(n, m)) / np.log(1 / ratio) + 1e-9) == pdf["band"].iloc[0]
        # of the pairs that are left, those that met at an earlier value
        some, others = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        if not len(some):
            return left, right, ok
        i, j = left[some], right[others]
        if ratio is None:
            sk = np.stack(pdf["sk"])
            agree, before = np.zeros((len(i), len(j)), np.int32), np.zeros((len(i), len(j)), bool)
            for k in range(sk.shape[1]):
                same = sk[i, k][:, None] == sk[j, k][None, :]
                agree += same
                if k < pdf["band"].iloc[0]:
                    before |= same
            new = (agree >= min_agree) & ~before
        else:
            sk = pdf["sk"].tolist()
            new = _common([sk[k] for k in np.r_[i, j]], np.arange(len(i)), len(i) + np.arange(len(j))) == 0
        ok[np.ix_(some, others)] &= new
        return left, right, ok

    def waiting(pdf):
        left, right, ok = pairs_of(pdf)
        at = np.unique(np.r_[left[ok.any(1)], right[ok.any(0)]])
        return pdf.iloc[at][carried]

    def link(pdf):
        left, right, ok = pairs_of(pdf)
        texts, node, component = pdf["text"].tolist(), pdf["node"].to_numpy(), pdf["component"].to_numpy()
        hashes = [features(t) for t in texts]
        size = np.array([len(x) for x in hashes])
        common = _common(hashes, left, right)
        i, j = np.nonzero(ok & bound(common, size[left][:, None], size[right][None, :]))
        i, j = left[i], right[j]
        degree = np.bincount(np.r_[i, j], minlength=len(pdf))
        first = np.argsort(-np.maximum(degree[i], degree[j]), kind="stable")  # hubs connect most
        root = {c: c for c in component.tolist()}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for x, y in zip(i[first].tolist(), j[first].tolist()):
            p, q = top(component[x]), top(component[y])
            if p != q and (similar is None or similar(texts[x], texts[y])):
                root[p] = q
                out.append((min(node[x], node[y]), max(node[x], node[y])))
        return pd.DataFrame(out, columns=["a", "b"])

    schema = "band int, value long, lo long, hi long, block long, node long, component long, sk array<long>, size long, signature binary"
    open_ = cut(placed.select(*carried).groupBy(*tile).applyInPandas(waiting, schema), "open-waiting")
    return cut(open_.join(texts, "node").groupBy(*tile).applyInPandas(link, "a long, b long"), "links")


def all_components(pairs: DataFrame, verify, best: int = 2, **options) -> tuple[DataFrame, DataFrame]:
    """Components over all similar pairs that share a value, and the links found: first over
    the neighbours in ``pairs``, then over ``remaining_links``, which takes ``options``."""
    labels, links = verified_components(pairs.where("not end").drop("end"), verify, best)
    more = remaining_links(labels=labels, ends=pairs.where("end").select(F.col("a").alias("value")), **options)
    if more is None or more.limit(1).count() == 0:
        return labels, links
    links = links.unionByName(more)
    return components(links), links
