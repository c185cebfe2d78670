"""Token ids in patched frame-of-reference blocks.

Documents are range-sorted by doc_id and tokenized in place; a task writes its run of
documents as shards of whole documents, about ``SHARD_IDS`` ids each.  A shard's payload is
binary and self-contained::

    magic 4s | n_ids u64 | n_docs u64 | n_blocks u32
    block index   n_blocks x (offset u32)            start of each block in the body
    document ends n_docs x (u64)                     within the shard
    body          per block: minimum u32, width u8, n_exceptions u16,
                  packed ids (128 x width bits), exception slots u8, exception values u32

A block holds 128 ids less their minimum, packed at the width that fits the
``PERCENTILE`` of them; larger values go to the exception list.  The last block is padded
with its minimum.  Any block can be read alone through the index.

Payloads are the rows of a Parquet table (run, shard, first position, ids), so that
Spark's commit protocol keeps retried and lost tasks from leaving half-written shards, on any
file system that Spark writes.  Starts over all shards follow from sums per run.

Defined cases: a null text is empty and yields the end id alone; null doc_ids come first; rows
that repeat a doc_id follow one another, ordered by a hash of the text; an empty table
writes no shard; texts of any length are encoded whole; the string of a special token in a text becomes that
token's id, as the library's own call has it; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 90
SHARD_IDS = 1 << 20
END_ID = 2


# ---- the format -------------------------------------------------------------------------------


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits needed by each value."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(rows: np.ndarray, w: int) -> np.ndarray:
    """Rows of 128 values as bytes, w bits each, high bits first; eight values fill w bytes."""
    eight = np.ascontiguousarray(rows.reshape(-1, 8).T)
    out = np.empty((w, eight.shape[1]), np.uint8)
    for j in range(w):
        byte = 0
        for i in range(8 * j // w, (8 * j + 7) // w + 1):
            shift = (i + 1) * w - 8 * (j + 1)
            byte = byte | (eight[i] >> np.uint32(shift) if shift >= 0 else eight[i] << np.uint32(-shift))
        out[j] = byte & np.uint32(255)
    return np.ascontiguousarray(out.T).reshape(len(rows), -1)


def unpack(rows: np.ndarray, w: int) -> np.ndarray:
    """The inverse of ``pack``."""
    part = np.ascontiguousarray(rows.reshape(-1, w).T).astype(np.uint64)
    out = np.empty((8, part.shape[1]), np.uint32)
    for i in range(8):
        first, last = i * w // 8, ((i + 1) * w - 1) // 8
        value = part[first]
        for j in range(first + 1, last + 1):
            value = (value << np.uint64(8)) | part[j]
        value = value >> np.uint64(8 * (last + 1) - (i + 1) * w)
        out[i] = value & np.uint64((1 << w) - 1)
    return np.ascontiguousarray(out.T).reshape(len(rows), -1)


def encode_shard(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """Ids (u32) and the end of each document among them, as one payload."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = MAGIC + struct.pack("<QQI", n, len(ends), blocks)
    if not blocks:
        return head + ends.astype("<u8").tobytes()
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[(blocks - 1) * BLOCK :].min()
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(1)
    rest = grid - low[:, None]
    rank = BLOCK * PERCENTILE // 100 - 1
    width = _bits(np.partition(rest, rank, axis=1)[:, rank])
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    n_over = over.sum(1)
    packed_size = BLOCK // 8 * width
    size = 7 + packed_size + 5 * n_over
    offset = np.concatenate([[0], np.cumsum(size)])
    body = np.zeros(offset[-1], np.uint8)

    def put(at: np.ndarray, rows: np.ndarray) -> None:
        body[at[:, None] + np.arange(rows.shape[1])] = rows

    at = offset[:-1]
    put(at, low.astype("<u4").view(np.uint8).reshape(-1, 4))
    body[at + 4] = width
    put(at + 5, n_over.astype("<u2").view(np.uint8).reshape(-1, 2))
    kept = np.where(over, np.uint32(0), rest)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            put(at[which] + 7, pack(kept[which], int(w)))
    block, slot = np.nonzero(over)
    if len(block):
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(n_over)])[block]
        begin = at[block] + 7 + packed_size[block]
        body[begin + nth] = slot
        put(begin + n_over[block] + 4 * nth, rest[block, slot].astype("<u4").view(np.uint8).reshape(-1, 4))
    return head + at.astype("<u4").tobytes() + ends.astype("<u8").tobytes() + body.tobytes()


def decode_shard(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and document ends of a payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block shard")
    n, docs, blocks = struct.unpack_from("<QQI", payload, 4)
    at = np.frombuffer(payload, "<u4", blocks, 24).astype(np.int64)
    ends = np.frombuffer(payload, "<u8", docs, 24 + 4 * blocks).astype(np.int64)
    body = np.frombuffer(payload, np.uint8, offset=24 + 4 * blocks + 8 * docs)
    if not blocks:
        return np.zeros(0, np.uint32), ends

    def get(begin: np.ndarray, length: int) -> np.ndarray:
        return body[begin[:, None] + np.arange(length)]

    low = get(at, 4).copy().view("<u4").ravel()
    width = body[at + 4].astype(np.int64)
    n_over = get(at + 5, 2).copy().view("<u2").ravel().astype(np.int64)
    grid = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            grid[which] = unpack(get(at[which] + 7, BLOCK // 8 * int(w)), int(w))
    block = np.repeat(np.arange(blocks), n_over)
    if len(block):
        nth = np.arange(len(block)) - np.concatenate([[0], np.cumsum(n_over)])[block]
        begin = at[block] + 7 + BLOCK // 8 * width[block]
        grid[block, body[begin + nth]] = get(begin + n_over[block] + 4 * nth, 4).copy().view("<u4").ravel()
    return (grid + low[:, None]).ravel()[:n], ends


def decode_block(payload: bytes, k: int) -> np.ndarray:
    """The k-th block of a payload, found through the block index."""
    n, docs, blocks = struct.unpack_from("<QQI", payload, 4)
    at = struct.unpack_from("<I", payload, 24 + 4 * k)[0] + 24 + 4 * blocks + 8 * docs
    low, w, over = struct.unpack_from("<IBH", payload, at)
    value = unpack(np.frombuffer(payload, np.uint8, BLOCK // 8 * w, at + 7)[None], w)[0].astype(np.int64) if w else np.zeros(BLOCK, np.int64)
    more = at + 7 + BLOCK // 8 * w
    value[np.frombuffer(payload, np.uint8, over, more)] = np.frombuffer(payload, "<u4", over, more + over)
    return (value + low)[: n - k * BLOCK]


# ---- tokenizing -------------------------------------------------------------------------------

#: White space before a space: of ASCII texts, and of all others.
_PAIRS = {ascii_: [chr(c) + " " for c in range(128 if ascii_ else 0x3001) if chr(c).isspace()] for ascii_ in (True, False)}
_SPACES_INSIDE = re.compile(r"(?<=\s) (?=\s|\Z)")
_MODELS: dict[str, CachedTokenizer] = {}


class CachedTokenizer:
    """The library's tokenizer, untouched, with a cache of what it made of pieces of texts.

    A byte-level tokenizer's own pattern always ends a match before a space that follows a non-space,
    and before the last space of a run.  A text without other spaces inside runs of white
    space is therefore split at spaces, and the library encodes a text's new pieces, each with its
    space, in one call; where a token begins with that space, a piece begins.  Other texts, texts that hold an added token's string, and all texts of other kinds
    of tokenizer, are encoded by the library as a whole.
    """

    #: Pieces kept per worker; when the newer half is full, the older one goes, with the pieces not used since.
    MOST = 300_000
    #: How byte-level vocabularies write a space.
    SPACE = "\u0120"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.letter = "H" if self.dtype.itemsize == 2 else "I"
        pre = str(self.tokenizer.pre_tokenizer)
        self.by_piece = pre.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in pre and self.tokenizer.normalizer is None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def raw(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def learn(self, pieces: list[str]) -> None:
        found = self.tokenizer.encode(" " + " ".join(pieces), add_special_tokens=False)
        ids = self.packed(found.ids)
        begins = [self.dtype.itemsize * i for i, t in enumerate(found.tokens) if t[0] == self.SPACE]
        if len(begins) != len(pieces):
            raise ValueError("the tokenizer joins pieces over spaces")
        self.pieces.update(zip(pieces, (ids[a:b] for a, b in zip(begins, [*begins[1:], len(ids)]))))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_piece or any(t in text for t in self.added) or (any(p in text for p in _PAIRS[text.isascii()]) and _SPACES_INSIDE.search(text)):
            return self.raw(text)
        first, *rest = text.split(" ")
        head = self.raw(first) if first else b""
        found = list(map(self.pieces.get, rest))
        if not all(found):  # a piece has one id at least
            new = [k for k, ids in enumerate(found) if ids is None]
            if len(self.pieces) > self.MOST // 2:
                self.pieces, self.older = {}, self.pieces
            wanted = dict.fromkeys(rest[k] for k in new)
            self.pieces.update((p, self.older[p]) for p in wanted if p in self.older)
            if unknown := [p for p in wanted if p not in self.pieces]:
                self.learn(unknown)
            for k in new:
                found[k] = self.pieces[rest[k]]
        return head + b"".join(found)


def tokenizer_at(path: str) -> CachedTokenizer:
    if path not in _MODELS:
        _MODELS[path] = CachedTokenizer(path)
    return _MODELS[path]


# ---- writing and reading ----------------------------------------------------------------------


def write_blocks(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all documents as shards to the shared folder; returns the table of shards."""
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h")

    def run(batches):
        model = tokenizer_at(tokenizer_path)
        end = np.array([end_id], model.dtype).tobytes()
        step = model.dtype.itemsize
        ids, docs, ends, size, shard = [], [], [], 0, 0

        def out():
            data = np.frombuffer(b"".join(ids), model.dtype).astype(np.uint32)
            return pd.DataFrame({"shard": [shard], "doc_ids": [docs], "n_ids": [len(data)], "payload": [encode_shard(data, np.array(ends, np.int64))]})

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                got = model.encode(text or "") + end
                ids.append(got)
                size += len(got) // step
                docs.append(None if pd.isna(doc) else doc)
                ends.append(size)
                if size >= shard_ids:
                    yield out()
                    ids, docs, ends, size, shard = [], [], [], 0, shard + 1
        if docs:
            yield out()

    shards = ordered.select("doc_id", "text").mapInPandas(run, f"shard long, doc_ids array<{kind}>, n_ids long, payload binary")
    return cut(shards.withColumn("run", F.spark_partition_id()), "token-shards")


def shard_starts(shards: DataFrame) -> DataFrame:
    """Position of the first id of every shard: sums per run, then within runs."""
    lengths = shards.select("run", "shard", "n_ids")
    runs = lengths.groupBy("run").agg(F.sum("n_ids").alias("ids"))
    above = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row per writing task
    offset = runs.select("run", F.coalesce(F.sum("ids").over(above), F.lit(0)).alias("offset"))
    within = Window.partitionBy("run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inner = lengths.select("run", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner"))
    return inner.join(offset, "run").select("run", "shard", (F.col("inner") + F.col("offset")).alias("first"))


def read_blocks(shards: DataFrame) -> DataFrame:
    """Per document, from the payloads: (doc_id, start, n_tokens, ids_crc32)."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids, ends = decode_shard(r.payload)
                data = ids.astype("<u4").tobytes()
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pd.DataFrame({
                    "run": r.run, "shard": r.shard, "doc_id": pd.Series(list(r.doc_ids), dtype="object"), "inner": begins,
                    "n_tokens": ends - begins, "ids_crc32": crc,
                })

    read = shards.select("run", "shard", "doc_ids", "payload").mapInPandas(
        run, f"run int, shard long, doc_id {kind}, inner long, n_tokens long, ids_crc32 long"
    )
    return read.join(shard_starts(shards), ["run", "shard"]).select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write and read back; the tokenizer file defaults to the installed byte-level BPE."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return read_blocks(write_blocks(documents, tokenizer_path))


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_token_blocks": op5_token_blocks}
