"""Alignment of the tokens that two tokenizers make of the same text.

Both tokenizations spell the same bytes, so each is a list of byte ends.  Divide and conquer cuts them
into groups: a common end near the middle of an interval is looked for from its middle token
outwards, each time by bisecting the other list, and both halves are cut in turn; an interval without
one is a group.  The A token and the B token that end a group are linked.

Where neither vocabulary has a token that goes on over the border of a word (something other than white space,
then a space) both always cut there, so a text is split at these borders and a worker keeps what it
has found for a word.  Texts for which that does not hold, and tokenizers for which it does not, are
encoded and aligned as a whole.

Links are counted per pair of ids in one scan, with partial sums per task; a second scan looks up each text's
links.  The counts are broadcast: of two tokens that end together one is a suffix of the other, so
there are no more pairs than suffixes in both vocabularies (``most_pairs``, about half a
million here), whatever the size of the corpus.  Texts are not shuffled.

Defined cases: a null or empty text, and one that the two tokenizers do not both spell out byte by byte, has no
tokens, no groups and zero counts; strings of special tokens are plain text; texts of any length are encoded whole; rows that
repeat a doc_id or a text count each for themselves, in the links too; a null doc_id is kept; of pairs with equal counts all are
best; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word begins at a space or line feed that follows something that no definition counts as white space.
BORDER = re.compile("(?<=[^\\s\u180e\u200b\u2060\ufeff])(?=[ \n])")
#: Where white space stands before a space or line feed, words are found by BORDER only.
DOUBLE = re.compile("[\\s\u180e\u200b\u2060\ufeff][ \n]")
SPACE = "\u2581"


def word_keys(text: str) -> list[str]:
    """The words of a text that begins with a space, each without the one space at its front.

    A key that begins with a line feed is a word itself, and so is one that begins with a space: its word has
    a space or a line feed behind the first space.
    """
    if not DOUBLE.search(text):
        return text[1:].replace("\n", " \n").split(" ")
    return [w if w[0] == "\n" or w[1:2] in (" ", "\n") else w[1:] for w in BORDER.split(text)]


def word_of(key: str) -> str:
    return key if key[:1] in ("\n", " ") and key else " " + key


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which A and which B token end each group, in order.

    The two lists of ends rise and share their last one.  All intervals of one depth are cut together.
    """
    partner = np.full(len(ends_a), -1)
    partner[-1:] = len(ends_b) - 1
    a, z, b, y = (np.array([x]) for x in (0, len(ends_a) - 1, 0, len(ends_b) - 1))  # tokens z and y end together
    while len(a):
        inner = np.flatnonzero((z > a) & (y > b))
        a, z, b, y = a[inner], z[inner], b[inner], y[inner]
        middle = (a + z - 1) // 2
        cut_a, cut_b = np.full(len(a), -1), np.full(len(a), -1)
        left, away = np.arange(len(a)), 0
        while len(left):
            step = (away + 1) // 2 * (1 if away % 2 == 0 else -1)  # 0, -1, 1, -2, 2, ...
            k = middle[left] + step
            inside = left[(k >= a[left]) & (k < z[left])]
            k = middle[inside] + step
            at = np.searchsorted(ends_b, ends_a[k])
            hit = ends_b[at] == ends_a[k]
            cut_a[inside[hit]], cut_b[inside[hit]] = k[hit], at[hit]
            left = left[(cut_a[left] < 0) & (away < 2 * (z[left] - a[left]))]
            away += 1
        cut = np.flatnonzero(cut_a >= 0)
        partner[cut_a[cut]] = cut_b[cut]
        a, z, b, y = (np.concatenate(x) for x in ((a[cut], cut_a[cut] + 1), (cut_a[cut], z[cut]), (b[cut], cut_b[cut] + 1), (cut_b[cut], y[cut])))
    last_a = np.flatnonzero(partner >= 0)
    return last_a, partner[last_a]


# ---- the two tokenizers -----------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """The ids of a byte-level vocabulary of the tokenizers library, with the bytes of each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters = byte_letters()
        size = self.model.get_vocab_size()
        tokens = [self.model.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        pre = str(self.model.pre_tokenizer)
        self.splits = "ByteLevel(add_prefix_space=False" in pre and "use_regex=True" in pre and self.model.normalizer is None

    def ids(self, text: str) -> list[int]:
        """Ids of a text that begins with a space."""
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """The ids of a sentencepiece model that puts a space before the text, with the bytes of each."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        silent = [self.model.is_control(i) or self.model.is_unknown(i) for i in range(len(names))]
        self.bytes = [
            b"" if s else bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, (n, s) in enumerate(zip(names, silent))
        ]
        self.space = self.model.piece_to_id(SPACE)
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}|\\n", n) for n in names)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text[1:], num_threads=1) if len(text) > 1 else [self.space]  # the model adds the first space


class Aligner:
    """Groups and links of texts, with those of words kept."""

    #: Words kept per worker; beyond them the half that is used most stays.
    MOST = 700_000
    #: Characters of texts whose new words are learnt together.
    CHUNK = 1 << 21
    #: Words encoded in one call.
    AT_ONCE = 1000

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.by_word = self.a.splits and self.b.splits
        self.size_b = len(self.b.bytes)
        self.length = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        self.names_size = max(len(self.a.bytes), self.size_b)
        # An id and what follows it: more of its side, the other side, the next group.
        self.names = np.array([f"{i}{mark}" for mark in ",|;" for i in range(self.names_size)], dtype=object)
        self.known: dict[str, int] = {}  # -1: a word that they do not spell out
        self.groups: list[str] = []
        self.numbers = np.zeros((1024, 2), np.int64)  # A and B tokens of a word
        self.first = np.zeros(1025, np.int64)  # where its links begin
        self.links = np.zeros(4096, np.int64)
        self.uses = np.zeros(1024, np.int64)

    def most_pairs(self) -> int:
        """Tokens that end together: one is a suffix of the other."""
        return sum(map(len, self.a.bytes)) + sum(map(len, self.b.bytes))

    def full(self) -> bool:
        return len(self.known) > self.MOST

    def shrink(self) -> None:
        """Keep the half of the words that is used most; numbers of words change."""
        n = len(self.groups)
        kept = np.sort(np.argsort(-self.uses[:n], kind="stable")[: self.MOST // 2])
        words = sorted((k, w) for w, k in self.known.items() if k >= 0)
        self.known = {words[k][1]: i for i, k in enumerate(kept.tolist())}
        self.groups = [self.groups[k] for k in kept.tolist()]
        size = np.diff(self.first[: n + 1])
        take = np.repeat(np.isin(np.arange(n), kept), size)
        self.links = self.links[: self.first[n]][take]
        self.numbers, self.uses = self.numbers[kept], np.zeros(len(kept), np.int64)
        self.first = np.r_[0, np.cumsum(size[kept])]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both of a text that begins with a space; None if they do not spell its bytes."""
        a, b = self.a.ids(text), self.b.ids(text)
        data = text.encode("utf-8", "replace")
        if b"".join([self.a.bytes[i] for i in a]) != data or b"".join([self.b.bytes[i] for i in b]) != data:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return (a, b) if self.length[0][a].all() and self.length[1][b].all() else None

    def aligned(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return a, b, *align(np.cumsum(self.length[0][a]), np.cumsum(self.length[1][b]))

    def spelled(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings that, joined, spell all groups, each with a semicolon after it; and where each group's begin."""
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        ends = np.cumsum(size_a + size_b)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(ends - size_b - last_a - 1, size_a)] = a + mark_a * self.names_size
        out[np.arange(len(b)) + np.repeat(ends - last_b - 1, size_b)] = b + mark_b * self.names_size
        return self.names[out], np.r_[0, ends]

    def learn(self, keys: list[str]) -> None:
        """Encode new words together and align them as one interval; those that end in white space one by one."""
        odd = [w for w in keys if not w or w[-1].isspace() or SPACE in w]
        plain = set(keys).difference(odd)
        for these in [list(plain)] * bool(plain) + [[w] for w in odd]:
            if not self.learn_all(these):
                for w in these:
                    if len(these) == 1 or not self.learn_all([w]):
                        self.known[w] = -1

    def learn_all(self, keys: list[str]) -> bool:
        words = list(map(word_of, keys))
        parts = [self.ids(" a")]  # each part follows a word
        lead = tuple(map(len, parts[0]))
        for k in range(0, len(words), self.AT_ONCE):
            found = self.ids(" a" + "".join(words[k : k + self.AT_ONCE]))
            if found is None:
                return False
            parts.append((found[0][lead[0] :], found[1][lead[1] :]))
        a, b, last_a, last_b = self.aligned(*(np.concatenate(x) for x in zip(*parts)))
        word_ends = np.cumsum([2, *(len(w) if w.isascii() else len(w.encode("utf-8", "replace")) for w in words)])
        group_ends = np.cumsum(self.length[0][a])[last_a]
        last = np.searchsorted(group_ends, word_ends)
        if last[-1] >= len(group_ends) or (group_ends[last] != word_ends).any():
            return False
        k, m = len(self.groups), len(words)
        at = self.first[k]
        codes = (a[last_a] * self.size_b + b[last_b])[last[0] + 1 :]
        self.numbers, self.first, self.uses = (grown(x, k + m + 1) for x in (self.numbers, self.first, self.uses))
        self.links = grown(self.links, at + len(codes))
        self.links[at : at + len(codes)] = codes
        self.first[k + 1 : k + m + 1] = at + (last[1:] - last[0])
        self.numbers[k : k + m] = np.stack([np.diff(last_a[last]), np.diff(last_b[last])], axis=1)
        self.uses[k : k + m] = 0
        strings, begins = self.spelled(a, b, last_a, last_b)
        strings, at_word = strings.tolist(), begins[last + 1].tolist()
        self.groups += ["".join(strings[x:y])[:-1] for x, y in zip(at_word, at_word[1:])]
        self.known.update(zip(keys, range(k, k + m)))
        return True

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, which begins with a space, the numbers of the kept words that make it up."""
        split = list(map(word_keys, texts))
        found = [list(map(self.known.get, keys)) for keys in split]
        new: dict[str, None] = {}
        open_ = [(keys, numbers) for keys, numbers in zip(split, found) if None in numbers]
        for keys, numbers in open_:
            new.update(dict.fromkeys([w for w, k in zip(keys, numbers) if k is None]))
        if new:
            self.learn(list(new))
        for keys, numbers in open_:
            numbers[:] = [self.known[w] if k is None else k for w, k in zip(keys, numbers)]
        out = [np.array(numbers, np.int64) for numbers in found]
        if out:
            used = np.concatenate(out)
            self.uses[: len(self.groups)] += np.bincount(used[used >= 0], minlength=len(self.groups))
        return out

    def of_text(self, text: str) -> tuple[int, int, str, np.ndarray] | None:
        """A and B tokens, groups and links of a text aligned as a whole."""
        found = self.ids(text)
        if found is None:
            return None
        a, b, last_a, last_b = done = self.aligned(*found)
        return len(a), len(b), "".join(self.spelled(*done)[0])[:-1], a[last_a] * self.size_b + b[last_b]

    def of_words(self, words: np.ndarray) -> tuple[int, int, str]:
        return *self.numbers[words].sum(0).tolist(), ";".join(map(self.groups.__getitem__, words.tolist()))


def grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros((2 * n - len(x), *x.shape[1:]), x.dtype)])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


# ---- the operator -----------------------------------------------------------------------------


def chunks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Rows in order, about ``most`` characters of text at once."""
    for pdf in batches:
        part = np.cumsum(pdf["text"].str.len().fillna(0).to_numpy(np.int64)) // most
        for _, rows in pdf.groupby(part, sort=True):
            yield rows


def link_counts(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n): how often the ids of A and B are linked over all texts."""

    def count(batches: Iterator[pd.DataFrame]):
        model = aligner(path_a, path_b)
        seen = np.zeros(1024, np.int64)  # occurrences of each kept word
        sums: dict[int, int] = {}

        def add(codes: np.ndarray, n: np.ndarray | None = None) -> None:
            codes, at = np.unique(codes, return_inverse=True)
            for c, x in zip(codes.tolist(), np.bincount(at, n).astype(np.int64).tolist()):
                if x:
                    sums[c] = sums.get(c, 0) + x

        def use_up() -> None:
            k = min(len(model.groups), len(seen))
            add(model.links[: model.first[k]], np.repeat(seen[:k], np.diff(model.first[: k + 1])))
            seen[:] = 0

        for pdf in chunks(batches, model.CHUNK):
            texts = [" " + t for t in pdf["text"] if t]
            if model.full():
                use_up()
                model.shrink()
            found = model.numbered(texts) if model.by_word else [np.array([-1])] * len(texts)
            whole = [k for k, words in enumerate(found) if words.min() < 0]
            for k in whole:
                if (done := model.of_text(texts[k])) is not None:
                    add(done[3])
                found[k] = found[k][:0]
            if found:
                n = len(model.groups)
                seen = grown(seen, n)
                seen[:n] += np.bincount(np.concatenate(found), minlength=n)
        use_up()
        codes, n = (np.fromiter(x, np.int64, len(sums)) for x in (sums, sums.values()))
        yield pd.DataFrame({"a": codes // model.size_b, "b": codes % model.size_b, "n": n})

    return documents.select("text").mapInPandas(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


class Counts:
    """Counts of pairs and whether each is its B id's highest, for arrays of codes."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, best: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.n, self.best = codes[order], n[order], best[order]

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.codes):
            return np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        there = self.codes[at] == codes  # a worker may keep words of other tables
        return self.best[at] & there, self.n[at] * there


def align_documents(documents: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every (doc_id, text).

    ``groups`` spells the groups out as ``a1,a2|b1;a3|b2,b3``.  ``n_best`` counts the links whose pair is its B id's
    most frequent one in all texts, ``count_sum`` adds up the counts of a text's links.  The tokenizers' files
    default to the installed byte-level BPE and sentencepiece BPE.
    """
    import public_tokenizers

    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    kind = documents.schema["doc_id"].dataType.simpleString()
    most = F.max("n").over(Window.partitionBy("b"))
    pairs = link_counts(documents, path_a, path_b).select("a", "b", "n", (F.col("n") == most).alias("best")).toPandas()
    model = aligner(path_a, path_b)
    if len(pairs) > model.most_pairs():
        raise ValueError("more pairs than the two vocabularies allow")
    codes = pairs["a"].to_numpy(np.int64) * model.size_b + pairs["b"].to_numpy(np.int64)
    shared = documents.sparkSession.sparkContext.broadcast((codes, pairs["n"].to_numpy(np.int64), pairs["best"].to_numpy(bool)))

    def look_up(batches: Iterator[pd.DataFrame]):
        model = aligner(path_a, path_b)
        counts = Counts(*shared.value)
        done = 0  # kept words whose sums are known
        sums = np.zeros((1024, 3), np.int64)  # links, best links and counts of each kept word
        for pdf in chunks(batches, model.CHUNK):
            texts = [" " + t if t else "" for t in pdf["text"]]
            full = [k for k, t in enumerate(texts) if t]
            if model.full():
                model.shrink()
                done = 0
            found = dict(zip(full, model.numbered([texts[k] for k in full]) if model.by_word else [np.array([-1])] * len(full)))
            n = len(model.groups)
            if n > done:
                sums = grown(sums, n)
                begin = model.first[done:n]
                best, count = counts.of(model.links[begin[0] : model.first[n]])
                sums[done:n, 0] = np.diff(model.first[done : n + 1])
                sums[done:n, 1] = np.add.reduceat(best.astype(np.int64), begin - begin[0])
                sums[done:n, 2] = np.add.reduceat(count, begin - begin[0])
                done = n
            out = []
            for k, doc in enumerate(pdf["doc_id"]):
                row = (0, 0, "", (0, 0, 0))
                if k in found and found[k].min() >= 0:
                    row = (*model.of_words(found[k]), sums[found[k]].sum(0).tolist())
                elif k in found and (whole := model.of_text(texts[k])) is not None:
                    best, count = counts.of(whole[3])
                    row = (*whole[:3], (len(count), int(best.sum()), int(count.sum())))
                out.append((None if pd.isna(doc) else doc, *row[:2], row[2].count("|"), *row[3], row[2]))
            yield frame(out)

    def frame(rows):
        pdf = pd.DataFrame(rows, columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
        return pdf.assign(doc_id=pd.Series([r[0] for r in rows], dtype="object"))

    counts = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return documents.select("doc_id", "text").mapInPandas(look_up, f"doc_id {kind}, {counts}, groups string")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"),
    )


QUERIES = {"op13_token_alignment": op13_token_alignment}
