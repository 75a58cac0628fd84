"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

The helpers here follow a tokenizer file of the usual JSON form (byte-level BPE). A text is
cut at special strings, then into words by the file's pattern; the words' bytes are merged.
Spark deals the rows out; a Python worker keeps one vocabulary, a task a bounded word cache.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how byte-level files cut text into words, with the classes L (letters), N (numbers)
# and S (white space) still to be filled in.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
CACHED_WORDS, CACHED_CHARS = 100_000, 40  # each of two generations
FAN = 16
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def whole_text_batches(df: DataFrame) -> None:
    """Whole texts can be long: Python gets few of them at a time, whatever their length."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if Latin-1 shows it, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def word_finder() -> Callable[[str], list[str]]:
    """Cuts a text into words. Text of Latin-1 characters, by far the most common, goes to the
    standard matcher with the classes spelled out, which is faster; the words are the same."""
    latin = "".join(map(chr, range(256)))
    general = narrow = WORD
    for name, prop in (("{L}", r"\p{L}"), ("{N}", r"\p{N}"), ("{S}", r"\p{White_Space}")):
        general = general.replace(name, prop)
        narrow = narrow.replace(name, re.escape("".join(regex.findall(prop, latin))))
    general, narrow = regex.compile(general).findall, re.compile(narrow).findall
    return lambda text: narrow(text) if text.isascii() or max(text) <= "\xff" else general(text)


class Vocabulary:
    """A byte-level tokenizer file: ids of the bytes, merge ranks, special strings, bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.byte_ids = [ids[letters[b]] for b in range(256)]
        #: pair of ids, as first << 32 | second -> rank; rank -> id of the merged pair
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {letter: b for b, letter in letters.items()}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.words = word_finder()
        cut = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.split = re.compile(f"({cut})").split if cut else lambda text: [text]

    def parts(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """The stretches of a text in order: (id, []) of a special string, else (None, words)."""
        for part in self.split(text):
            if part in self.special:
                yield self.special[part], []
            elif part:
                yield None, self.words(part)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class WordCache(dict):
    """What `make` gives for a word. Two generations of bounded size: a full one becomes the old
    one, from which words still in use come back. Long words are not kept."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


def merge_word(ids: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge until no adjacent pair has a rank.

    Leaf i of a segment tree with FAN children a node holds rank * n + i of the pair that starts
    at i. The root is the lowest rank and, among equals, the leftmost; a merge changes three
    leaves and what is above them. Up to FAN + 1 symbols the leaves hang from the root itself.
    """
    n = len(ids)
    if n < 2:
        return ids
    ids, none, rank_of = list(ids), 1 << 62, ranks.get
    leaves = [none if (r := rank_of(a << 32 | b)) is None else r * n + i for i, (a, b) in enumerate(zip(ids, ids[1:]))]
    root = min(leaves)
    if root == none:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    top, upper = levels[-1], levels[1:]

    def lift(i: int) -> None:
        below = leaves
        for level in upper:
            i //= FAN
            least = min(below[i * FAN : i * FAN + FAN])
            if level[i] == least:
                return
            level[i] = least
            below = level

    while root != none:
        i = root % n
        j = after[i]
        left = ids[i] = merged[root // n]
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            leaves[i] = none if (r := rank_of(left << 32 | ids[k])) is None else r * n + i
            leaves[j] = none
        else:
            leaves[i] = none
        h = before[i]
        if h >= 0:
            leaves[h] = none if (r := rank_of(ids[h] << 32 | left)) is None else r * n + h
        if upper:
            for changed in (h, i, j):
                if 0 <= changed < n - 1:
                    lift(changed)
        root = min(top)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, unsigned 32-bit integers; its word cache ends with the task that asked for it."""
    vocab = vocabulary(path)
    byte_ids, ranks, merged = vocab.byte_ids, vocab.ranks, vocab.merged

    def make(word: str) -> bytes:
        return array("I", merge_word([byte_ids[b] for b in word.encode()], ranks, merged)).tobytes()

    found = WordCache(make).__getitem__

    def encode(text: str) -> np.ndarray:
        out = [array("I", [i]).tobytes() if i is not None else b"".join(map(found, words)) for i, words in vocab.parts(text)]
        return np.frombuffer(b"".join(out), dtype=np.uint32)

    return encode


def decode(ids, vocab: Vocabulary) -> str:
    """Bytes of the ids as text; broken UTF-8 becomes U+FFFD, unknown ids add nothing."""
    known = vocab.bytes_of
    return b"".join([known.get(i, b"") for i in ids.tolist()]).decode("utf-8", errors="replace")


def token_ids(text: Column, path: str) -> Column:
    """array<int> of a text's ids; null counts as empty."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path)
        for texts in batches:
            yield pd.Series([encode(t or "").view(np.int32) for t in texts], dtype=object)

    return run(text)


def text_of(ids: Column, path: str) -> Column:
    """The text that ids stand for, special strings included; null counts as no ids."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path)
        for rows in batches:
            yield pd.Series(["" if ids is None else decode(ids, vocab) for ids in rows], dtype=object)

    return run(ids)


def checked_ids(text: Column, path: str) -> Column:
    """struct<ids, n_tokens, round_trip>: a text's ids, and whether they decode to it. One pass, so one Python worker a task."""

    @F.pandas_udf("ids array<int>, n_tokens long, round_trip boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode, vocab = encoder(path), vocabulary(path)

        def checked(text: str | None) -> tuple[np.ndarray, int, bool]:
            ids = encode(text or "")
            return ids.view(np.int32), len(ids), decode(ids, vocab) == (text or "")

        for texts in batches:
            yield pd.DataFrame([checked(t) for t in texts], columns=["ids", "n_tokens", "round_trip"])

    return run(text)


def encode_and_check(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of each row; cases as in `encode_documents`."""
    whole_text_batches(docs)
    return docs.select("doc_id", checked_ids(F.col("text"), path).alias("_ids")).select("doc_id", "_ids.*")


def round_trip_digest(text: Column, path: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256>: a text encoded, and decoded from its ids.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the
    decoded text in UTF-8.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode, vocab = encoder(path), vocabulary(path)

        def digests(text: str | None) -> tuple[int, str, str]:
            ids = encode(text or "")
            return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, vocab).encode()).hexdigest()

        for texts in batches:
            yield pd.DataFrame([digests(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with a column `ids` in place of one of that name.

    Every row is encoded whole and on its own, so repeated rows give repeated results; null and
    empty texts give empty lists, other columns stay, an empty table gives no rows. `path` names
    the vocabulary file on every executor.
    """
    whole_text_batches(docs)
    return docs.withColumn("ids", token_ids(F.col("text"), path))


def verify_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, encoded and decoded in one pass; cases as above."""
    whole_text_batches(docs)
    return docs.select("doc_id", round_trip_digest(F.col("text"), path).alias("_trip")).select("doc_id", "_trip.*")
