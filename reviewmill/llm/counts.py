"""Token counts by byte-pair merging with a heap and a linked list; no ids are made."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.bpe import WordCache, vocabulary, whole_text_batches


def merged_count(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> int:
    """Symbols left when no adjacent pair has a rank: their first number less the merges made.

    The heap holds rank * n + start of adjacent pairs, also outdated ones; a popped pair counts
    if both symbols still stand there and still have that rank.
    """
    n, rank_of = len(symbols), ranks.get
    heap = [r * n + i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(a << 32 | b)) is not None]
    if not heap:
        return n
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heapify(heap)
    left = n
    while heap:
        rank, i = divmod(heappop(heap), n)
        j = after[i]
        if j >= n or symbols[i] < 0 or rank_of(symbols[i] << 32 | symbols[j]) != rank:
            continue
        new = symbols[i] = merged[rank]
        symbols[j] = -1
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := rank_of(new << 32 | symbols[k])) is not None:
                heappush(heap, r * n + i)
        h = before[i]
        if h >= 0 and (r := rank_of(symbols[h] << 32 | new)) is not None:
            heappush(heap, r * n + h)
    return left


def counter(path: str) -> Callable[[str], int]:
    vocab = vocabulary(path)
    byte_ids, ranks, merged = vocab.byte_ids, vocab.ranks, vocab.merged
    found = WordCache(lambda word: merged_count([byte_ids[b] for b in word.encode()], ranks, merged)).__getitem__

    def count(text: str) -> int:
        return sum(1 if i is not None else sum(map(found, words)) for i, words in vocab.parts(text))

    return count


def token_count(text: Column, path: str) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for texts in batches:
            yield pd.Series([count(t or "") for t in texts], dtype="int64")

    return run(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, whole texts.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated results, an empty
    table none; other columns are ignored. `path` names the vocabulary file on every executor.
    """
    whole_text_batches(docs)
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
