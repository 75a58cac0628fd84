"""Encoding, decoding and counting against the tokenizers library."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewmill.llm import bpe, counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = [
    "abcdefgh the ing", "  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　", "éüßñçœ ΑΩж汉字語한글🎉😍", "0123456789²½Ⅷ", "'s't'll'd're .,!?-_<|>",
    "\x00\x01​‍﻿�́༌", "<|endoftext|>",
]


def texts():
    rng = random.Random(5)
    made = ["", " ", "a", "<|endoftext|>", "x<|endoftext|>  <|endoftext|>y", "aaaa" * 3000, "ab" * 5000, "汉字" * 2000, "\n" * 3000]
    for _ in range(1500):
        pool = "".join(rng.sample(ALPHABETS, rng.randint(1, 3)))
        made.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 60))))
    return made + ["don't  stop\n\n\tnow 12345 <|endoftext|> they'll" * 20]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_helpers_agree_with_the_library(library):
    encode, count, vocab = bpe.encoder(PATH), counts.counter(PATH), bpe.vocabulary(PATH)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = encode(text)
        assert got.tolist() == want, repr(text)
        assert count(text) == len(want), repr(text)
        assert bpe.decode(got, vocab) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_is_cut_as_in_the_library(library):
    encode = bpe.encoder(PATH)
    for start in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)}" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        if text:
            assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(start)


def test_segment_tree_and_heap_on_random_ranks():
    rng = random.Random(1)
    for _ in range(300):
        k, merges = 4, {}
        for rank in range(rng.randint(0, 25)):
            pair = (rng.randrange(k), rng.randrange(k))
            if pair not in merges:
                merges[pair] = (rank, k)
                k += 1
        merges = {p: (i, m) for i, (p, (_, m)) in enumerate(merges.items())}
        ranks, merged = {a << 32 | b: i for (a, b), (i, _) in merges.items()}, [m for _, m in merges.values()]
        symbols = [rng.randrange(4) for _ in range(rng.choice([5, 40, 400]))]
        plain = list(symbols)
        while found := [(merges[p][0], i) for i, p in enumerate(zip(plain, plain[1:])) if p in merges]:
            _, i = min(found)
            plain[i : i + 2] = [merges[plain[i], plain[i + 1]][1]]
        assert bpe.merge_word(symbols, ranks, merged) == plain
        assert counts.merged_count(symbols, ranks, merged) == len(plain)


def test_documents(spark, library):
    rows = [(1, "hello world", 7), (1, "hello world", 7), (2, None, None), (None, "", 1), (3, "x" * 100_000, 2), (4, "a<|endoftext|>b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = bpe.encode_documents(docs, PATH)
    assert got.columns == docs.columns
    back = got.withColumn("back", bpe.text_of(F.col("ids"), PATH)).withColumn("src", F.lit(1)).collect()
    assert sorted((r.doc_id or -1, r.back[:20], len(r.back)) for r in back) == sorted((i or -1, (t or "")[:20], len(t or "")) for i, t, _ in rows)
    for r, n in ((r, r.n_tokens) for r in counts.count_tokens(docs, PATH).collect()):
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        assert n == len(library.encode(text, add_special_tokens=False).ids) and r.n_bytes == len(text.encode())
        assert r.over_limit == (n > 512)
    empty = docs.limit(0)
    assert bpe.encode_documents(empty, PATH).count() == 0 and counts.count_tokens(empty, PATH).count() == 0


def test_queries_equal_the_library(spark, library):
    import hashlib
    import struct

    from reviewmill.llm.queries import QUERIES, read

    d = "/root/testdata/sf0.001"
    source = {r.doc_id: r.text or "" for r in read(spark, d, "documents").collect()}
    rows = QUERIES["op3_bpe_roundtrip"](spark, d).collect()
    counted = {r.doc_id: r for r in QUERIES["op4_token_counts"](spark, d).collect()}
    assert len(rows) == len(source) == len(counted)
    for r in rows:
        ids = library.encode(source[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) == counted[r.doc_id].n_tokens
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
