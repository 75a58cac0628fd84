"""Benchmark decontamination with a positional inverted index that is partitioned by document.

`build_index` turns the documents that a task reads into segments, each a complete inverted index
of some hundred documents: all their terms, and for every term the ascending places where it
stands. Nothing is shuffled, and a term that stands everywhere is spread over all segments. The
test phrases meet every segment as a packed block: of each phrase the term that is rarest in the
segment gives the first list of starts, and the other terms' lists, set off by their place in the
phrase, cut it down from rare to common. Terms are compared as words, so matches are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.bpe import whole_text_batches
from reviewmill.session import scratch_path

SEGMENT_WORDS = 1 << 19
BLOCK_BYTES = 8 << 20  # test text in one packed block
CANDIDATES = 1 << 22  # starts looked at together
# Words are runs of digits, letters (lower-cased if A-Z) and all that is not ASCII.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Phrases:
    """`window` consecutive words of an item are a phrase; `slop` further words may stand between them."""

    window: int = 10
    slop: int = 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


class Terms(dict):
    """Numbers for terms in order of their first use."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def packed_segment(number: int, ids: list, docs: list[np.ndarray], terms: Terms) -> dict:
    """A segment's row. Between two documents one place stays free, so no phrase runs across."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    term = np.concatenate([np.zeros(0, dtype=np.int64), *docs])
    place = np.arange(len(term)) + np.repeat(np.arange(len(docs)), sizes)
    order = np.sort(term << 32 | place)
    return {
        "segment": number,
        "doc_ids": ids,
        "n_words": sizes,
        "first": first.astype(np.int32).tobytes(),
        "terms": b" ".join(terms),
        "counts": np.bincount(term, minlength=len(terms)).astype(np.int32).tobytes(),
        "places": (order & 0xFFFFFFFF).astype(np.int32).tobytes(),
    }


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of `docs` (doc_id, text), written to the shared folder: a row per segment.

    (segment, doc_ids, n_words, first, terms, counts, places): `first` is each document's first
    place; `places` holds the lists of all terms one after the other, `counts` their lengths.
    Null and empty texts are documents without words, repeated rows are documents of their own,
    an empty table gives no segments. A segment ends after SEGMENT_WORDS; a longer text has one alone.
    """
    whole_text_batches(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        ids, kept, terms, total = [], [], Terms(), 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                if ids and total + len(words) > SEGMENT_WORDS:
                    yield pd.DataFrame([packed_segment(number, ids, kept, terms)])
                    number, ids, kept, terms, total = number + 1, [], [], Terms(), 0
                ids.append(doc_id)
                kept.append(np.fromiter(map(terms.__getitem__, words), dtype=np.int64, count=len(words)))
                total += len(words)
        if ids:
            yield pd.DataFrame([packed_segment(number, ids, kept, terms)])

    kind = f"array<{docs.schema['doc_id'].dataType.simpleString()}>"
    path = scratch_path(docs.sparkSession, "index")
    # ids travel as strings: pandas would turn whole numbers beside nulls into floating point
    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        run, "segment long, doc_ids array<string>, n_words array<long>, first binary, terms binary, counts binary, places binary"
    )
    made.withColumn("doc_ids", F.col("doc_ids").cast(kind)).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def phrase_blocks(items: DataFrame, plan: Phrases) -> tuple[DataFrame, int]:
    """(block, test_terms, phrases, lengths, owned, owners, names) and the number of blocks: the distinct phrases of `items`, packed.

    Items are dealt out to blocks of about BLOCK_BYTES of text; there is one block unless the
    test set is larger. Items without words have no phrase; an item of fewer words than the
    window is one. Equal phrases of a block are one row with several owners. A row with null
    item_id has phrases that nobody owns.
    """
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        terms, phrases, names = Terms(), {}, Terms()
        for item_id, text in zip(group["item_id"], group["text"]):
            numbers = [terms[w] for w in words_of(text)]
            k = min(plan.window, len(numbers))
            for i in range(len(numbers) - k + 1 if k else 0):
                owners = phrases.setdefault(tuple(numbers[i : i + k]), set())
                if item_id is not None:
                    owners.add(names[item_id])
        matrix = np.full((len(phrases), plan.window), -1, dtype=np.int32)
        for row, phrase in zip(matrix, phrases):
            row[: len(phrase)] = phrase
        owners = [sorted(o) for o in phrases.values()]
        return pd.DataFrame([{
            "block": group["block"].iloc[0],
            "test_terms": b" ".join(terms),
            "phrases": matrix.tobytes(),
            "lengths": np.array([len(p) for p in phrases], dtype=np.int32).tobytes(),
            "owned": np.array([len(o) for o in owners], dtype=np.int32).tobytes(),
            "owners": np.array([o for own in owners for o in own], dtype=np.int32).tobytes(),
            "names": list(names),
        }])

    schema = "block long, test_terms binary, phrases binary, lengths binary, owned binary, owners binary, names array<string>"
    return dealt.groupBy("block").applyInPandas(pack, schema), n_blocks


class Segment:
    """Lookups in one segment: `keys` are term << 32 | place, ascending."""

    def __init__(self, row):
        ints = lambda raw: np.frombuffer(raw, dtype=np.int32).astype(np.int64)
        self.doc_first = ints(row.first)
        self.n_words = np.asarray(row.n_words, dtype=np.int64)
        self.counts = ints(row.counts)
        self.begin = np.cumsum(self.counts) - self.counts
        self.places = ints(row.places)
        self.keys = np.repeat(np.arange(len(self.counts)) << 32, self.counts) | self.places
        self.terms = {t: i for i, t in enumerate(row.terms.split())}

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        want = term << 32 | place
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (place >= 0) & (self.keys[at] == want)

    def next_place(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The term's first place behind `place`, -1 without one."""
        at = np.searchsorted(self.keys, term << 32 | place + 1)
        inside = at < self.begin[term] + self.counts[term]
        return np.where(inside, self.places[np.minimum(at, len(self.places) - 1)], -1)

    def last_place(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The term's last place before `place`, -1 without one."""
        at = np.searchsorted(self.keys, term << 32 | place) - 1
        return np.where(at >= self.begin[term], self.places[np.maximum(at, 0)], -1)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_first, place, "right") - 1


def matches(segment: Segment, phrases: np.ndarray, lengths: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first place, last place) of all matches; `phrases` holds the segment's term numbers, -1 where it has none."""
    width = phrases.shape[1]
    used = np.arange(width) < lengths[:, None]
    whole = np.flatnonzero(((phrases >= 0) | ~used).all(axis=1) & (lengths > 0))
    counts = np.where(used, segment.counts[np.maximum(phrases, 0)], np.iinfo(np.int64).max)[whole]
    order = np.argsort(counts, axis=1, kind="stable")
    rarest = counts[np.arange(len(whole)), order[:, 0]]
    found = [(np.zeros(0, dtype=np.int64),) * 3]
    cuts = np.flatnonzero(np.diff(np.cumsum(rarest) // CANDIDATES)) + 1
    for rows in np.split(np.arange(len(whole)), cuts):
        n = rarest[rows]
        row = np.repeat(rows, n)
        offset = order[row, 0]
        term = phrases[whole[row], offset]
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        anchor = segment.places[segment.begin[term] + nth]
        found.append(spread(segment, phrases, lengths, whole, row, offset, anchor, slop) if slop else intersected(segment, phrases, lengths, whole, order, row, anchor - offset))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def intersected(segment, phrases, lengths, whole, order, row, start) -> tuple:
    """The starts that stand in all offset-adjusted lists, from the rarest term's to the commonest's."""
    for j in range(1, phrases.shape[1]):
        offset = order[row, j]
        more = j < lengths[whole[row]]
        kept = ~more | segment.has(np.maximum(phrases[whole[row], offset], 0), start + offset)
        row, start = row[kept], start[kept]
    return whole[row], start, start + lengths[whole[row]] - 1


def spread(segment, phrases, lengths, whole, row, offset, anchor, slop) -> tuple:
    """The tightest spans in which all words of a phrase stand in order: none holds another match of its phrase.

    Around each place of the rarest term, the nearest following place of every later word gives
    the least end and the nearest preceding place of every earlier word the greatest start;
    either stops once it is too far away. All tightest spans are among these.
    """
    first, last = anchor.copy(), anchor.copy()
    for step in range(1, phrases.shape[1]):
        for moved, at, reach in ((last, offset + step, segment.next_place), (first, offset - step, segment.last_place)):
            term = phrases[whole[row], np.clip(at, 0, phrases.shape[1] - 1)]
            active = np.flatnonzero((at >= 0) & (at < lengths[whole[row]]))
            moved[active] = reach(term[active], moved[active])
        length = lengths[whole[row]]
        near = (first >= 0) & (last >= 0) & (last - first - length < slop)
        row, offset, first, last = row[near], offset[near], first[near], last[near]
    near = (first >= 0) & (last - first + 1 - lengths[whole[row]] <= slop) & (segment.doc_of(first) == segment.doc_of(last))
    row, first, last = row[near], first[near], last[near]
    order = np.lexsort((-first, last, row))
    row, first, last = row[order], first[order], last[order]
    reached = np.maximum.accumulate(row << 32 | first)
    tight = np.append(np.ones(min(len(row), 1), dtype=bool), np.diff(reached) > 0)
    return whole[row[tight]], first[tight], last[tight]


def find_phrases(index: DataFrame, items: DataFrame, plan: Phrases = Phrases()) -> DataFrame:
    """(segment, doc, spans, items) per document with a match, and block of the test set.

    `spans` are the hit stretches of the document, from word to word and both included, merged
    where they touch; `items` the item_ids, as strings, whose phrases stand there. With a slop
    a phrase also matches where its words stand in order with at most so many words between
    them; all words of the stretch then count as hit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, known = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if block != r.block:
                    ints = lambda raw: np.frombuffer(raw, dtype=np.int32).astype(np.int64)
                    block, owned = r.block, ints(r.owned)
                    known = (r.test_terms.split(), ints(r.phrases).reshape(-1, plan.window), ints(r.lengths), ints(r.owners), np.cumsum(owned) - owned, owned, r.names)
                yield document_matches(r, *known, plan.slop)

    blocks, n_blocks = phrase_blocks(items, plan)
    # every segment meets every block of the stated test set; a single block, of bounded size, is broadcast
    dealt = index.drop("doc_ids").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    if n_blocks == 1:
        blocks = F.broadcast(blocks)
    return dealt.join(blocks, "block").mapInPandas(run, "segment long, doc long, spans array<struct<first:long,last:long>>, items array<string>")


def document_matches(row, terms, phrases, lengths, owners, own_first, owned, names, slop: int) -> pd.DataFrame:
    """The matching documents of one segment."""
    segment = Segment(row)
    numbers = np.array([segment.terms.get(t, -1) for t in terms] + [-1], dtype=np.int64)
    phrase, first, last = matches(segment, numbers[phrases], lengths, slop)
    doc = segment.doc_of(first)
    order = np.lexsort((first, doc))
    phrase, first, last, doc = phrase[order], first[order], last[order], doc[order]
    out = []
    for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
        if not len(part):
            continue
        start = first[part] - segment.doc_first[doc[part[0]]]
        end = np.maximum.accumulate(last[part] - segment.doc_first[doc[part[0]]])
        new = np.append(True, start[1:] > end[:-1] + 1)
        close = np.append(np.flatnonzero(new)[1:] - 1, len(part) - 1)
        spans = [{"first": int(a), "last": int(b)} for a, b in zip(start[new], end[close])]
        held = {names[o] for p in np.unique(phrase[part]) for o in owners[own_first[p] : own_first[p] + owned[p]]}
        out.append((row.segment, int(doc[part[0]]), spans, sorted(held)))
    return pd.DataFrame(out, columns=["segment", "doc", "spans", "items"])


def contaminated_documents(docs: DataFrame, items: DataFrame, plan: Phrases = Phrases()) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) per row of `docs` (doc_id, text); `items` are (item_id, text).

    n_hit counts the document's words inside a match, `spans` says where they stand, `items`
    names the test items, sorted as strings, repeated item_ids once. Null, empty and wordless
    texts have no words and no hits; repeated rows give repeated results; a null doc_id is kept;
    phrases of a null item_id hit words but name no item; without documents there are no rows,
    without items no hits. Other columns of either table are ignored.
    """
    index = build_index(docs.select("doc_id", "text"))
    found = find_phrases(index, items, plan)
    of_doc = found.groupBy("segment", "doc").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words"))).select(
        F.col("segment").alias("_segment"), F.col("pos").cast("long").alias("_doc"), F.col("col.doc_ids").alias("doc_id"), F.col("col.n_words").alias("n_words")
    )
    # spans of different blocks may overlap: a word counts with the first span that reaches it
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto"))
    add = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["last"] - F.greatest(s["first"] - 1, acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], s["last"]).alias("upto")
    )
    joined = rows.join(of_doc, (F.col("_segment") == F.col("segment")) & (F.col("_doc") == F.col("doc")), "left")
    return joined.select(
        "doc_id", "n_words",
        F.coalesce(F.aggregate("spans", start, add, lambda acc: acc["n"]), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<first:long,last:long>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontamination_report(docs: DataFrame, items: DataFrame, plan: Phrases = Phrases()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of `docs`; cases as in `contaminated_documents`."""
    found = contaminated_documents(docs, items, plan)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
