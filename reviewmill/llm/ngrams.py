"""N-gram Jaccard join, size-aware: small sets enumerate subsets, large sets scan inverted lists.

Documents are sets of word n-grams. Two sets of sizes a and b at Jaccard p share at least
p(a+b)/(1+p) elements. A small set emits every subset of the sizes that its possible partners
ask for, so equal keys are links. A large set emits its first elements in one global order, rare
ones first, and the inverted lists of those elements hold all its possible partners. The
boundary is the size from which lists cost less than subsets.

Groups of many near copies never meet as pairs: every list first links its members to one
pivot; lists are then scanned only between components that those links left apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.bpe import whole_text_batches
from reviewmill.operators.components import connected_components
from reviewmill.session import cut_lineage, fits_broadcast, scratch_path

SLOTS = 1 << 16  # counters by which elements are ordered; their number is fixed
KNOWN_WORDS = 200_000
PARITY = 16  # longs of parity bits kept of a set: they tell sets of up to some 4,800 elements apart at 90 %
LIGHT = 1 << 62
PARITIES = [f"p{i}" for i in range(PARITY)]
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Join:
    """What is joined: n-grams of `words` words at Jaccard `percent` / 100 or more."""

    words: int = 5
    percent: int = 80
    seed: int = 0

    def overlap(self, a: int, b: int) -> int:
        """Elements that sets of these sizes must share at least."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def smallest(self, size: int) -> int:
        """The smallest size that can link with this one."""
        return -(-self.percent * size // 100)

    def prefix(self, size: int) -> int:
        """So many first elements hold one that is shared with any partner."""
        return size - self.overlap(size, self.smallest(size)) + 1

    def subset_sizes(self, size: int, largest: int) -> list[int]:
        partners = range(self.smallest(size), min(100 * size // self.percent, largest) + 1)
        return sorted({t for b in partners if (t := self.overlap(size, b)) <= min(size, b)})

    def boundary(self) -> int:
        """The largest small size: up to it, the subsets cost less than the lists.

        A subset costs one row. A list entry costs one row and the check of a candidate, which
        reads a set, so about the set's size.
        """
        size = 1
        while sum(comb(size, t) for t in self.subset_sizes(size, 2 * size + 2)) <= self.prefix(size) * size:
            size += 1
        return size - 1


class Shingler:
    """Hashed n-gram sets of texts; words are hashed once while a bounded table knows them."""

    def __init__(self, join: Join):
        self.join, self.known = join, {}

    def word_hashes(self, text: str) -> np.ndarray:
        words, known, seed = text.encode().translate(LOWER).split(), self.known, self.join.seed
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w, seed)
        out = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(known) > KNOWN_WORDS:
            known.clear()
        return out

    def elements(self, text: str | None) -> np.ndarray:
        """The distinct n-grams, hashed and sorted; with fewer words, the whole sequence as one."""
        hashes = self.word_hashes(text or "")
        k = min(self.join.words, len(hashes))
        if k == 0:
            return hashes
        n = len(hashes) - k + 1
        x = np.full(n, 0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1, dtype=np.uint64)
        for j in range(k):
            x = mixed(x ^ hashes[j : j + n])
        return np.unique(x)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def node_of(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed longs; the first names the set."""
    digest = xxhash.xxh3_128_digest(elements.tobytes())
    high, low = np.frombuffer(digest, dtype="<i8")
    return int(high), int(low)


def parity_of(elements: np.ndarray) -> np.ndarray:
    """PARITY longs: bit b tells whether an odd number of elements falls on it.

    Bits that differ between two sets each stand for at least one element that only one has.
    """
    bits = 64 * PARITY
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Table:
    """Lineage cut by a written table in the shared folder, to be removed once what was made of it is written too."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.rows = self.spark.read.parquet(self.path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def profiled(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, size, node, rest, p0.., slot, n): a row per document, and the element counts by slot.

    A column text_key of `docs` goes along.
    """
    own = ["doc_id", *(["text_key"] if "text_key" in docs.columns else [])]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, counts = Shingler(join), np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingler.elements(text)
                counts += np.bincount((found >> np.uint64(48)).astype(np.int64), minlength=SLOTS)
                rows.append((len(found), *node_of(found), *parity_of(found).tolist()))
            out = pd.DataFrame(rows, columns=["size", "node", "rest", *PARITIES])
            for at, c in enumerate(own):
                out.insert(at, c, batch[c].to_numpy())
            yield out.assign(slot=pd.Series(dtype="Int32"), n=pd.Series(dtype="Int64"))
        slots = np.flatnonzero(counts)
        empty = pd.Series([None] * len(slots), dtype=object)
        yield pd.DataFrame({**dict.fromkeys([*own, "size", "node", "rest", *PARITIES], empty), "slot": slots, "n": counts[slots]})

    schema = f"{kinds}, size int, node long, rest long, {', '.join(f'{p} long' for p in PARITIES)}, slot int, n long"
    return docs.select(*own, "text").mapInPandas(run, schema)


def list_entries(docs: DataFrame, join: Join, counts: np.ndarray) -> DataFrame:
    """(token, node, at): list entries of large sets and subset keys of small ones.

    `at` holds place and size of a list entry, or, above LIGHT, subset size and size of a key.
    Equal sets of one task are entered once.
    """
    border = join.boundary()
    listed = join.smallest(border + 1)
    frequency = docs.sparkSession.sparkContext.broadcast(counts)  # SLOTS numbers

    def keys(found: np.ndarray) -> Iterator[tuple[int, int]]:
        size, total, own = len(found), int(np.bitwise_xor.reduce(mixed(found))), [int(x) for x in mixed(found)]
        for t in join.subset_sizes(size, border):
            for out in combinations(own, size - t):
                rest = total
                for x in out:
                    rest ^= x
                yield rest ^ (t * 0x9E3779B97F4A7C15 & (1 << 64) - 1), LIGHT | t << 32 | size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, order, seen = Shingler(join), frequency.value, set()
        for batch in batches:
            tokens, nodes, ats = [], [], []
            for text in batch["text"]:
                found = shingler.elements(text)
                node = node_of(found)[0]
                if not len(found) or node in seen:
                    continue
                seen.add(node)
                if len(found) >= listed:
                    n = join.prefix(len(found))
                    first = np.lexsort((found, order[(found >> np.uint64(48)).astype(np.int64)]))[:n]
                    tokens.append(found[first])
                    ats.append((np.arange(n) << 32) | len(found))
                    nodes.append(np.full(n, node, dtype=np.int64))
                if len(found) <= border:
                    made = list(keys(found))
                    tokens.append(np.array([k for k, _ in made], dtype=np.uint64))
                    ats.append(np.array([a for _, a in made], dtype=np.int64))
                    nodes.append(np.full(len(made), node, dtype=np.int64))
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "node": np.concatenate(nodes), "at": np.concatenate(ats)})

    return docs.select("text").mapInPandas(run, "token long, node long, at long")


def size_of(at: Column) -> Column:
    return at.bitwiseAND(F.lit((1 << 32) - 1))


def may_link(a: Column, b: Column, join: Join) -> Column:
    """Whether two entries of one list can belong to a linked pair.

    If this element is the first that both share, what follows it bounds their overlap; a
    subset key is itself a part of the overlap.
    """
    place = lambda at: F.shiftright(at, 32).bitwiseAND(F.lit((1 << 30) - 1))
    bound = F.when(a >= LIGHT, place(a)).otherwise(F.least(size_of(a) - place(a), size_of(b) - place(b)))
    least, most = F.least(size_of(a), size_of(b)), F.greatest(size_of(a), size_of(b))
    return (least * 100 >= most * join.percent) & (bound * (100 + join.percent) >= (least + most) * join.percent)


def may_differ_so_little(a: Column, b: Column, join: Join) -> Column:
    """Whether the parity bits of two entries leave room for a link: the differing bits are at most
    the elements that only one of two linked sets may have."""
    differing = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"_{p}"))) for p in PARITIES), F.lit(0))
    return differing * (100 + join.percent) <= (size_of(a) + size_of(b)) * (100 - join.percent)


def as_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def sets_of(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, join: Join, short: bool) -> Table:
    """(node, n, elements) of the nodes of some pairs, from one text of each, read again.

    `short` keeps 16 bits of each element, distinct, in place of the element.
    """
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = cut_lineage(named.join(nodes, "node").select(F.col("min_doc").alias("_id")))
    few = fits_broadcast(ids.count(), 64)
    texts = docs.select("doc_id", "text")
    chosen = texts.join(F.broadcast(ids) if few else ids, texts["doc_id"].eqNullSafe(ids["_id"]), "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(join)
        for batch in batches:
            sets = [shingler.elements(t) for t in batch["text"]]
            kept = [np.unique(s.astype(np.uint16)).view(np.int16) if short else s.view(np.int64) for s in sets]
            yield pd.DataFrame({"node": [node_of(s)[0] for s in sets], "n": [len(s) for s in sets], "elements": kept})

    kind = "short" if short else "long"
    return Table(chosen.mapInPandas(run, f"node long, n int, elements array<{kind}>"), "sets")


def enough_shared(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, join: Join, short: bool) -> DataFrame:
    """The pairs (a, b) whose overlap reaches the threshold; with `short`, those whose overlap may.

    Elements with equal 16 bits count as shared, and so do all that share their bits within one
    set, so the short form never rules out a link.
    """
    written = sets_of(docs, pairs, nodes, join, short)
    sets = written.rows.dropDuplicates(["node"])
    side = lambda k: sets.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"), F.col("elements").alias(f"{k}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_set", "b_set")) + F.col("a_n") - F.size("a_set")
    kept = cut_lineage(both.filter(shared * (100 + join.percent) >= (F.col("a_n") + F.col("b_n")) * join.percent).select("a", "b"))
    written.remove()
    return kept


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """The pairs of nodes whose sets reach the threshold.

    A quarter of each set, 16 bits of every element, moves first and settles nearly all near
    misses; whole sets move for true links and little else.
    """
    return enough_shared(docs, enough_shared(docs, pairs, nodes, join, short=True), nodes, join, short=False)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of linked nodes."""
    return connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def jaccard_groups(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of `docs`.

    component_id is the smallest doc_id reachable by links. Null and empty texts, and texts of
    white space, have no n-grams and link with nothing, not even with each other. Equal sets link
    and are compared once. A row with null doc_id takes part, and has a null component only if
    all of its component has; repeated rows give repeated results, an empty table none. Columns
    other than doc_id and text are ignored.
    """
    return grouped(docs.select("doc_id", "text"), join)


def grouped(docs: DataFrame, join: Join) -> DataFrame:
    """`jaccard_groups` of (doc_id, text) or of (doc_id, text, text_key), with text_key where given."""
    whole_text_batches(docs)
    own = [c for c in docs.columns if c != "text"]
    profile = Table(profiled(docs, join), "profile").rows
    of_docs = profile.filter(F.col("size").isNotNull()).select(*own, "size", "node", "rest", *PARITIES)
    named = of_docs.filter("size > 0").groupBy("node").agg(
        F.min("doc_id").alias("min_doc"), F.min("rest").alias("low"), F.max("rest").alias("high"), *[F.max(p).alias(p) for p in PARITIES]
    )
    nodes = cut_lineage(named)
    if not nodes.filter("low <> high").isEmpty():
        # two different sets share a 64-bit name: name them anew
        return grouped(docs, Join(join.words, join.percent, join.seed + 1))
    parities, nodes = nodes.select("node", *PARITIES), nodes.select("node", "min_doc")
    counts = np.zeros(SLOTS, dtype=np.int64)
    for slot, n in profile.filter(F.col("slot").isNotNull()).groupBy("slot").agg(F.sum("n")).collect():  # SLOTS rows at most
        counts[slot] = n

    entries = Table(list_entries(docs, join, counts), "entries")
    # only tokens that recur go on; copies that two tasks have entered count twice here, and end at node <> pivot below
    recurring = entries.rows.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("token")
    written = Table(entries.rows.join(recurring, "token", "left_semi"), "lists")
    entries.remove()
    live = written.rows
    pivots = live.groupBy("token").agg(F.min("at").alias("pivot_at"), F.min_by("node", "at").alias("pivot"))
    star = live.join(pivots, "token").filter((F.col("node") != F.col("pivot")) & may_link(F.col("at"), F.col("pivot_at"), join))
    tried = cut_lineage(as_pairs(star, "node", "pivot"))
    links = verified(docs, tried, nodes, join)
    found = components(links)

    large = live.filter(F.col("at") < LIGHT).select("token", "node", "at")
    rooted = large.join(found, "node", "left").select("token", "node", "at", F.coalesce("root", "node").alias("root"))
    per_root = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed_lists = cut_lineage(per_root.groupBy("token").agg(F.max_by("root", "n").alias("main"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    apart = Table(rooted.join(mixed_lists.select("token", "main"), "token").join(parities, "node"), "apart")
    written.remove()
    other = apart.rows.filter("root <> main").select("token", *[F.col(c).alias(f"_{c}") for c in ("node", "at", "root", *PARITIES)])
    possible = may_link(F.col("at"), F.col("_at"), join) & may_differ_so_little(F.col("at"), F.col("_at"), join)
    scanned = apart.rows.join(other, "token").filter((F.col("root") != F.col("_root")) & possible)
    rest = cut_lineage(as_pairs(scanned, "node", "_node").join(tried, ["a", "b"], "left_anti"))
    apart.remove()
    more = verified(docs, rest, nodes, join)
    found = components(links.unionByName(more))

    smallest = (
        nodes.join(found, "node", "left")
        .select("node", "min_doc", F.coalesce("root", "node").alias("root"))
    )
    ids = smallest.groupBy("root").agg(F.min("min_doc").alias("component"))
    placed = smallest.join(ids, "root").select("node", "component")
    return of_docs.join(placed, "node", "left").select(
        *own,
        F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The rows of `docs`, with all their columns, that are first of their group.

    A row goes by its doc_id and text together: rows that share the doc_id, or have none either,
    but hold another text stay unless they are near copies themselves.
    """
    key = F.unhex(F.sha2("text", 256))  # null for a null text, which links with nothing
    found = grouped(docs.select("doc_id", "text", key.alias("text_key")), join)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone"), "text_key").distinct()
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.unhex(F.sha2(docs["text"], 256)) == gone["text_key"])
    return docs.join(gone, same, "left_anti")
