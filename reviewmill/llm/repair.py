"""Conversation repair: the cheapest edits by dynamic programming over a grammar.

A conversation becomes a string of symbols, one per row, of its role and fault. Re-Pair rules
name frequent pairs of symbols over all conversations, so the strings shrink. Every symbol has a
transfer matrix: from each state of the wished role order to each other, the least cost and the
least audit at that cost. The matrix of a rule is the min-plus product of those of its two
symbols, made once, from the bottom up, and shared by all conversations; a conversation's own
product is taken over its few symbols, halves first. Audits are ropes, so a product joins them
without copying.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.session import scratch_path

SPACE = r"[\x20\x09-\x0D]"
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
# Costs of the edits.
REROLE, DELETE, INSERT, UNMENDED = 2, 3, 2, 1
# States: nothing yet, after system, after user, after assistant. Accepted: the first and the last.
STATES, ACCEPTED = 4, (0, 3)
EMITS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
MUST_GO = "d"
TASK_ROWS = 5_000  # conversations whose products one task makes
ROUNDS, PAIRS_A_ROUND = 8, 8  # rules of the grammar at most: their product; more or fewer change no result
RULE = 0x4E00  # code point of the first rule's symbol
HASH_BASE, HASH_MOD = 1_000_003, (1 << 127) - 1
LEAF = 48  # characters up to which a rope is a plain string


# --- damage -----------------------------------------------------------------------------------


def spaced(c: str) -> Column:
    """A column as text, one space for null."""
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the planted faults: rows dropped, emptied, cut, repeated, given to the user."""
    code = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "utf-8")) % 20
    rows = conversations.select("conv_id", "turn", code.alias("_code"), spaced("role").alias("_role"), spaced("text").alias("_text")).filter("_code <> 0")
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("_code") == 4, "user").otherwise(F.col("_role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


# --- faults -----------------------------------------------------------------------------------


def faulted_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, fault, symbol, new_turn, illegal) per row of `rows` (conv_id, turn, role, text).

    Rows stand by turn, nulls first, then role and text. One exchange by conv_id serves all three
    windows; they spill, so a long conversation needs no memory of its size.
    """
    copies = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "_nth")
    dealt = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text")).repartition("conv_id")
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.col("_nth") > 1, DUPLICATE)
        .when(~F.col("text").rlike(rf"[.!?]{SPACE}*\z"), TRUNCATED)
    )
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin(*EMITS), initial).otherwise("x")
    symbol = F.when(F.col("fault").isin(BLANK, DUPLICATE), MUST_GO).when(F.col("fault") == TRUNCATED, F.upper(known)).otherwise(known)
    before = F.lag(initial).over(order)
    return (
        dealt.withColumn("_nth", F.row_number().over(copies))
        .withColumn("fault", fault)
        .select(
            "conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "turn", "role", "text", "fault", symbol.alias("symbol"),
            (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("new_turn"),
            (before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")).alias("illegal"),
        )
    )


def conversation_facts(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, sequence) from `faulted_rows`; a symbol a row in `sequence`."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "symbol")))
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in (BLANK, DUPLICATE, TRUNCATED)],
        F.count_if("illegal").alias("illegal"),
        F.array_join(F.transform(ordered, lambda r: r["symbol"]), "").alias("sequence"),
    )


# --- grammar ----------------------------------------------------------------------------------


def rewritten(sequence: Column, rules: list[tuple[str, str]]) -> Column:
    """A sequence with each rule's pair replaced, from the left, rule by rule."""
    for number, (a, b) in enumerate(rules):
        sequence = F.replace(sequence, F.lit(a + b), F.lit(chr(RULE + number)))
    return sequence


def pair_rules(sequences: DataFrame) -> list[tuple[str, str]]:
    """Re-Pair rules over all `sequences`: in each round the most frequent pairs of adjacent symbols become new symbols.

    Pairs are counted in the tasks before they move; a count is of symbols of a bounded alphabet.
    A pair whose first symbol ends another pair of the round waits for the next one.
    """
    rules: list[tuple[str, str]] = []
    for _ in range(ROUNDS):
        symbols = F.split(rewritten(F.col("sequence"), rules), "")
        pairs = F.zip_with(symbols, F.slice(symbols, 2, F.greatest(F.size(symbols) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
        counted = sequences.select(F.explode(pairs).alias("pair")).filter(F.length("pair") == 2).groupBy("pair").count()
        best = counted.filter("count > 1").orderBy(F.desc("count"), "pair").limit(PAIRS_A_ROUND).collect()  # a few pairs
        taken: list[str] = []
        for r in best:
            if not any(r.pair[0] == p[1] or r.pair[1] == p[0] for p in taken):
                taken.append(r.pair)
        if not taken:
            break
        rules += [(p[0], p[1]) for p in taken]
    return rules


# --- ropes and matrices -----------------------------------------------------------------------

# A rope is (length, hash, text) or (length, hash, left, right).
EMPTY = (0, 0, "")


def letter(c: str) -> tuple:
    return (1, ord(c), c)


@lru_cache(maxsize=4096)
def shift(length: int) -> int:
    return pow(HASH_BASE, length, HASH_MOD)


def joined(left: tuple, right: tuple) -> tuple:
    if not left[0]:
        return right
    if not right[0]:
        return left
    length, digest = left[0] + right[0], (left[1] * shift(right[0]) + right[1]) % HASH_MOD
    return (length, digest, left[2] + right[2]) if length <= LEAF else (length, digest, left, right)


def flat(rope: tuple) -> str:
    out, todo = [], [rope]
    while todo:
        top = todo.pop()
        if len(top) == 3:
            out.append(top[2])
        else:
            todo += (top[3], top[2])
    return "".join(out)


def less(a: tuple, b: tuple) -> bool:
    """Whether rope a is before rope b; equal stretches are skipped by length and hash."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y or (x[0] == y[0] and x[1] == y[1]):
            continue
        if len(x) == 4 and (x[0] >= y[0] or len(y) == 3):
            left += (x[3], x[2])
            right.append(y)
        elif len(y) == 4:
            right += (y[3], y[2])
            left.append(x)
        else:
            n = min(x[0], y[0])
            if x[2][:n] != y[2][:n]:
                return x[2][:n] < y[2][:n]
            for stack, rope in ((left, x), (right, y)):
                if rope[0] > n:
                    rest = EMPTY
                    for c in rope[2][n:]:
                        rest = joined(rest, letter(c))
                    stack.append(rest)
    return bool(right) and not left


# A matrix is a tuple of STATES * STATES entries, (cost, rope) or None.


def cheaper(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def product(left: tuple, right: tuple) -> tuple:
    """Min-plus product. Of equal costs the least audit stays: two audits of the same rows and
    cost are never one the other's beginning, so what follows keeps their order."""
    out = []
    for i in range(0, STATES * STATES, STATES):
        row = [(m, e) for m, e in enumerate(left[i : i + STATES]) if e is not None]
        for j in range(STATES):
            best = None
            for m, e in row:
                f = right[m * STATES + j]
                if f is not None and (best is None or e[0] + f[0] <= best[0]):
                    best = cheaper(best, (e[0] + f[0], joined(e[1], f[1])))
            out.append(best)
    return tuple(out)


def insertions() -> tuple:
    """Any number of inserted rows, none first."""
    found: dict[tuple[int, int], tuple] = {(i, i): (0, EMPTY) for i in range(STATES)}
    for _ in range(STATES):
        for (i, m), (cost, rope) in list(found.items()):
            for moves in (EMITS["u"], EMITS["a"]):
                if m in moves:
                    new = (cost + INSERT, joined(rope, letter("I")))
                    found[i, moves[m]] = cheaper(found.get((i, moves[m])), new)
    return tuple(found.get((i, j)) for i in range(STATES) for j in range(STATES))


def row_matrix(symbol: str) -> tuple:
    """What can be done with one row, after any insertions before it."""
    options: dict[tuple[int, int], tuple] = {(i, i): (DELETE, letter("D")) for i in range(STATES)}
    extra = UNMENDED if symbol.isupper() else 0
    if symbol != MUST_GO:
        ways = [("R", REROLE, "u"), ("R", REROLE, "a")] + [("K", 0, symbol.lower())] * (symbol.lower() in EMITS)
        for name, cost, role in ways:
            for i, j in EMITS[role].items():
                options[i, j] = cheaper(options.get((i, j)), (cost + extra, letter(name)))
    own = tuple(options.get((i, j)) for i in range(STATES) for j in range(STATES))
    return product(insertions(), own)


def grammar_matrices(rules: list[tuple[str, str]]) -> dict[str, tuple]:
    """A matrix for every symbol, rules from the bottom up; ropes share their parts."""
    known = {s: row_matrix(s) for s in "suaxSUAX" + MUST_GO}
    for number, (a, b) in enumerate(rules):
        known[chr(RULE + number)] = product(known[a], known[b])
    return known


def whole_product(symbols: str, known: dict[str, tuple]) -> tuple:
    """The product over a string of symbols, halves first, so that ropes stay shallow."""
    parts = [known[s] for s in symbols]
    while len(parts) > 1:
        pairs = [product(a, b) for a, b in zip(parts[::2], parts[1::2])]
        parts = pairs + parts[2 * len(pairs) :]
    return parts[0]


def cheapest(symbols: str, known: dict[str, tuple]) -> tuple[int, str]:
    """(cost, audit) of a conversation."""
    if not symbols:
        return 0, ""
    full = product(whole_product(symbols, known), insertions())
    best = None
    for j in ACCEPTED:
        best = cheaper(best, full[j])
    return best[0], flat(best[1])


def repairs(facts: DataFrame) -> DataFrame:
    """`facts` with cost and audit: the cheapest edits of each conversation."""
    rules = pair_rules(facts.select("sequence"))
    known = grammar_matrices(rules)

    @F.pandas_udf("cost long, audit string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sequences in batches:
            yield pd.DataFrame([cheapest(s, known) for s in sequences], columns=["cost", "audit"])

    # a conversation is few bytes and much arithmetic, so tasks go by rows
    spread = facts.repartition(facts.count() // TASK_ROWS + 1)
    return spread.withColumn("_edits", run(rewritten(F.col("sequence"), rules))).select("*", "_edits.*").drop("_edits")


# --- repaired rows ----------------------------------------------------------------------------


class Repairer:
    """Applies an audit to the rows of one conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def emit(self, role: str) -> None:
        self.state = EMITS[role][self.state]

    def wanted(self) -> str:
        """The role that a row made or changed here has."""
        return "a" if self.state == 2 else "u"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            role = self.wanted()
            self.emit(role)
            yield ("user" if role == "u" else "assistant"), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.emit(role[0])
            yield role, text
        elif edit == "R":
            made = self.wanted()
            self.emit(made)
            yield ("user" if made == "u" else "assistant"), text


def repaired_turns(rows: DataFrame, mended: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows after the edits, a conversation's in order and in one partition.

    The audit comes as a row ahead of its conversation's, and the sorted partition is read as a
    stream, so a conversation is never held as a whole.
    """
    audits = mended.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = audits.unionByName(rows.select("conv_id", "place", "role", "text"))
    # conv_id goes through pandas as text: whole numbers beside nulls would become floating point
    dealt = stream.repartition("conv_id").sortWithinPartitions("conv_id", "place").withColumn("conv_id", F.col("conv_id").cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, repairer, place = None, None, 0
        for batch in batches:
            out = []
            for conv_id, at, role, text in batch.itertuples(index=False):
                if at == -1:
                    if repairer:
                        out += [(conv, place + i, *r) for i, r in enumerate(repairer.inserted())]
                    conv, repairer, place = conv_id, Repairer(text), 0
                    continue
                for made in repairer.row(role, text):
                    out.append((conv, place, *made))
                    place += 1
            yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text"])
        if repairer:
            yield pd.DataFrame([(conv, place + i, *r) for i, r in enumerate(repairer.inserted())], columns=["conv_id", "place", "role", "text"])

    made = dealt.mapInPandas(run, "conv_id string, place long, role string, text string")
    return made.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows that come as `repaired_turns` gives them: `role:text` lines, joined by newlines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, digest = None, None
        for batch in batches:
            out = []
            for conv_id, role, text in batch.itertuples(index=False):
                if digest is None or conv_id != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = conv_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv_id", "repaired_sha256"])

    rows = turns.select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text")
    made = rows.mapInPandas(run, "conv_id string, repaired_sha256 string")
    return made.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with cost and audit per conversation, and the repaired turns, of `rows` (conv_id, turn, role, text).

    Null roles and texts count as one space, null turns come first, rows of one turn stand by
    role and text. A null conv_id is a conversation of its own. Rows that repeat role and text
    within a conversation are duplicates but for the first. A role counts by its first letter,
    any other than s, u and a can only be changed or deleted. Empty texts are blank; long ones
    are read as a stream. Other columns are ignored; an empty table gives two empty ones.
    """
    faulty = written(faulted_rows(rows), "faulted-rows")
    mended = written(repairs(written(conversation_facts(faulty), "conversations")), "repairs")
    return mended, repaired_turns(faulty, mended)


def repair_report(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation, damaged first.

    A conversation that the damage leaves without rows has zeros, an empty audit and the hash of
    nothing; other cases as in `repair_conversations`.
    """
    mended, turns = repair_conversations(damaged(conversations))
    digests = turn_digests(turns)
    ids = conversations.select("conv_id").distinct()
    whole = ids.join(mended.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left").join(
        digests.withColumnRenamed("conv_id", "_of"), F.col("conv_id").eqNullSafe(F.col("_of")), "left"
    )
    numbers = ["gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost"]
    return whole.select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
