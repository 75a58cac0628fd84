"""Conversation repair against a plain search over edits."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

from reviewmill.llm import repair

ROLES = {"u": "user", "a": "assistant"}
EMITS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def plain_repair(rows):
    """(cost, audit, lines) by uniform-cost search over (row, state), least audit first among equals."""
    queue = [(0, "", 0, 0, ())]
    done = set()
    while queue:
        cost, audit, at, state, lines = heappop(queue)
        if at == len(rows) and state in (0, 3):
            return cost, audit, list(lines)
        if (at, state) in done:
            continue
        done.add((at, state))
        for r, name in ROLES.items():
            if state in EMITS[r]:
                heappush(queue, (cost + 2, audit + "I", at, EMITS[r][state], (*lines, f"{name}:")))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heappush(queue, (cost + 3, audit + "D", at + 1, state, lines))
        if fault in ("blank", "duplicate"):
            continue
        extra = fault == "truncated"
        if state in EMITS.get(role[:1], {}):
            heappush(queue, (cost + extra, audit + "K", at + 1, EMITS[role[0]][state], (*lines, f"{role}:{text}")))
        for r, name in ROLES.items():
            if state in EMITS[r]:
                heappush(queue, (cost + 2 + extra, audit + "R", at + 1, EMITS[r][state], (*lines, f"{name}:{text}")))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain_report(rows):
    found = {}
    rest = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rest if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faulty = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(faulty, faulty[1:])]
        count = lambda f: sum(x[2] == f for x in faulty)
        cost, audit, lines = plain_repair(faulty)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        found[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest)
    return found


def report(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, place int")
    return {r.conv_id: tuple(r)[1:] for r in repair.repair_report(df.repartition(3)).collect()}


def test_repair_equals_plain_search(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "why?", "cut off", "", "  ", None, "Yes. \n", "end. ", "é" * 4000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = [
        (c, t if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"{rng.choice(texts)} {t}{c}.")
        for c in range(220) for t in range(rng.randint(1, 14)) if rng.random() < 0.9
    ]
    rows += [(None, 0, "user", "hi."), (None, 1, "assistant", "ho."), (500, None, "user", "a."), (500, None, "user", "a."), (501, 9, "user", "z."), (501, 9, "assistant", "y.")]
    got, want = report(spark, rows), plain_report(rows)
    assert got == want
    assert len(set(v[6] for v in got.values())) > 50


def test_long_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)]
    rows += [(2, t, "assistant", f"only {t % 50}.") for t in range(1500)]
    assert report(spark, rows) == plain_report(rows)


def test_nothing_left_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert report(spark, [(gone, 0, "user", "x."), (gone, 0, "user", "x.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(empty).count() == 0


def test_rules_change_no_result():
    rng = random.Random(8)
    for _ in range(80):
        symbols = "".join(rng.choice("suaxSUAXduaua") for _ in range(rng.randint(0, 60)))
        plain = repair.cheapest(symbols, repair.grammar_matrices([]))
        rules, text = [("u", "a"), (chr(repair.RULE), chr(repair.RULE)), ("d", "a")], symbols
        for i, (a, b) in enumerate(rules):
            text = text.replace(a + b, chr(repair.RULE + i))
        assert repair.cheapest(text, repair.grammar_matrices(rules)) == plain


def test_rope_order():
    rng = random.Random(1)

    def rope(s):
        if len(s) < 2:
            return repair.letter(s) if s else repair.EMPTY
        cut = rng.randint(1, len(s) - 1)
        return repair.joined(rope(s[:cut]), rope(s[cut:]))

    for _ in range(400):
        a = "".join(rng.choice("DIKR") for _ in range(rng.randint(0, 300)))
        b = a[: rng.randint(0, len(a))] + "".join(rng.choice("DIKR") for _ in range(rng.randint(0, 200)))
        x, y = rope(a), rope(b)
        assert repair.flat(x) == a and repair.less(x, y) == (a < b) and repair.less(y, x) == (b < a)


def test_rules_are_the_frequent_pairs(spark):
    sequences = spark.createDataFrame([("suauaua",), ("uaua",), ("ua",), ("",), ("x",)], "sequence string")
    rules = repair.pair_rules(sequences)
    assert rules[0] == ("u", "a") and all(len(a) == len(b) == 1 for a, b in rules)
