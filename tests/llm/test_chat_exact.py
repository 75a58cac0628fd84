"""Chat formatting and exact dedup against plain Python."""

import hashlib
import itertools

from pyspark.sql import functions as F

from reviewmill.llm import chat, exact


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escaping_is_reversible(spark):
    parts = ["<", "[", "\\", "/", "s>", "INST]", "x"]
    texts = ["".join(p) for n in range(1, 5) for p in itertools.product(parts, repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    assert df.filter(F.col("e").rlike(r"</?s>|\[/?INST\]")).count() == 0
    assert df.filter(chat.unescape(F.col("e")) != F.col("t")).count() == 0


def test_examples(spark):
    rows = [
        (1, 2, "assistant", "b </s>"), (1, 0, "system", "s"), (1, 1, "user", None), (1, 3, "user", "more"), (1, 4, "assistant", ""),
        (2, 0, "user", "only"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 0, None, "n\n[INST] q [/INST]"),
        (4, None, "assistant", "é🎉" * 5000), (4, 0, "assistant", "\\"),
    ]
    talk = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, pieces string")
    examples = chat.prefix_examples(talk).collect()
    for e in examples:
        assert e.formatted.startswith("<s>") and e.formatted.endswith("</s>")
        assert len(e.formatted) - 4 == e.loss_end
    one = sorted((e for e in examples if e.conv_id == 1), key=lambda e: e.target)
    assert [e.target for e in one] == [2, 4] and one[1].formatted.startswith(one[0].formatted)
    assert one[0].formatted[one[0].loss_start : one[0].loss_end] == "b <\\/s>"
    got = {r.conv_id: r for r in chat.read_back(chat.prefix_examples(talk)).collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1], r[2], r[3] or ""))
        loss = "".join(t or "" for _, _, role, t in mine if role == "assistant")
        assert got[key].n_turns == len(mine)
        assert got[key].turns_sha256 == sha("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in mine))
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), sha(loss))
    assert chat.prefix_examples(talk.limit(0)).count() == 0


def test_chunks_cover_the_text(spark):
    texts = ["", "a", "x" * 9000, "the end and " * 2000, "🎉" * 5000, "漢字 \x85 " * 700]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact.chunks_of(F.col("t")).alias("c"))
    for r in df.collect():
        assert "".join(r.c) == r.t and all(1 <= len(c) <= 4096 for c in r.c)


def check_groups(spark, rows, **kw):
    import re

    docs = spark.createDataFrame(rows, "doc_id long, text string, recipe string, kept string")
    groups = {}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    for (i, *_), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    want = []
    for (i, *_), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[t]), i == keep, sha(t)))
    got = [tuple(r) for r in exact.exact_groups(docs, **kw).collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(want)
    return docs, want


def test_groups(spark):
    long = "the end and more words. " * 900
    rows = [
        (5, "a b", "r", "k"), (3, "a \t\n b", "r", "k"), (9, "a\xa0b", "", ""), (1, None, "", ""), (2, "", "", ""), (4, " ", "", ""),
        (7, long, "", ""), (6, long, "", ""), (8, long + "x", "", ""), (10, "x" + long, "", ""), (7, long, "", ""), (None, "a b", "", ""), (None, "z", "", ""),
    ] + [(100 + i, "copy of one text", "", "") for i in range(50)]
    docs, want = check_groups(spark, rows)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in left.collect()))) == sorted(repr(w[0]) for w in want if w[3])
    assert exact.exact_groups(docs.limit(0)).count() == 0


def test_colliding_fingerprints_are_told_apart(spark):
    rows = [(i, w * 3, "", "") for i, w in enumerate(["aa", "bb", "cc", "aa", "dd", "bb"])]
    rows += [(20 + i, "the end and more. " * 60 + w + " the end and more. " * 60, "", "") for i, w in enumerate(["q", "r", "q"])]
    check_groups(spark, rows, mark=lambda c: F.length(c).cast("long"))
    check_groups(spark, rows, mark=lambda c: F.lit(0).cast("long"))
