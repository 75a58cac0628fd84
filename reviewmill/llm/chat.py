"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation becomes one example per assistant turn: all turns before it are context and
only that reply is trainable. Texts keep their wording; a control string inside a text or a
role gets one more backslash after its first character, which `unescape` takes away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
OPEN, HEAD, HEAD_END, TURN_END = "<s>", "[INST] ", " [/INST]", "</s>"
# A control string, with the backslashes that earlier escaping may have put in.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, target, n_turns, formatted, loss_start, loss_end, is_last) per assistant turn.

    `conversations` needs conv_id, turn, role, text; other columns are ignored. Turns are
    ordered by (turn, role, text), nulls first, and numbered from 0, so equal turn numbers and
    repeated rows have one fixed order. Null role and text count as empty, a null conv_id is a
    conversation of its own, an empty table gives no rows. `formatted` ends with the target
    turn; the characters from loss_start up to loss_end are its text. A conversation that ends
    with another role has one more row that holds all its turns and trains nothing
    (loss_start = loss_end). A conversation must fit in one row, as its examples do.
    """
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            (F.coalesce(t.role, F.lit("")) == "assistant").alias("reply"),
            F.concat(F.lit(HEAD), escape(F.coalesce(t.role, F.lit(""))), F.lit(HEAD_END)).alias("head"),
            escape(t.text).alias("body"),
        ),
    )
    numbered = turns.select("conv_id", F.size("turns").alias("n_turns"), pieces.alias("pieces"))
    wanted = F.filter(
        F.sequence(F.lit(1), F.col("n_turns")),
        lambda i: F.element_at("pieces", i).reply | (i == F.col("n_turns")),
    )
    targets = numbered.select("conv_id", "n_turns", "pieces", F.explode(wanted).alias("at"))
    joined = F.array_join(
        F.transform(F.slice("pieces", F.lit(1), F.col("at")), lambda p: F.concat(p["head"], p.body, F.lit(TURN_END))), ""
    )
    target = F.element_at("pieces", F.col("at"))
    texts = targets.select(
        "conv_id",
        (F.col("at") - 1).alias("target"),
        "n_turns",
        F.concat(F.lit(OPEN), joined).alias("formatted"),
        F.when(target.reply, F.length(target.body)).otherwise(F.lit(0)).alias("_span"),
        (F.col("at") == F.col("n_turns")).alias("is_last"),
    )
    end = F.length("formatted") - len(TURN_END)
    return texts.select(
        "conv_id", "target", "n_turns", "formatted", (end - F.col("_span")).alias("loss_start"), end.alias("loss_end"), "is_last"
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, as it was before escaping."""
    return unescape(F.substring(formatted, start + 1, end - start))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted text."""
    body = F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted))
    parts = F.split(body, TURN_END)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^\[INST\] (.*?) \[/INST\]", 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)^\[INST\] .*? \[/INST\](.*)$", 1)).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: digests of all turns and of the trained text."""
    spans = examples.select(
        "conv_id",
        F.struct("target", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text")).alias("span"),
        F.when(F.col("is_last"), F.col("formatted")).alias("whole"),
        F.length("formatted").cast("long").alias("chars"),
    )
    per = spans.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("span")).alias("spans"),
        F.max("whole").alias("whole"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    turns = parse_turns(F.col("whole"))
    listed = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    trained = F.array_join(F.transform("spans", lambda s: s.text), "")
    return per.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
    )
