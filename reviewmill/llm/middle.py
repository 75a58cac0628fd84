"""Fill-in-middle examples cut through a learned rank index.

A text is a row of units. The index of a text maps a rank to the offset where that unit ends: it
holds straight segments fitted to all offsets within a fixed error, and for each offset what the
segment's prediction lacks, one byte. A cut is a prediction and one stored residual, so it is
exact and reads nothing else of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.bpe import whole_text_batches

# The marks that an example puts before its parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 60  # code points that a prediction may be off; with rounding it must stay below 128
BIAS = 128  # residuals are stored as unsigned bytes
LOOK = 128  # offsets first looked at for a segment
INDEX = "n long, starts array<int>, bases array<int>, slopes array<double>, residuals binary"


@dataclass(frozen=True)
class Plan:
    """`seed` fixes the draws; of 100 texts `plain` in the mean stay as they are, and of 100 others `spm` put the suffix first."""

    seed: int = 1
    plain: int = 10
    spm: int = 20


def boundaries(text: str) -> np.ndarray:
    """Offsets, in code points, of the ends of the first 0, 1, 2, ... units: `[A-Za-z]+|[^A-Za-z]`."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    folded = points | 32
    letter = (folded >= ord("a")) & (folded <= ord("z")) & (points < 128)
    inside = letter[1:] & letter[:-1]
    ends = np.flatnonzero(~inside) + 1
    return np.concatenate([[0], ends, [len(points)]] if len(points) else [[0]]).astype(np.int64)


def fit_segments(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """(starts, slopes): lines from their first offset that stay within `error` of all they cover.

    A segment grows as long as some slope suits all its points; the next one starts behind it.
    """
    starts, slopes, at, last = [], [], 0, len(offsets) - 1
    while at <= last:
        look, slope = LOOK, 0.0
        while True:
            rise = offsets[at + 1 : at + 1 + look] - offsets[at]
            run = np.arange(1, len(rise) + 1)
            low = np.maximum.accumulate((rise - error) / run)
            high = np.minimum.accumulate((rise + error) / run)
            fits = low <= high
            covered = len(rise) if fits.all() else int(np.argmin(fits))
            if covered < len(rise) or at + look >= last:
                break
            look *= 4
        if covered:
            slope = (low[covered - 1] + high[covered - 1]) / 2
        starts.append(at)
        slopes.append(slope)
        at += covered + 1
    return np.array(starts, dtype=np.int32), np.array(slopes)


def index_text(text: str) -> tuple:
    """The rank index of a whole text, fields as in INDEX."""
    offsets = boundaries(text)
    starts, slopes = fit_segments(offsets)
    bases = offsets[starts]
    covered = np.diff(np.append(starts, len(offsets)))
    run = np.arange(len(offsets)) - np.repeat(starts, covered)
    predicted = np.repeat(bases, covered) + np.rint(np.repeat(slopes, covered) * run).astype(np.int64)
    residuals = (offsets - predicted + BIAS).astype(np.uint8)
    return len(offsets) - 1, starts, bases.astype(np.int32), slopes, residuals.tobytes()


def rank_index(text: Column) -> Column:
    """The rank index of a text as a struct; null counts as empty."""

    @F.pandas_udf(INDEX)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([index_text(t or "") for t in texts], columns=["n", "starts", "bases", "slopes", "residuals"])

    return run(text)


def offset_at(index: Column, rank: Column) -> Column:
    """The offset behind `rank` units: prediction of the rank's segment and the residual stored for it."""
    segment = F.size(F.filter(index["starts"], lambda s: s <= rank))
    run = rank - F.element_at(index["starts"], segment)
    predicted = F.element_at(index["bases"], segment) + F.rint(F.element_at(index["slopes"], segment) * run)
    byte = F.conv(F.hex(F.substring(index["residuals"], rank.cast("int") + 1, F.lit(1))), 16, 10)
    return (predicted + byte.cast("long") - BIAS).cast("int")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from a document's id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, example) per row of `docs` (doc_id, text).

    `form` is plain, psm or spm. A text stays plain if it is empty or null, holds one of the
    marks, or is drawn so; its prefix_chars and middle_chars are null. Draws depend on the
    doc_id alone: rows that repeat an id get the same ranks as far as their texts allow, a null
    id counts as an empty one. Equal ranks leave the middle empty. An empty table gives no
    rows; other columns are ignored. Nothing is shuffled, and a text is read once for its index.
    """
    whole_text_batches(docs)
    text = F.coalesce("text", F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    h1, h2, h3, h4 = draws(F.col("doc_id"), plan.seed)
    indexed = docs.select("doc_id", text.alias("_text"), marked.alias("_marked"), rank_index(F.col("text")).alias("_index"))
    units = F.col("_index")["n"]
    ranked = indexed.select(
        "doc_id", "_text", "_index", units.alias("n"), (h1 % (units + 1)).alias("_a"), (h2 % (units + 1)).alias("_b"),
        F.when((units == 0) | F.col("_marked") | (h3 % 100 >= 100 - plan.plain), "plain").when(h4 % 100 < plan.spm, "spm").otherwise("psm").alias("form"),
    )
    cut = ranked.select(
        "doc_id", "n", "form", "_text",
        F.when(F.col("form") != "plain", offset_at(F.col("_index"), F.least("_a", "_b"))).alias("_from"),
        F.when(F.col("form") != "plain", offset_at(F.col("_index"), F.greatest("_a", "_b"))).alias("_to"),
    )
    part = lambda start, length: F.substring("_text", start, length)
    prefix, middle = part(F.lit(1), F.col("_from")), part(F.col("_from") + 1, F.col("_to") - F.col("_from"))
    suffix = part(F.col("_to") + 1, F.length("_text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return cut.select(
        "doc_id", "n", "form",
        F.col("_from").cast("long").alias("prefix_chars"),
        (F.col("_to") - F.col("_from")).cast("long").alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text")).alias("example"),
    )


def restored(example: Column, form: Column) -> Column:
    """The text that an example was made of: its marks stand once each, for marked texts stay plain."""
    mark = len(PREFIX)
    between = lambda left, right: F.substring_index(F.substring_index(example, left, -1), right, 1)
    middle = F.substring_index(example, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, F.substring_index(F.substring(example, F.lit(mark + 1), F.length(example)), PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(example)


def middle_report(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) per row; cases as in `fill_in_middle`."""
    made = fill_in_middle(docs, plan)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("example", 256).alias("output_sha256"),
        F.sha2(restored(F.col("example"), F.col("form")), 256).alias("restored_sha256"),
    )
