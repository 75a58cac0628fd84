"""Mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, target over size. Documents
stand in order of size, their expected copies are summed up from the front, one random offset is
added, and a document is taken once for every integer its step crosses. Order by size spreads
the copies evenly over short and long documents, so the words taken come near the target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.operators.lake import number_rows
from reviewmill.session import cut_lineage

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source, null among them.

    Sources by code point, null last, take the weights in turn and share `share` times all sizes;
    what exceeds `most` times a source's size is shared again by weight until nothing does. Each
    round is one sum over the sources; only two numbers reach the driver.
    """
    totals = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    named = number_rows(totals.filter(F.col("source").isNotNull()), 0, "source")
    unnamed = totals.filter(F.col("source").isNull()).withColumn("id", F.lit(named.count()))
    turns = F.array(*[F.lit(float(w)) for w in weights])
    table = cut_lineage(
        named.select("source", "source_size", "id")
        .unionByName(unnamed.select("source", "source_size", "id"))
        .select(
            "source", "source_size", (F.col("source_size") * F.lit(float(most))).alias("cap"),
            F.element_at(turns, (F.col("id") % len(weights) + 1).cast("int")).alias("weight"),
        )
    )
    size, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = share * (size or 0)
    level, full = wanted / weight if weight else 0.0, 0
    while True:
        over = F.col("cap") <= level * F.col("weight")
        count, capped, open_weight = table.agg(
            F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if count == full or not open_weight:
            break
        full, level = count, (wanted - (capped or 0.0)) / open_weight
    return table.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def units_of(docs: DataFrame) -> DataFrame:
    """One row per document: rows that agree in id, source and text are one, `n_rows` of them."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("key"), word_count(F.col("text")).alias("size"))
    return rows.groupBy("doc_id", "source", "key", "size").agg(F.count(F.lit(1)).alias("n_rows"))


def rows_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units of a partition with `_at`, the rows that the units before them stand for."""
    total = 0
    for batch in batches:
        upto = pc.add(pc.cumulative_sum(batch["n_rows"]), total)
        yield pa.RecordBatch.from_arrays([*batch.columns, pc.subtract(upto, batch["n_rows"])], names=[*batch.schema.names, "_at"])
        total = upto[-1].as_py() if len(upto) else total


def sampled_copies(units: DataFrame, targets: DataFrame, seed: int = 0, most: int = MOST) -> DataFrame:
    """`units` with source_size, target and copies (0 to `most` times n_rows, for all rows of a unit).

    A unit takes as many steps as it has rows. The running sums need no task that holds a source:
    units are range-partitioned by source and size, and a unit's place is the rows before it in
    its partition plus the rows of its source before.
    """
    order = ["source", "size", "_tie", "doc_id", "key"]
    tied = units.withColumn("_tie", F.xxhash64(F.lit(seed), "doc_id", "key"))
    laid = cut_lineage(tied.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema)
    placed = laid.mapInArrow(rows_before, f"{schema}, _at long")
    parts = placed.groupBy("_part", "source").agg(F.min("_at").alias("_first"), F.sum("n_rows").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    known = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
    steps = (
        known.join(targets, known["source"].eqNullSafe(targets["source"]), "inner")
        .select(
            F.col("_part").alias("_p"), known["source"].alias("_s"), "_first", "_before", "source_size", "target",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_step"),
            (F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), known["source"]), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("_offset"),
        )
    )
    place = F.col("_at") - F.col("_first") + F.col("_before")
    upto = lambda n: F.floor(n * F.col("_step") + F.col("_offset"))
    copies = F.greatest(F.lit(0), F.least(most * F.col("n_rows"), upto(place + F.col("n_rows")) - upto(place))).cast("long")
    return placed.join(steps, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "key", "size", "n_rows", "source_size", "target", copies.alias("copies")
    )


def copies_of_row(ordinal: Column, copies: Column, n_rows: Column) -> Column:
    """Copies of the row with this ordinal, from 1, in its unit: the first ones get what does not go round."""
    return (F.floor(copies / n_rows) + (ordinal <= copies % n_rows).cast("long")).cast("int")


def mix_plan(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, key, size, n_rows, source_size, target, copies): how often the rows of each document are taken.

    Null and empty texts have size 0 and take no words; a null source is a source, a null doc_id
    an id; rows that agree in id, source and text share `copies` evenly, no two of them more than one apart. An empty table gives no rows. Equal sizes stand in
    order of a hash of seed and id, so reruns and other partitionings agree.
    """
    units = cut_lineage(units_of(docs))
    targets = source_targets(units.select("source", (F.col("size") * F.col("n_rows")).alias("size")))
    return sampled_copies(units, targets, seed)


def mix_report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per row of `docs`."""
    rows = mix_plan(docs, seed).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies_of_row(F.col("_row"), F.col("copies"), F.col("n_rows"))).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of `docs`, with all their columns, as often as the mix takes them.

    Where a document's rows differ in other columns, which of them are taken once more is open.
    """
    taken = mix_plan(docs, seed).filter("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("key").alias("_key"), "n_rows", "copies"
    )
    taken = cut_lineage(taken.withColumnsRenamed({"n_rows": "_rows", "copies": "_copies"}))
    same = lambda d: (
        d["doc_id"].eqNullSafe(F.col("_id")) & d["source"].eqNullSafe(F.col("_source")) & (F.xxhash64(d["text"]) == F.col("_key"))
    )
    even = F.col("_copies") % F.col("_rows") == 0
    each = docs.join(taken.filter(even), same(docs)).select(*[docs[c] for c in docs.columns], (F.col("_copies") / F.col("_rows")).cast("int").alias("_times"))
    uneven = taken.filter(~even)
    if not uneven.isEmpty():
        each = each.unionByName(numbered_copies(docs, uneven, same))
    repeated = each.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return repeated.select(*docs.columns)


def numbered_copies(docs: DataFrame, uneven: DataFrame, same: Callable[[DataFrame], Column]) -> DataFrame:
    """The rows of units whose copies do not go round, with `_times` above 0.

    A row's ordinal is its place among its unit's rows of one slice, and the unit's rows in
    slices before; so rows that repeat without end need no task that holds them all.
    """
    unit = ["_id", "_source", "_key"]
    sliced = docs.withColumn("_slice", F.spark_partition_id())
    rows = cut_lineage(sliced.join(uneven, same(sliced)))
    counts = cut_lineage(rows.groupBy(*unit, "_slice").agg(F.count(F.lit(1)).alias("_n")))
    upto = Window.partitionBy(*unit).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(c).alias(f"_{c}") for c in unit], F.col("_slice").alias("__slice"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*unit, "_slice").orderBy("_slice"))
    on = (F.col("_slice") == F.col("__slice")) & (F.col("_key") == F.col("__key"))
    on = on & F.col("_id").eqNullSafe(F.col("__id")) & F.col("_source").eqNullSafe(F.col("__source"))
    times = copies_of_row(F.col("_place") + F.col("_before"), F.col("_copies"), F.col("_rows"))
    numbered = rows.withColumn("_place", place).join(before, on).withColumn("_times", times)
    return numbered.filter("_times > 0").select(*docs.columns, "_times")
