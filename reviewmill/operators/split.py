"""Seeded train/test split, stratified by label where the classes allow it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.operators.ranking import PREFIX_DIGITS, hash_counts, hash_cutoffs, seeded_order
from reviewmill.schema import require_columns
from reviewmill.session import cut_lineage

MAX_CLASSES = 1000


def split_quotas(sizes: DataFrame, label: str, test_size: float) -> DataFrame:
    """Test rows per class from (label, n): the floor of the exact share, plus one for the
    largest remainders.

    Columns: label, quota, n_test, stratified. The windows run over one row per class; a
    label column with more than MAX_CLASSES values is not a class and stops the job, so
    the table may be broadcast.
    """
    every = Window.partitionBy(F.lit(1))
    few = F.count(F.lit(1)).over(every) <= MAX_CLASSES
    classes = sizes.withColumn(
        "n", F.when(few, F.col("n")).otherwise(F.raise_error(F.lit(f"more than {MAX_CLASSES} classes")).cast("long"))
    )
    by_remainder = Window.partitionBy(F.lit(1)).orderBy(F.desc("_rest"), F.asc(label))
    sized = (
        classes.withColumn("_all", F.sum("n").over(every))
        .withColumn("n_test", F.ceil(F.col("_all") * test_size).cast("long"))
        .withColumn("_base", F.floor(F.col("n") * F.col("n_test") / F.col("_all")))
        .withColumn("_rest", (F.col("n") * F.col("n_test")) % F.col("_all"))
        .withColumn("_left", F.col("n_test") - F.sum("_base").over(every))
    )
    classes_n = F.count(F.lit(1)).over(every)
    enough = (
        (F.min("n").over(every) >= 2)
        & (F.col("n_test") >= classes_n)
        & (F.col("_all") - F.col("n_test") >= classes_n)
    )
    bonus = (F.row_number().over(by_remainder) <= F.col("_left")).cast("long")
    return sized.select(label, (F.col("_base") + bonus).alias("quota"), "n_test", enough.alias("stratified"))


def with_split(
    df: DataFrame,
    label: str = "label",
    text_col: str = "content",
    key: str = "row_id",
    test_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Adds split = 'train' or 'test'; rows without text or label are dropped.

    Stratified by class; when a class has one row, or there are fewer train or test
    rows than classes, the whole table is split as one group instead. The table itself
    is never shuffled: it is counted, one hash prefix in 65,536 is ranked, and the cut
    values are broadcast.
    """
    require_columns(df, label, text_col, key)
    rows = df.filter(F.col(label).isNotNull() & F.col(text_col).isNotNull())
    # small, and the root of all tables below: counted once
    counts = cut_lineage(hash_counts(rows, [label], [key], seed))
    quotas = split_quotas(counts.groupBy(label).agg(F.sum("_n").alias("n")), label, test_size)
    # the group of a row is its class, or one common group in the fallback
    grouped = quotas.select(
        label,
        F.when(F.col("stratified"), F.col(label).cast("string")).otherwise(F.lit("*")).alias("_group"),
        F.when(F.col("stratified"), F.col("quota")).otherwise(F.col("n_test")).alias("quota"),
    )
    group_of = F.broadcast(grouped.select(label, "_group"))
    placed = rows.join(group_of, label)
    merged = counts.join(group_of, label).groupBy("_group", "_prefix").agg(F.sum("_n").alias("_n"))
    wanted = grouped.groupBy("_group").agg(F.max("quota").alias("quota"))
    cutoffs = hash_cutoffs(placed, ["_group"], [key], merged, wanted, seed, few_groups=True)
    test = seeded_order(seed, key) <= F.col("cutoff")
    return (
        placed.join(F.broadcast(cutoffs), "_group", "left")
        .withColumn("split", F.when(test, "test").otherwise("train"))
        .select(*df.columns, "split")
    )


def plain_split(df: DataFrame, key: str = "row_id", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """An unstratified split of the whole table, without sorting or joining it."""
    counts = cut_lineage(hash_counts(df, [], [key], seed))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    cutoff = None
    quota = math.ceil(total * test_size)
    if quota > 0:
        upto = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_prefix"))  # 65,536 rows at most
        cut = (
            counts.withColumn("_upto", upto)
            .filter((F.col("_upto") >= quota) & (F.col("_upto") - F.col("_n") < quota))
            .first()
        )
        order = seeded_order(seed, key)
        inside = df.select(order.alias("_h")).filter(F.startswith("_h", F.lit(cut["_prefix"])))
        need = quota - cut["_upto"] + cut["_n"]
        cutoff = (
            inside.withColumn("_rank", F.row_number().over(Window.partitionBy(F.left("_h", F.lit(PREFIX_DIGITS))).orderBy("_h")))
            .filter(F.col("_rank") == need)
            .first()["_h"]
        )
    test = seeded_order(seed, key) <= F.lit(cutoff)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))
