"""Exact top-k and exact seeded sampling that do not sort a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
LIMIT_THRESHOLD = "spark.sql.optimizer.windowGroupLimitThreshold"
PREFIX_DIGITS = 4


def seeded_order(seed: int, *keys: str) -> Column:
    """A repeatable, engine-independent shuffle order: md5 of the seed and the row key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: str,
    rank: str = "rank",
) -> DataFrame:
    """The first k rows of each group with their rank.

    Spark limits each group inside every map task before the shuffle, for any k: the threshold
    of that rule is raised to k where it is lower. For large k the group is cut in SALTS slices
    before that; only the survivors meet in one place, however large the group.
    """
    conf = df.sparkSession.conf
    if int(conf.get(LIMIT_THRESHOLD)) < k:
        conf.set(LIMIT_THRESHOLD, k)
    if k > 1000:
        slice_ = F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS))
        local = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", slice_)
            .withColumn("_local", F.row_number().over(local))
            .filter(F.col("_local") <= k)
            .drop("_slice", "_local")
        )
    full = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(full)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order; copies are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).filter(F.col("_first") == 1).drop("_first")


def hash_counts(df: DataFrame, group: Sequence[str], row_keys: Sequence[str], seed: int) -> DataFrame:
    """Rows per group and hash prefix, combined map-side: at most 65,536 rows per group."""
    prefix = F.substring(seeded_order(seed, *row_keys), 1, PREFIX_DIGITS)
    return df.groupBy(*group, prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))


def hash_cutoffs(
    df: DataFrame,
    group: Sequence[str],
    row_keys: Sequence[str],
    counts: DataFrame,
    quotas: DataFrame,
    seed: int,
    few_groups: bool = False,
) -> DataFrame:
    """Per group, the shuffle-order value of its quota-th row.

    The counts by hash prefix find the one prefix that holds the cut, and only that
    prefix's rows (1 in 65,536) are ranked, so no group is ever sorted as a whole.
    Rows with an order value up to the cutoff are the sample; a group whose quota is
    0 has no cutoff. `few_groups` says the caller has bounded the number of groups.
    """
    steps = Window.partitionBy(*group).orderBy("_prefix")
    boundary = (
        counts.withColumn("_upto", F.sum("_n").over(steps))
        .join(F.broadcast(quotas) if few_groups else quotas, list(group))
        .filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select(*group, "_prefix", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    if few_groups:
        boundary = F.broadcast(boundary)  # one row per group
    keyed = df.select(*group, seeded_order(seed, *row_keys).alias("_h"))
    within = Window.partitionBy(*group, "_prefix").orderBy("_h")
    return (
        keyed.withColumn("_prefix", F.substring("_h", 1, PREFIX_DIGITS))
        .join(boundary, [*group, "_prefix"])
        .withColumn("_rank", F.row_number().over(within))
        .filter(F.col("_rank") == F.col("_need"))
        .select(*group, F.col("_h").alias("cutoff"))
    )


def seeded_sample(df: DataFrame, row_keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The n rows of `df` that come first in the shuffle order of their keys; all rows if there are no more.

    Counts by hash prefix, of which there are 65,536, tell where the cut lies, and only the rows
    of that prefix are ordered; the sample is then a filter and nothing else moves. Rows that
    share the last key stay together, so keys that repeat can exceed n.
    """
    order, left, last = seeded_order(seed, *row_keys), n, None
    for r in hash_counts(df, [], row_keys, seed).orderBy("_prefix").collect():
        if r["_n"] > left:
            last = r["_prefix"]
            break
        left -= r["_n"]
    if last is None:
        return df
    if left == 0:
        return df.filter(F.substring(order, 1, PREFIX_DIGITS) < last)
    edge = df.filter(F.substring(order, 1, PREFIX_DIGITS) == last).select(order.alias("_h")).orderBy("_h").limit(left)
    return df.filter(order <= edge.agg(F.max("_h")).first()[0])
