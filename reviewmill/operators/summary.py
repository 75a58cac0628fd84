"""Sentiment shares, top reviews, topic counts and the figures a report shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions.text import shorten
from reviewmill.operators.ranking import top_k
from reviewmill.schema import SUMMARY_CLASSES, TOPIC_CLASSES, require_columns

NOISE = -1


def sentiment_percentages(df: DataFrame, column: str = "sentiment", drop_null: bool = False) -> DataFrame:
    """Share of each value per app, NULL being a value of its own, half-even to 2 places."""
    require_columns(df, "app_id", column)
    if drop_null:
        df = df.filter(F.col(column).isNotNull())
    # at most one row per class survives the partial aggregate, so the window is tiny
    counts = df.groupBy("app_id", column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("app_id"))
    return counts.withColumn("pct", F.bround(F.col("n") / total * 100, 2))


def label_distribution(df: DataFrame, column: str = "label") -> DataFrame:
    return sentiment_percentages(df, column, drop_null=True)


def top_reviews(df: DataFrame, n: int = 5, column: str = "sentiment", classes=SUMMARY_CLASSES) -> DataFrame:
    """The n reviews of each class with most thumbs-up; ties keep input order, NULL last."""
    require_columns(df, "app_id", column, "content", "thumbsUpCount", "row_id")
    order = [F.desc_nulls_last("thumbsUpCount"), F.asc("row_id")]
    return top_k(df.filter(F.col(column).isin(classes)), ["app_id", column], order, n, "row_id").select(
        "app_id", column, "rank", "content", "thumbsUpCount"
    )


def top_reviews_nested(top: DataFrame, apps: DataFrame) -> DataFrame:
    """Per app of `apps` a JSON object: class to its ranked list of records; absent classes are empty lists."""
    record = F.struct("rank", "content", "thumbsUpCount")
    # one pass over the few top rows of an app: a list for each class
    of = lambda c: F.sort_array(F.collect_list(F.when(F.col("sentiment") == c, record)))
    listed = top.groupBy("app_id").agg(*[of(c).alias(c) for c in SUMMARY_CLASSES])
    empty = F.array().cast("array<struct<content:string,thumbsUpCount:int>>")
    plain = lambda r: F.struct(r["content"].alias("content"), r["thumbsUpCount"].alias("thumbsUpCount"))
    entries = [x for c in sorted(SUMMARY_CLASSES) for x in (F.lit(c), F.coalesce(F.transform(c, plain), empty))]
    full = apps.select("app_id").distinct().join(listed, "app_id", "left")
    return full.select("app_id", F.create_map(*entries).alias("top_reviews")).withColumn("top_reviews_json", F.to_json("top_reviews"))


def topic_summary(df: DataFrame, n: int = 3) -> DataFrame:
    """The n largest topics per class; shares are of all clustered rows, noise included."""
    require_columns(df, "app_id", "sentiment", "cluster", "topic")
    counts = df.groupBy("app_id", "sentiment", "cluster", "topic").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("app_id", "sentiment"))
    named = (
        counts.withColumn("_total", total)
        .filter((F.col("cluster") != NOISE) & F.col("sentiment").isin(TOPIC_CLASSES))
        .groupBy("app_id", "sentiment", "topic")
        .agg(F.sum("_n").alias("count"), F.first("_total").alias("_total"))
    )
    return top_k(named, ["app_id", "sentiment"], [F.desc("count"), F.asc("topic")], n, "topic").select(
        "app_id",
        "sentiment",
        "rank",
        "topic",
        "count",
        F.bround(F.col("count") / F.col("_total") * 100, 1).alias("percentage"),
    )


def keep_top_clusters(df: DataFrame, n: int | None = 3) -> DataFrame:
    """Rows of clusters other than the n largest of their group become noise."""
    require_columns(df, "app_id", "sentiment", "cluster")
    if n is None or n <= 0:
        return df
    keys = ["app_id", "sentiment"]
    sizes = (
        df.filter(F.col("cluster") != NOISE).groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("_size"))
    )
    kept = top_k(sizes, keys, [F.desc("_size"), F.asc("cluster")], n, "cluster", "_rank")
    listed = kept.groupBy(*keys).agg(F.collect_list("cluster").alias("_kept"))  # n ids at most
    return (
        df.join(listed, keys, "left")
        .withColumn(
            "cluster",
            F.when(F.array_contains("_kept", F.col("cluster")), F.col("cluster")).otherwise(
                F.lit(NOISE).cast(df.schema["cluster"].dataType)
            ),
        )
        .drop("_kept")
    )


def cluster_stats(df: DataFrame) -> DataFrame:
    """Per group: rows, clusters, noise rows and the noise share."""
    # one row per cluster first, so no distinct set of row values is built
    per = df.groupBy("app_id", "sentiment", "cluster").agg(F.count(F.lit(1)).alias("_n"))
    noise = F.coalesce(F.sum(F.when(F.col("cluster") == NOISE, F.col("_n"))), F.lit(0))
    return per.groupBy("app_id", "sentiment").agg(
        F.sum("_n").alias("n_rows"),
        F.count_if(F.col("cluster") != NOISE).alias("n_clusters"),
        noise.alias("n_noise"),
        F.bround(noise / F.sum("_n") * 100, 1).alias("noise_pct"),
    )


def keyword_list(names: DataFrame) -> DataFrame:
    """All topic keywords of a group in cluster order, from one row per cluster."""
    require_columns(names, "app_id", "sentiment", "cluster", "topic")
    clusters = names.filter(F.col("cluster") != NOISE).select("app_id", "sentiment", "cluster", "topic").distinct()
    ordered = F.sort_array(F.collect_list(F.struct("cluster", F.split("topic", r" \| ").alias("words"))))
    return clusters.groupBy("app_id", "sentiment").agg(F.flatten(F.transform(ordered, lambda r: r["words"])).alias("keywords"))


def report_shares(percentages: DataFrame) -> DataFrame:
    """Percentages in display order; NULL sentiment is shown as 'unknown'."""
    order = F.array(*[F.lit(c) for c in [*SUMMARY_CLASSES, "unknown"]])
    shown = percentages.withColumn("sentiment", F.coalesce("sentiment", F.lit("unknown")))
    return shown.withColumn("display_pos", F.array_position(order, F.col("sentiment")).cast("int")).filter(
        F.col("display_pos") > 0
    )


def report_topics(summary: DataFrame) -> DataFrame:
    """Shortened topic names and bar widths relative to the longest bar of the group."""
    longest = F.greatest(F.max("percentage").over(Window.partitionBy("app_id", "sentiment")), F.lit(1.0))
    return summary.select(
        "app_id",
        "sentiment",
        "rank",
        shorten(F.col("topic")).alias("label"),
        F.concat(
            F.regexp_replace(F.col("percentage").cast("string"), r"\.0$", ""),
            F.lit("% ("), F.col("count").cast("string"), F.lit(")"),
        ).alias("caption"),
        F.round(F.col("percentage") / longest * 100, 4).alias("bar_width"),
    )
