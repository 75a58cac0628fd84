"""Review-shaped views over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table. Text tables that come as fewer splits than there are cores are
    spread over them first, since text work is bound by the CPU; large inputs never are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_KEYS and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, F.col(TEXT_KEYS[name]))
    return df


def as_reviews(documents: DataFrame, *more) -> DataFrame:
    """documents as scraped reviews: the source is the app, length stands in for score and votes; and columns named besides."""
    return documents.select(
        F.col("source").alias("app_id"),
        F.col("doc_id").cast("string").alias("reviewId"),
        F.col("text").alias("content"),
        (F.col("n_chars") % 5 + 1).cast("int").alias("score"),
        (F.col("n_chars") % 100).cast("int").alias("thumbsUpCount"),
        F.col("doc_id").alias("row_id"),
        *more,
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_reviews(table(spark, sf_dir, "documents"))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_reviews with a text label where `labels` has one, NULL elsewhere."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("toxic") == 1, "negative")
        .when(F.col("quality") == 1, "positive")
        .when(F.col("quality") == 0, "neutral")
        .alias("label"),
    )
    return raw_reviews(spark, sf_dir).join(labels, "row_id", "left")


def with_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeled(spark, sf_dir).withColumnRenamed("label", "sentiment")


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled reviews with a stand-in cluster per language; two clusters share a topic name."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    lang = F.col("lang")
    return (
        with_sentiment(spark, sf_dir)
        .filter(F.col("sentiment").isNotNull())
        .join(docs, "row_id")
        .withColumn("cluster", F.when(lang == "en", 0).when(lang == "fr", 1).when(lang == "de", 2).otherwise(-1))
        .withColumn(
            "topic",
            F.when(lang == "en", "sign in | account | login screen keeps loading for ever")
            .when(lang.isin("fr", "de"), "battery life | charging")
            .otherwise("Uncategorized"),
        )
    )


def lookups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events as (requests, results, removals) of analysis results, one key per user."""
    return lookups_of(table(spark, sf_dir, "events"))


def lookups_of(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    def of(kind: str, *cols):
        return events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("key"), *cols)

    requests = of("view", "ts", F.col("event_id").alias("request_id"), (F.col("value") < 1).alias("force_refresh"))
    results = of("purchase", F.col("ts").alias("created_at"))
    removals = of("error", "ts", F.col("event_id").alias("request_id"))
    return requests, results, removals
