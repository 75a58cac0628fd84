"""The append-only review lake: row preparation, conflict handling, ids, audit.

The lake is a Parquet table partitioned by source and ingest date. It has one writer
at a time; plain Parquet gives no isolation between concurrent appends.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewmill.functions.labels import safe_int, safe_label
from reviewmill.functions.text import content_hash, is_blank
from reviewmill.operators.ranking import first_per_key
from reviewmill.schema import BATCH_LOG, LAKE, require_columns
from reviewmill.session import cut_lineage, fits_broadcast

KEY = ["content_hash", "source"]
KEY_BYTES = 128  # a hash of 64 characters plus a source name, with row overhead


@dataclass(frozen=True)
class LoadSummary:
    batch_id: str | None
    attempted: int
    inserted: int

    @property
    def skipped(self) -> int:
        return self.attempted - self.inserted


def prepare_rows(
    df: DataFrame,
    source: str,
    batch_id: str,
    ingested_at: datetime | None = None,
    row_id: str = "row_id",
    has_text: bool = False,
) -> DataFrame:
    """Lake-shaped rows of one batch; blank content is left out, row order is kept in `row_id`.

    `has_text` says no content is blank, as after cleaning; testing it again would be pushed
    to the scan and clean every text twice.
    """
    require_columns(df, "content")

    def optional(name: str, convert):
        return convert(F.col(name)) if name in df.columns else F.lit(None).cast("int")

    stamp = F.lit(ingested_at).cast("timestamp") if ingested_at else F.current_timestamp()
    rows = df if has_text else df.filter(~is_blank(F.col("content")))
    return rows.select(
        F.col(row_id).alias("row_id"),
        F.col("content").cast("string").alias("content"),
        optional("score", safe_int).alias("score"),
        optional("thumbsUpCount", safe_int).alias("thumbs_up_count"),
        optional("label", safe_label).alias("label"),
        content_hash(F.col("content")).alias("content_hash"),
        F.lit(source).alias("source"),
        F.lit(batch_id).alias("ingestion_batch_id"),
        stamp.alias("ingested_at"),
    )


def first_of_each(prepared: DataFrame) -> DataFrame:
    """The first row of every (content_hash, source) within a batch."""
    return first_per_key(prepared, KEY, [F.asc("row_id")])


def without_known(batch: DataFrame, lake_keys: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Rows whose key the lake does not hold.

    When the batch is known to be small, the lake is first cut to the batch's keys by a
    broadcast semi-join, so the lake is scanned but never shuffled.
    """
    if batch_rows is not None and fits_broadcast(batch_rows, KEY_BYTES):
        lake_keys = lake_keys.join(F.broadcast(batch.select(*KEY)), KEY, "left_semi")
    return batch.join(lake_keys.select(*KEY), KEY, "left_anti")


def append_plan(prepared: DataFrame, lake_keys: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Rows an append would insert: conflicts are skipped, never updated."""
    return without_known(first_of_each(prepared), lake_keys, batch_rows)


def load_summary(prepared: DataFrame, inserted: DataFrame) -> DataFrame:
    """Per batch: attempted, inserted and skipped rows."""
    tried = prepared.groupBy("ingestion_batch_id").agg(F.count(F.lit(1)).alias("attempted"))
    added = inserted.groupBy("ingestion_batch_id").agg(F.count(F.lit(1)).alias("inserted"))
    done = F.coalesce("inserted", F.lit(0))
    return tried.join(added, "ingestion_batch_id", "left").select(
        "ingestion_batch_id", "attempted", done.alias("inserted"), (F.col("attempted") - done).alias("skipped")
    )


def batch_audit(lake: DataFrame) -> DataFrame:
    """Per ingest day and batch: rows, labelled rows and the ingest time span."""
    return lake.groupBy(F.to_date("ingested_at").alias("ingest_date"), "ingestion_batch_id", "source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("label").alias("n_labeled"),
        F.min("ingested_at").alias("first_at"),
        F.max("ingested_at").alias("last_at"),
    )


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    """The lake with its declared columns; a lake not written yet is an empty table."""
    try:
        return spark.read.schema(LAKE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LAKE)


def number_rows(df: DataFrame, start: int, order: str = "row_id") -> DataFrame:
    """Consecutive ids from `start` in row order, without a global sort in one task.

    Rows are range-partitioned and checkpointed first, so partition numbers and row
    positions cannot change if a task runs again; only per-partition counts are
    combined, one row per partition.
    """
    laid = cut_lineage(df.repartitionByRange(order).sortWithinPartitions(order))
    placed = laid.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_at", 33)
    )
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    position = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return (
        placed.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn("id", F.lit(start) + F.col("_offset") + position)
        .drop("_at", "_part", "_offset")
    )


def read_batches(spark: SparkSession, lake_path: str) -> DataFrame:
    """The batch log kept inside the lake folder: one row per batch with its id range."""
    try:
        return spark.read.schema(BATCH_LOG).parquet(os.path.join(lake_path, "_batches"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BATCH_LOG)


def append_to_lake(
    df: DataFrame,
    lake_path: str,
    source: str,
    batch_id: str | None = None,
    row_id: str = "row_id",
    has_text: bool = False,
) -> LoadSummary:
    """Insert a batch, skipping keys already stored; returns what happened.

    The id range is logged before the rows are written. A failed write then leaves a gap,
    never an id used twice, and finding the next id reads the small log, not the lake.
    """
    spark = df.sparkSession
    if df.isEmpty():
        return LoadSummary(None, 0, 0)
    batch_id = batch_id or str(uuid.uuid4())
    prepared = cut_lineage(prepare_rows(df, source, batch_id, row_id=row_id, has_text=has_text))
    attempted = prepared.count()
    # the source is a partition column, so only this source's files are read, and of them one column
    stored = read_lake(spark, lake_path).filter(F.col("source") == source)
    numbered = number_rows(append_plan(prepared, stored.select(*KEY), attempted), 0)
    inserted = numbered.count()
    if inserted == 0:
        return LoadSummary(batch_id, attempted, 0)
    first_id = (read_batches(spark, lake_path).agg(F.max("last_id")).first()[0] or 0) + 1
    entry = (batch_id, source, attempted, inserted, first_id, first_id + inserted - 1)
    spark.createDataFrame([entry], BATCH_LOG).coalesce(1).write.mode("append").parquet(
        os.path.join(lake_path, "_batches")
    )
    out = numbered.withColumn("id", F.col("id") + first_id).withColumn("ingest_date", F.to_date("ingested_at"))
    out.select(*LAKE.fieldNames()).write.mode("append").partitionBy("source", "ingest_date").parquet(lake_path)
    return LoadSummary(batch_id, attempted, inserted)
