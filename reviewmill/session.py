"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# A side is broadcast only after its row count times its row width is known to fit.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(master: str | None = None, app: str = "reviewmill", **conf) -> SparkSession:
    """A session with the settings these jobs assume; cluster sizing is left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="reviewmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_compact(df: DataFrame) -> DataFrame:
    """cut_lineage for large tables: columns, compressed, in the shared folder; a checkpoint holds plain rows."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_measured(df: DataFrame) -> DataFrame:
    """cut_lineage for frames that a loop joins again and again: the planner takes over the size as measured.

    A checkpoint keeps the estimate of the plan it came from. The estimate of a join is the product
    of its sides, so from round to round its digits double, until they fill the driver's memory.
    """
    held = keep(df)
    held.count()
    cut = cut_lineage(held.select("*"))
    held.unpersist()
    return cut


def keep(df: DataFrame) -> DataFrame:
    """Cache a frame that several branches read; lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def fits_broadcast(rows: int, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * bytes_per_row <= limit
