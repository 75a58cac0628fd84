"""Reuse of earlier results within a time to live, as an as-of lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.schema import require_columns

TTL_SECONDS = 1800

# at one instant a result is stored before it is removed, and removed before it is asked for
RESULT, REMOVAL, REQUEST = 0, 1, 2


def fresh_results(
    requests: DataFrame,
    results: DataFrame,
    removals: DataFrame | None = None,
    ttl_seconds: int = TTL_SECONDS,
    slots_per_ttl: int = 4,
) -> DataFrame:
    """For each request (and removal) the live result it meets, if any.

    requests: key, ts, request_id [, force_refresh]; results: key, created_at;
    removals: key, ts, request_id. Only the last TTL matters to a lookup, so time is
    cut into slots and every result and removal also appears in the slots it can still
    reach. The window then runs per (key, slot): a key with a third of all traffic is
    spread over its slots, and no range join is needed. More slots per TTL split hot keys
    finer and copy the (fewer) results more often.
    """
    require_columns(requests, "key", "ts", "request_id")
    require_columns(results, "key", "created_at")
    micros = ttl_seconds * 1_000_000
    width = -(-micros // slots_per_ttl)
    force = F.col("force_refresh") if "force_refresh" in requests.columns else F.lit(False)

    time_type = results.schema["created_at"].dataType

    def at(column: str):
        return F.unix_micros(F.col(column).cast("timestamp"))

    def slot(column: str):
        return F.floor(at(column) / width)

    reach = F.explode(F.sequence(F.lit(0), F.lit(slots_per_ttl))).alias("later")

    asked = requests.select(
        "key", "ts", F.lit(REQUEST).alias("kind"), "request_id", force.alias("forced"),
        slot("ts").alias("slot"), F.lit(None).cast(time_type).alias("created_at"), F.lit(True).alias("own"),
    )
    no_id = F.lit(None).cast(requests.schema["request_id"].dataType)
    stored = results.select("key", "created_at", reach).select(
        "key", F.col("created_at").alias("ts"), F.lit(RESULT).alias("kind"), no_id.alias("request_id"),
        F.lit(False).alias("forced"), (slot("created_at") + F.col("later")).alias("slot"), "created_at", F.lit(False).alias("own"),
    )
    events = asked.unionByName(stored)
    if removals is not None:
        gone = removals.select("key", "ts", "request_id", reach).select(
            "key", "ts", F.lit(REMOVAL).alias("kind"), "request_id", F.lit(False).alias("forced"),
            (slot("ts") + F.col("later")).alias("slot"), F.lit(None).cast(time_type).alias("created_at"),
            (F.col("later") == 0).alias("own"),
        )
        events = events.unionByName(gone)
    before = Window.partitionBy("key", "slot").orderBy("ts", "kind", "request_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    state = F.when(F.col("kind") != REQUEST, F.struct("kind", "created_at"))
    met = F.last(state, ignorenulls=True).over(before)
    live = (
        (F.col("_met.kind") == RESULT)
        & (at("ts") < at("_met.created_at") + micros)
        & ~F.col("forced")
    )
    return (
        events.withColumn("_met", met)
        .filter("own")
        .select(
            "request_id",
            "key",
            "ts",
            F.when(F.col("kind") == REQUEST, "request").otherwise("removal").alias("kind"),
            F.coalesce(live, F.lit(False)).alias("hit"),
            F.when(live, F.col("_met.created_at")).alias("result_at"),
        )
    )
