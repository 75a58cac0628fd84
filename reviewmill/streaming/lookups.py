"""Reuse of earlier results while they stream in: keyed state with timers.

Requests, results and removals of a key meet in one stateful operator. What has arrived waits
until the watermark has passed it, so it is taken in the order of event time however it came in;
then a result lives for its TTL or until a removal or a newer result. A key keeps at most
one live result and what the watermark's delay has not settled yet, and nothing once that is over.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from reviewmill.operators.freshness import REMOVAL, REQUEST, RESULT, TTL_SECONDS

CLOCK = 3  # a row that only moves the watermark
WAITING = "at long, kind int, request_id long, forced boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def lookup_events(requests: DataFrame, results: DataFrame, removals: DataFrame, clock: DataFrame | None = None) -> DataFrame:
    """(key, ts, kind, request_id, forced): one stream of all that happens to a key.

    `clock` (key, ts) holds rows that only tell the time, so that a quiet feed still settles.
    """
    no_id = F.lit(None).cast("long").alias("request_id")
    row = lambda df, ts, kind, id_, forced: df.select(F.col("key"), F.col(ts).cast("timestamp").alias("ts"), F.lit(kind).alias("kind"), id_, forced.alias("forced"))
    id_, no = F.col("request_id").cast("long").alias("request_id"), F.lit(False)
    force = F.col("force_refresh") if "force_refresh" in requests.columns else no
    events = row(requests, "ts", REQUEST, id_, force).unionByName(row(results, "created_at", RESULT, no_id, no)).unionByName(row(removals, "ts", REMOVAL, id_, no))
    return events if clock is None else events.unionByName(row(clock, "ts", CLOCK, no_id, no))


class Freshness(StatefulProcessor):
    """What one key's requests and removals meet, in event time."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.live = handle.getValueState("live", "created_at long")

    def wake(self, micros: int) -> None:
        """A timer for when the watermark has passed an instant; timers count milliseconds."""
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        come = [(r["at"], r["kind"], r["request_id"], bool(r["forced"])) for r in rows if r["kind"] != CLOCK]
        if come:
            self.waiting.appendList(come)
            self.wake(min(at for at, *_ in come))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(w) for w in self.waiting.get()]
        due = sorted((w for w in waiting if w[0] <= until), key=lambda w: (w[0], w[1], w[2] or 0))
        created = self.live.get()[0] if self.live.exists() else None
        for at, kind, request_id, forced in due:
            alive = created is not None and at < created + self.ttl
            if kind == RESULT:
                created = at
                continue
            hit = alive and not forced
            yield Row(request_id=request_id, key=key[0], at=at, kind="request" if kind == REQUEST else "removal", hit=hit, result_at=created if hit else None)
            if kind == REMOVAL:
                created = None
        self.keep([w for w in waiting if w[0] > until], created, until)

    def keep(self, later: list[tuple], created: int | None, until: int) -> None:
        if later:
            self.waiting.put(later)
            self.wake(min(at for at, *_ in later))
        else:
            self.waiting.clear()
        if created is None or created + self.ttl <= until:
            self.live.clear()
        else:
            self.live.update((created,))
            self.wake(created + self.ttl)

    def close(self) -> None:
        pass


def answer_lookups(events: DataFrame, delay: str = "10 minutes", ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """(request_id, key, ts, kind, hit, result_at) per request and removal of a stream of `lookup_events`.

    Equal to `fresh_results` over the same rows, for rows that arrive within `delay`; later ones
    are dropped. Null keys share one state.
    """
    timed = events.withWatermark("ts", delay)
    micros = timed.select("key", "ts", F.unix_micros("ts").alias("at"), "kind", "request_id", "forced")
    key_type = events.schema["key"].dataType.simpleString()
    answered = micros.groupBy("key").transformWithState(
        Freshness(ttl_seconds),
        f"request_id long, key {key_type}, at long, kind string, hit boolean, result_at long",
        "Append",
        "EventTime",
    )
    when = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias
    return answered.select("request_id", "key", when("at")("ts"), "kind", "hit", when("result_at")("result_at"))


def lookup_stream(events: DataFrame, out_path: str, checkpoint: str, delay: str = "10 minutes", ttl_seconds: int = TTL_SECONDS) -> StreamingQuery:
    """Answer all that has landed, append it to a table, then stop. State lives in RocksDB, which timers need."""
    conf = events.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        answered = answer_lookups(events, delay, ttl_seconds)
        return answered.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)
