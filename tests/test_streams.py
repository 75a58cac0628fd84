"""Streams with bounded state against their batch forms."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from reviewmill.operators import lake
from reviewmill.operators.freshness import fresh_results
from reviewmill.streaming import lookups
from reviewmill.streaming.ingest import ingest_stream

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    rows, at = [], 0.0
    for i in range(400):
        at += rng.expovariate(1 / 40)
        rows.append((i, rng.choice([1, 1, 1, 2, 3, None]), START + dt.timedelta(seconds=at, microseconds=rng.randrange(1000)), rng.choice(["ask", "ask", "store", "remove"]), rng.random() < 0.1))
    rows += [(400, 1, rows[-1][2], "store", False), (401, 1, rows[-1][2], "remove", False), (402, 1, rows[-1][2], "ask", False)]
    return rows


def split(df):
    of = lambda kind, *cols: df.filter(F.col("what") == kind).select("key", *cols)
    return of("ask", "ts", F.col("id").alias("request_id"), F.col("force").alias("force_refresh")), of("store", F.col("ts").alias("created_at")), of("remove", "ts", F.col("id").alias("request_id"))


def test_lookups_equal_batch_and_state_ends_empty(spark, events, tmp_path):
    schema = "id long, key long, ts timestamp_ntz, what string, force boolean"
    rng = random.Random(1)
    files = [events[k : k + 80] for k in range(0, len(events), 80)]
    for at, part in enumerate([*files, [(-1, 9, START + dt.timedelta(days=3), "clock", False)]]):
        spark.createDataFrame(rng.sample(part, len(part)), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    clock = feed.filter("what = 'clock'").select("key", "ts")
    stream = lookups.lookup_events(*split(feed), clock)
    run = lookups.lookup_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), ttl_seconds=600)
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = fresh_results(*split(spark.createDataFrame(events, schema)), ttl_seconds=600)
    rows = lambda df: sorted(map(repr, df.select("request_id", "key", "ts", "kind", "hit", "result_at").collect()))
    assert rows(got) == rows(want) and {r.hit for r in got.collect()} == {True, False}
    held = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in run.recentProgress]
    assert held[-1] == 0 and max(held) > 0


def test_replayed_and_late_files_give_the_same_lake(spark, tmp_path):
    schema = "row_id long, app_id string, reviewId string, content string, score int, thumbsUpCount int"
    rows = [(i, "app", f"r{i}", f"text number {i % 70}", 1 + i % 5, i) for i in range(100)]
    landing, paths = str(tmp_path / "in"), [str(tmp_path / "lake"), str(tmp_path / "plain")]
    landings = [rows[50:], rows[50:], rows[:50], rows]
    for part in landings:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        time.sleep(1.1)
    feed = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    arrived = feed().select("*", F.col("_metadata.file_modification_time").alias("arrived_at"))
    run = ingest_stream(arrived, paths[0], "s", str(tmp_path / "c0"), "arrived_at", "1 hour")
    run.awaitTermination()
    ingest_stream(feed(), paths[1], "s", str(tmp_path / "c1")).awaitTermination()
    read = lambda p: sorted(map(repr, lake.read_lake(spark, p).select("content_hash", "score", "thumbs_up_count").collect()))
    assert read(paths[0]) == read(paths[1]) and len(read(paths[0])) == 70
    assert max(sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in run.recentProgress) == 100
    attempted = [r.rows_attempted if "rows_attempted" in r else r[2] for r in lake.read_batches(spark, paths[0]).collect()]
    assert sum(attempted) <= 100

    # with a short delay the keys of earlier landings are forgotten, and the lake still holds each text once
    run = ingest_stream(arrived, str(tmp_path / "short"), "s", str(tmp_path / "c2"), "arrived_at", "1 second")
    run.awaitTermination()
    assert len(read(str(tmp_path / "short"))) == 70
