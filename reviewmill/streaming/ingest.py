"""Incremental lake ingestion from a landing folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from reviewmill.operators.lake import append_to_lake
from reviewmill.operators.transform import transform_reviews


def replays_dropped(stream: DataFrame, arrived_at: str, delay: str, keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """The stream without rows whose keys came before and at most `delay` earlier.

    `arrived_at` tells when a row landed, not when it was written, so old rows that land late
    are not late here and none is lost. State holds the keys of one delay and no more. Rows of
    one key are taken to be equal.
    """
    return stream.withWatermark(arrived_at, delay).dropDuplicatesWithinWatermark(list(keys))


def ingest_stream(
    stream: DataFrame, lake_path: str, source: str, checkpoint: str, arrived_at: str | None = None, delay: str = "1 day"
) -> StreamingQuery:
    """Clean and append every file that has landed, then stop.

    The lake itself decides what is new, so a replayed batch inserts nothing twice. Where
    `arrived_at` names a column with the time of landing, rows that land again within `delay` do
    not even reach the lake's join; without it no state is kept between batches.
    """

    def load(batch: DataFrame, epoch: int) -> None:
        batch_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{source}/{epoch}"))
        rows = batch if arrived_at is None else batch.drop(arrived_at)
        append_to_lake(transform_reviews(rows), lake_path, source, batch_id, has_text=True)

    fresh = stream if arrived_at is None else replays_dropped(stream, arrived_at, delay)
    return fresh.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
