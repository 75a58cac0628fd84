"""Table schemas, label codes and column checks shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class ReviewDataError(ValueError):
    """An input table does not have the shape an operator needs."""


class MissingColumnError(ReviewDataError):
    pass


class EmptyInputError(ReviewDataError):
    pass


# The integer code of each sentiment label.
LABEL_CODES = {"negative": 0, "neutral": 1, "positive": 2}
LABEL_NAMES = {code: name for name, code in LABEL_CODES.items()}
UNKNOWN_LABEL = "unknown"

# Report order of the classes, and the order topics are shown in.
SUMMARY_CLASSES = ["positive", "neutral", "negative"]
TOPIC_CLASSES = ["negative", "neutral", "positive"]

STRATEGIES = ["all_reviews", "new_reviews", "relevant_reviews"]

RAW_REVIEWS = T.StructType(
    [
        T.StructField("app_id", T.StringType()),
        T.StructField("reviewId", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("thumbsUpCount", T.IntegerType()),
        T.StructField("row_id", T.LongType()),
    ]
)

LABELED_CSV = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("thumbsUpCount", T.IntegerType()),
        T.StructField("label", T.StringType()),
    ]
)

LAKE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("thumbs_up_count", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("ingestion_batch_id", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("ingest_date", T.DateType()),
        T.StructField("source", T.StringType()),
    ]
)

BATCH_LOG = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("attempted", T.LongType()),
        T.StructField("inserted", T.LongType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
    ]
)

MODEL_RUNS = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("test_f1", T.DoubleType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("report", T.StringType()),
        T.StructField("model_path", T.StringType()),
    ]
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise at plan-building time when a needed column is absent."""
    if df is None:
        raise EmptyInputError("no table was given")
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumnError(f"missing column(s): {', '.join(missing)}; have {', '.join(df.columns)}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    """Raise when the table has no row (one short job that stops at the first row)."""
    if df is None or df.isEmpty():
        raise EmptyInputError("the table has no rows")
    return df
