"""Landed review files: CSV exports and Parquet or JSON dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.schema import LABELED_CSV, RAW_REVIEWS

# Cell texts that mean "missing" in a CSV export.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_reviews_csv(
    spark: SparkSession, path: str, schema: T.StructType = LABELED_CSV, multi_line: bool = False
) -> DataFrame:
    """A CSV export with a header, columns found by name; a missing path is an error.

    Quoted line breaks need multi_line, which reads each file in one task: land large exports as
    many files. `row_id` rises along each file; between files its order is Spark's choice of
    splits, so keep what must be ordered in one file.
    """
    raw = spark.read.csv(
        path, header=True, multiLine=multi_line, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, inferSchema=False,
    )

    def typed(field: T.StructField):
        if field.name not in raw.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        cell = F.when(~F.col(field.name).isin(MISSING), F.col(field.name))
        if isinstance(field.dataType, (T.IntegerType, T.LongType)):
            cell = cell.try_cast("double")  # a column with gaps may be written as 5.0
        return cell.try_cast(field.dataType).alias(field.name)

    return raw.select(*[typed(f) for f in schema.fields], F.monotonically_increasing_id().alias("row_id"))


def read_review_dump(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A landed scrape: one row per review with its app id."""
    return spark.read.format(fmt).schema(RAW_REVIEWS).load(path)


def stream_review_dump(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """The same landing folder as an unbounded table."""
    reader = spark.readStream.format(fmt).schema(RAW_REVIEWS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
