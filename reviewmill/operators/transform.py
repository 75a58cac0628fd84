"""Row filters and the review cleaning step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.labels import encode_label, safe_int
from reviewmill.functions.text import clean_text, is_blank, strip, survives_cleaning
from reviewmill.schema import require_columns, require_rows


def drop_blank(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Keep rows with text; the text comes back stripped."""
    require_columns(df, text_col)
    return df.filter(~is_blank(F.col(text_col))).withColumn(text_col, strip(F.col(text_col).cast("string")))


def transform_reviews(
    df: DataFrame, text_col: str = "content", label_col: str = "label", check_rows: bool = False
) -> DataFrame:
    """Clean the text, drop rows that end up empty, encode the label.

    Label text other than the three classes has no integer form, so it stays in
    `<label>_raw` while the integer column is NULL; integer labels pass through.
    """
    require_columns(df, text_col)
    if check_rows:
        require_rows(df)
    # blank text does not survive cleaning either, so one test covers both drops
    out = df.filter(survives_cleaning(F.col(text_col))).withColumn(text_col, clean_text(F.col(text_col)))
    if label_col in df.columns:
        text = F.col(label_col).cast("string")
        code = F.coalesce(encode_label(text), safe_int(F.col(label_col)))
        out = out.withColumn(f"{label_col}_raw", F.when(code.isNull(), text)).withColumn(label_col, code)
    return out


def drop_any_null(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows without a NULL in any column, then without the named columns."""
    return df.dropna().drop(*drop)


def null_profile(df: DataFrame) -> DataFrame:
    """NULLs per column as (column_name, nulls), counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])
    return counts.select(F.inline(pairs))
