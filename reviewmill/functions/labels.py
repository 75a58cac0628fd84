"""Label and number coercion as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.functions.text import strip
from reviewmill.schema import LABEL_CODES, LABEL_NAMES, UNKNOWN_LABEL


def encode_label(label: Column) -> Column:
    """Exact label text to its code; any other text gives NULL (see transform_reviews)."""
    code = F.lit(None).cast("int")
    for name, value in LABEL_CODES.items():
        code = F.when(label == name, F.lit(value)).otherwise(code)
    return code


def decode_label(code: Column) -> Column:
    """Label code to text; NULL and unknown codes become 'unknown'."""
    name = F.lit(UNKNOWN_LABEL)
    for value, text in LABEL_NAMES.items():
        name = F.when(code == value, F.lit(text)).otherwise(name)
    return name


def safe_int(value: Column) -> Column:
    """Integers and integer text; numbers truncate; anything else is NULL.

    Text is matched before it is cast: a failed cast raises and catches an exception per
    row. The type test is a constant, so only one branch stays in the plan.
    """
    digits = strip(value.cast("string"))
    from_text = F.when(digits.rlike("^[+-]?[0-9]+$"), digits.try_cast("int"))
    return F.when(F.typeof(value) == "string", from_text).otherwise(value.try_cast("int"))


def safe_label(label: Column) -> Column:
    """Label text in any case, or an integer."""
    text = label.cast("string")
    return F.coalesce(encode_label(F.lower(strip(text))), safe_int(label))


def normalize_label(label: Column) -> Column:
    """Free-form classifier output to Positive, Negative or Neutral, in that priority."""
    low = F.lower(label)
    return (
        F.when(F.contains(low, F.lit("positive")), F.lit("Positive"))
        .when(F.contains(low, F.lit("negative")), F.lit("Negative"))
        .when(F.contains(low, F.lit("neutral")), F.lit("Neutral"))
        .otherwise(low)
    )
