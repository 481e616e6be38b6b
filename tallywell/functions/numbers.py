"""Guarded arithmetic and comparisons on report values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECONDS_PER_HOUR = 3600.0


def hours(seconds: Column) -> Column:
    return seconds / F.lit(SECONDS_PER_HOUR)


def at_least(value: Column, minimum: float) -> Column:
    """``value >= minimum`` with NaN failing the test (Spark orders NaN above everything)."""
    return (value >= F.lit(float(minimum))) & ~F.isnan(value)


def parse_number(text: Column, strict: bool = True) -> Column:
    """Text as DOUBLE; malformed text raises, or gives NULL when not ``strict``.

    Raising is spelled out so that it does not depend on the ANSI setting.
    """
    number = text.try_cast("double")
    if not strict:
        return number
    complaint = F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")
    return F.when(text.isNotNull() & number.isNull(), complaint).otherwise(number)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)
