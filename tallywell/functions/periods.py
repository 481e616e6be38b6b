"""UTC time: pushable comparisons on the stored column, and calendar periods.

An event time may be stored as epoch microseconds (BIGINT), TIMESTAMP or
TIMESTAMP_NTZ. Comparisons are always built in the stored type so they reach
the file scan; wrapping the column would leave only an IS NOT NULL there.
Periods are cut with integer arithmetic on microseconds. For BIGINT columns
nothing depends on the session time zone; timestamp columns are read as UTC and
need ``spark.sql.session.timeZone=UTC``.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ONE_DAY = 86_400_000_000
FIXED_GRAINS = {
    "SECOND": 1_000_000,
    "MINUTE": 60_000_000,
    "HOUR": 3_600_000_000,
    "DAY": ONE_DAY,
}
CALENDAR_GRAINS = {"MONTH": "MM", "QUARTER": "QUARTER", "YEAR": "YEAR"}

Instant = datetime | date | str


def grain_name(grain: str) -> str:
    name = grain.upper()
    if name not in FIXED_GRAINS and name not in CALENDAR_GRAINS:
        raise ValueError(f"unknown grain {grain!r}")
    return name


def epoch_micros(moment: Instant) -> int:
    """Microseconds since the epoch; a moment without an offset is UTC."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
    elif not isinstance(moment, datetime):
        moment = datetime(moment.year, moment.month, moment.day)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return (moment - EPOCH) // timedelta(microseconds=1)


def _stored_type(df: DataFrame, column: str) -> T.DataType:
    dtype = df.schema[column].dataType
    if not isinstance(dtype, (T.LongType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{column} must be BIGINT microseconds or a timestamp, not {dtype.simpleString()}")
    return dtype


def moment_literal(df: DataFrame, column: str, moment: Instant) -> Column:
    """``moment`` as a literal of the type ``column`` is stored in."""
    micros = epoch_micros(moment)
    dtype = _stored_type(df, column)
    if isinstance(dtype, T.LongType):
        return F.lit(micros).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(micros).cast("bigint"))
    text = (EPOCH + timedelta(microseconds=micros)).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def before(df: DataFrame, column: str, cutoff: Instant) -> Column:
    """Strictly before ``cutoff``."""
    return F.col(column) < moment_literal(df, column, cutoff)


def within(df: DataFrame, column: str, start: Instant | None, end: Instant | None) -> Column:
    """Half-open ``[start, end)``; either end may be missing."""
    test = F.lit(True)
    if start is not None:
        test = test & (F.col(column) >= moment_literal(df, column, start))
    if end is not None:
        test = test & (F.col(column) < moment_literal(df, column, end))
    return test


def micros_of(df: DataFrame, column: str) -> Column:
    dtype = _stored_type(df, column)
    if isinstance(dtype, T.LongType):
        return F.col(column)
    return F.unix_micros(F.col(column).cast("timestamp"))


def floor_to(micros: Column, size: int) -> Column:
    """Start of the ``size``-microsecond slot; also right before the epoch."""
    width = F.lit(size).cast("bigint")
    return micros - F.pmod(micros, width)


def utc_date(micros: Column) -> Column:
    days = floor_to(micros, ONE_DAY) / F.lit(ONE_DAY)  # whole by construction
    return F.date_from_unix_date(days.cast("int"))


def period(df: DataFrame, column: str, grain: str) -> Column:
    """Period an event falls in: DATE from day upwards, TIMESTAMP below."""
    name = grain_name(grain)
    micros = micros_of(df, column)
    if name in CALENDAR_GRAINS:
        return F.trunc(utc_date(micros), CALENDAR_GRAINS[name])
    if name == "DAY":
        return utc_date(micros)
    return F.timestamp_micros(floor_to(micros, FIXED_GRAINS[name]))


def month_start(df: DataFrame, column: str = "month") -> Column:
    """Month as DATE, whether stored as DATE or as ``YYYY-MM`` text."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.to_date(F.col(column), "yyyy-MM")
    return F.col(column).cast("date")


def month_literal(month: date | str) -> Column:
    """First day of a month given as a date, ``YYYY-MM`` or ``YYYY-MM-DD``."""
    if isinstance(month, str):
        month = date.fromisoformat(month if len(month) > 7 else month + "-01")
    return F.lit(month)


def since_month(column: Column, since: str | date) -> Column:
    """Month on or after ``since``.

    Comparing the date as text with ``YYYY-MM`` keeps exactly the months whose
    first day is on or after that month, so the date comparison replaces it and
    stays pushable.
    """
    return column >= month_literal(since)
