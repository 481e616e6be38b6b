"""Active users: from the nested event export and from the monthly table."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.functions.numbers import at_least, parse_number
from tallywell.functions.periods import CALENDAR_GRAINS, grain_name, month_literal, month_start, since_month


def _value_passes(param: Column, minimum: float, strict: bool) -> Column:
    """Either typed value reaches the minimum; a set number does not hide the text."""
    number, text = param["value"]["double_value"], param["value"]["string_value"]
    by_number = number.isNotNull() & at_least(number, minimum)
    by_text = text.isNotNull() & at_least(parse_number(text, strict), minimum)
    return by_number | by_text


def _event_period(day: Column, grain: str) -> Column:
    name = grain_name(grain)
    parsed = F.to_date(day, "yyyyMMdd")
    if name == "DAY":
        return parsed
    if name not in CALENDAR_GRAINS:
        raise ValueError("the export has day resolution; use DAY or a coarser grain")
    return F.trunc(parsed, CALENDAR_GRAINS[name])


def event_parameters(raw: DataFrame, key: str) -> DataFrame:
    """One row per parameter named ``key``: the unnested form of the export.

    Events with an empty or missing parameter array give no row.
    """
    rows = raw.select(
        "user_pseudo_id", "event_date", "event_name", F.explode("event_params").alias("param")
    )
    return rows.filter(F.col("param.key") == key).select(
        "user_pseudo_id",
        "event_date",
        "event_name",
        F.col("param.value.double_value").alias("double_value"),
        F.col("param.value.string_value").alias("string_value"),
    )


def qualifying_events(
    raw: DataFrame,
    event_names: Mapping[str, str],
    key: str = "duration",
    min_value: float = 2.0,
    grain: str = "MONTH",
    strict: bool = True,
) -> DataFrame:
    """``(period, user, event_name)`` of events whose parameter reaches the minimum.

    Tested inside the array, so an event stays one row whatever its parameters.
    """
    passes = F.exists(
        "event_params", lambda p: (p["key"] == key) & _value_passes(p, min_value, strict)
    )
    return raw.filter(F.col("event_name").isin(*event_names.values()) & passes).select(
        _event_period(F.col("event_date"), grain).alias("period"),
        F.col("user_pseudo_id").alias("user"),
        "event_name",
    )


def active_users_from_events(
    raw: DataFrame,
    event_names: Mapping[str, str],
    key: str = "duration",
    min_value: float = 2.0,
    grain: str = "MONTH",
    strict: bool = True,
) -> DataFrame:
    """Distinct users per period for each labelled event, and over all of them.

    One row per (period, user) is kept with a flag per event, instead of one
    distinct count per label, which would copy every row once per label. A very
    active user collapses before the shuffle. Events without a user keep their
    period but count nowhere.
    """
    events = qualifying_events(raw, event_names, key, min_value, grain, strict)
    known = F.col("user").isNotNull()
    per_user = events.groupBy("period", "user").agg(
        *[
            F.max(F.when(known & (F.col("event_name") == name), 1).otherwise(0)).alias(f"active_{label}")
            for label, name in event_names.items()
        ]
    )
    return (
        per_user.groupBy("period")
        .agg(
            *[F.sum(f"active_{label}").alias(f"active_{label}") for label in event_names],
            F.count("user").alias("total_active"),
        )
        .orderBy("period")
    )


def distinct_users(
    raw: DataFrame,
    event_names: Mapping[str, str],
    key: str = "duration",
    min_value: float = 2.0,
    grain: str = "MONTH",
    strict: bool = True,
) -> DataFrame:
    """Distinct ``(period, user)`` pairs of the qualifying events."""
    events = qualifying_events(raw, event_names, key, min_value, grain, strict)
    return events.select("period", "user").distinct()


def user_bitmaps(
    raw: DataFrame,
    event_names: Mapping[str, str],
    key: str = "duration",
    min_value: float = 2.0,
    grain: str = "DAY",
    strict: bool = True,
) -> DataFrame:
    """``(period, bucket, users_<label>..., users_total)``: the distinct users of a period as bitmaps.

    A row covers 32,768 user numbers, so a period takes as many rows as the numbers have buckets, and an
    active user is one bit however many events they have; bits are set before the shuffle. Users must be
    whole numbers. Events without a user keep their period in a row without bits.
    """
    events = qualifying_events(raw, event_names, key, min_value, grain, strict)
    number = F.col("user").try_cast("bigint")
    complaint = F.raise_error(F.concat(F.lit("not a user number: "), F.col("user"))).cast("bigint")
    numbered = events.withColumn("_number", F.when(F.col("user").isNotNull() & number.isNull(), complaint).otherwise(number))
    bit = F.bitmap_bit_position("_number")
    return numbered.groupBy("period", F.bitmap_bucket_number("_number").alias("bucket")).agg(
        *[
            F.bitmap_construct_agg(F.when(F.col("event_name") == name, bit)).alias(f"users_{label}")
            for label, name in event_names.items()
        ],
        F.bitmap_construct_agg(bit).alias("users_total"),
    )


def active_users_from_bitmaps(bitmaps: DataFrame, grain: str | None = "MONTH") -> DataFrame:
    """Distinct users per coarser period from the bitmaps of finer ones, or with no grain of all periods together.

    A user of two days is one bit of both and of their union, so nothing counts twice and no event is
    read again.
    """
    columns = [c for c in bitmaps.columns if c.startswith("users_")]
    period = F.lit(None).cast("date")
    if grain is not None:
        name = grain_name(grain)
        if name != "DAY" and name not in CALENDAR_GRAINS:
            raise ValueError("bitmaps are kept by day; use DAY or a coarser grain")
        period = F.col("period") if name == "DAY" else F.trunc(F.col("period"), CALENDAR_GRAINS[name])
    united = bitmaps.groupBy(period.alias("period"), "bucket").agg(*[F.bitmap_or_agg(c).alias(c) for c in columns])
    counted = united.groupBy("period").agg(
        *[
            F.sum(F.bitmap_count(c)).alias("total_active" if c == "users_total" else f"active_{c.removeprefix('users_')}")
            for c in columns
        ]
    )
    return counted.orderBy("period") if grain is not None else counted.drop("period")


USER_COUNTS = (
    "active_audio_users",
    "active_video_users",
    "active_livestream_users",
    "total_active_users",
)


def active_users_by_month(
    users: DataFrame, since: str | date, counts: tuple[str, ...] = USER_COUNTS
) -> DataFrame:
    """Counts summed over countries (a user seen in two countries counts twice)."""
    month = month_start(users)
    return (
        users.filter(since_month(month, since))
        .groupBy(month.alias("month"))
        .agg(*[F.sum(c).alias(c) for c in counts])
        .orderBy("month")
    )


def active_users_lookup(users: DataFrame, month: str | date, country: str) -> DataFrame:
    """The row of one month and country."""
    return users.filter((month_start(users) == month_literal(month)) & (F.col("country") == country))
