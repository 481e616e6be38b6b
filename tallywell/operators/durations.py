"""Maximum, mean and median durations from monthly tables and from events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.functions.numbers import hours
from tallywell.functions.periods import (
    month_literal,
    month_start,
    period,
)
from tallywell.operators.quantiles import distribution
from tallywell.operators.totals import full_join_on, labelled
from tallywell.sources.tables import stack, tag

Month = str | date


def _months(monthly: DataFrame, start: Month | None, end: Month | None) -> DataFrame:
    """Rows between two months, both ends inclusive, with the month as DATE."""
    month = month_start(monthly)
    if start is not None:
        monthly = monthly.filter(month >= month_literal(start))
    if end is not None:
        monthly = monthly.filter(month <= month_literal(end))
    return monthly.withColumn("month", month)


def _mean_and(median: Column, monthly: DataFrame, start: Month | None, end: Month | None) -> DataFrame:
    return (
        _months(monthly, start, end)
        .groupBy("month")
        .agg(F.avg("mean_duration_sec").alias("mean_duration_sec"), median.alias("median_duration_sec"))
        .orderBy("month")
    )


def max_hours_by_month_agg(
    monthly: DataFrame, start: Month | None = None, end: Month | None = None
) -> DataFrame:
    """Longest recording per month in hours, from the monthly table."""
    return (
        _months(monthly, start, end)
        .groupBy("month")
        .agg(hours(F.max("max_duration_sec")).alias("max_duration_hour"))
        .orderBy("month")
    )


def max_hours_by_month_events(events: DataFrame, grain: str = "MONTH") -> DataFrame:
    """Longest recording per period in hours, from the events."""
    return (
        events.groupBy(period(events, "event_timestamp", grain).alias("period"))
        .agg(hours(F.max(F.col("duration_sec").cast("double"))).alias("max_duration_hour"))
        .orderBy("period")
    )


def mean_approx_median_by_month(
    monthly: DataFrame, start: Month | None = None, end: Month | None = None, accuracy: int = 10_000
) -> DataFrame:
    """Unweighted mean of country means, approximate median of country medians.

    The approximate median is always one of the values; its rank is off by at
    most ``rows / accuracy``.
    """
    return _mean_and(F.percentile_approx("median_duration_sec", 0.5, accuracy), monthly, start, end)


def mean_exact_median_by_month(
    monthly: DataFrame, start: Month | None = None, end: Month | None = None
) -> DataFrame:
    """Unweighted mean of country means, exact interpolated median of country medians.

    A month has one row per country, so its values fit the built-in aggregate.
    """
    return _mean_and(F.percentile("median_duration_sec", 0.5), monthly, start, end)


def mean_median_aggregate_form(
    monthly: DataFrame, start: Month | None = None, end: Month | None = None
) -> DataFrame:
    """The same, written with the MEDIAN aggregate."""
    return _mean_and(F.median("median_duration_sec"), monthly, start, end)


def mean_weighted_vs_unweighted(
    monthly: DataFrame, start: Month | None = None, end: Month | None = None
) -> DataFrame:
    """Mean of country means, mean over all recordings, and median of country medians."""
    return (
        _months(monthly, start, end)
        .groupBy(F.date_format("month", "yyyy-MM").alias("month"))
        .agg(
            F.avg("mean_duration_sec").alias("mean_avg"),
            (F.sum("total_duration_sec") / F.sum("num_tracks")).alias("mean_weighted"),
            F.percentile("median_duration_sec", 0.5).alias("median_p50"),
        )
        .orderBy("month")
    )


def weighted_mean_by_source(sources: Mapping[str, DataFrame] | DataFrame) -> DataFrame:
    """Mean over all recordings per source and month; see ``totals.labelled`` for ``sources``."""
    rows = labelled(sources, ["total_duration_sec", "num_tracks"])
    return (
        rows.groupBy("source", F.date_format("month", "yyyy-MM").alias("month"))
        .agg((F.sum("total_duration_sec") / F.sum("num_tracks")).alias("mean_duration_sec"))
        .orderBy("source", "month")
    )


EVENT_STATS = ("max_duration_sec", "max_duration_hour", "mean_duration_sec", "median_duration_sec")


def _event_stats(events: DataFrame, grain: str, keys: Sequence[str] = ()) -> DataFrame:
    """Maximum, mean and exact median per ``keys`` and period.

    All of them come out of one quantile job: the moments ride along with its first
    step, and no period's rows are ever gathered in one task. A period whose
    durations are all NULL has NULL statistics.
    """
    rows = events.select(
        *keys,
        period(events, "event_timestamp", grain).alias("period"),
        F.col("duration_sec").cast("double").alias("duration_sec"),
    )
    spread = distribution(
        rows,
        [*keys, "period"],
        "duration_sec",
        moments=("n", "total", "highest"),
        quantile="median_duration_sec",
    )
    return spread.select(
        *keys,
        "period",
        F.col("highest").alias("max_duration_sec"),
        hours(F.col("highest")).alias("max_duration_hour"),
        (F.col("total") / F.col("n")).alias("mean_duration_sec"),
        "median_duration_sec",
    )


def event_stats_by_month(events: DataFrame, grain: str = "MONTH") -> DataFrame:
    """Maximum, mean and exact median duration per period, from the events."""
    return _event_stats(events, grain).orderBy("period")


def event_stats_side_by_side(
    sides: Mapping[str, DataFrame] | DataFrame, grain: str = "MONTH", names: Sequence[str] | None = None
) -> DataFrame:
    """The event statistics of several sources next to each other; NULL where one has no period.

    The sources are one table labelled by ``source`` (then ``names`` lists them), or are stacked into
    one: a single quantile job serves them all, and the statistics are turned sideways after it.
    """
    if isinstance(sides, DataFrame):
        if names is None:
            raise ValueError("name the sources to show")
        events = sides.filter(F.col("source").isin(*names))
    else:
        names = list(sides)
        events = stack(tag(df.select("event_timestamp", "duration_sec"), label) for label, df in sides.items())
    found = _event_stats(events, grain, ["source"])
    return (
        found.groupBy("period")
        .agg(*[F.max(F.when(F.col("source") == s, F.col(c))).alias(f"{s}_{c}") for s in names for c in EVENT_STATS])
        .orderBy("period")
    )


def _event_hours(events: DataFrame, accuracy: int) -> DataFrame:
    duration = F.col("duration_sec")
    return events.groupBy(period(events, "event_timestamp", "MONTH").alias("month")).agg(
        hours(F.avg(duration)).alias("mean_hour_events"),
        F.percentile_approx(hours(duration), 0.5, accuracy).alias("median_hour_events"),
    )


def _means_and_medians(of: Column) -> list[Column]:
    """Mean over the rows of a monthly table of their means and of their medians, in hours, where ``of`` holds."""
    return [
        F.avg(F.when(of, hours(F.col("mean_duration_sec")))).alias("mean_hour_agg"),
        F.avg(F.when(of, hours(F.col("median_duration_sec")))).alias("median_hour_agg"),
    ]


def _definitions(of: Column, accuracy: int) -> list[Column]:
    """Every definition of a month's mean and median that a monthly table allows, in hours, where ``of`` holds."""
    median = F.when(of, F.col("median_duration_sec"))
    total, count = F.sum(F.when(of, F.col("total_duration_sec"))), F.sum(F.when(of, F.col("num_tracks")))
    return [
        hours(F.try_divide(total, count)).alias("mean_weighted"),
        hours(F.avg(F.when(of, F.col("mean_duration_sec")))).alias("mean_unweighted"),
        hours(F.avg(median)).alias("median_avg"),
        F.percentile_approx(hours(median), 0.5, accuracy).alias("median_median"),
        hours(F.max(median)).alias("median_max"),
        hours(F.min(median)).alias("median_min"),
    ]


def _shown_delta(joined: DataFrame) -> DataFrame:
    return joined.select(
        "month",
        "mean_hour_events",
        "mean_hour_agg",
        (F.col("mean_hour_events") - F.col("mean_hour_agg")).alias("mean_delta_hours"),
        "median_hour_events",
        "median_hour_agg",
        (F.col("median_hour_events") - F.col("median_hour_agg")).alias("median_delta_hours"),
    ).orderBy("month")


def _shown_candidates(joined: DataFrame) -> DataFrame:
    return joined.select(
        "month",
        F.col("mean_hour_events").alias("mean_events"),
        "mean_weighted",
        "mean_unweighted",
        F.col("median_hour_events").alias("median_events"),
        "median_avg",
        "median_median",
        "median_max",
        "median_min",
    ).orderBy("month")


def events_vs_agg_delta(events: DataFrame, monthly: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Mean and median hours from events and from the monthly table, and their differences."""
    table = _months(monthly, None, None).groupBy("month").agg(*_means_and_medians(F.lit(True)))
    return _shown_delta(full_join_on([_event_hours(events, accuracy), table], "month"))


def events_vs_agg_candidates(
    events: DataFrame, monthly: DataFrame, accuracy: int = 10_000
) -> DataFrame:
    """Event mean and median against every definition the monthly table allows, in hours."""
    table = _months(monthly, None, None).groupBy("month").agg(*_definitions(F.lit(True), accuracy))
    return _shown_candidates(full_join_on([_event_hours(events, accuracy), table], "month"))


def _statistics_of_events(of: Column) -> list[Column]:
    """The events' own mean and median; the median is a value that occurs, and exact."""
    return [
        hours(F.max(F.when(of, F.col("mean_duration_sec")))).alias("mean_hour_events"),
        hours(F.max(F.when(of, F.col("middle_duration_sec")))).alias("median_hour_events"),
    ]


def statistics_delta(statistics: DataFrame, events: str = "events") -> DataFrame:
    """``events_vs_agg_delta`` from ready statistics per ``(kind, month, country)``: one kind holds the events
    by month, the others are monthly tables. One grouping; nothing is read or joined again."""
    own = F.col("kind") == events
    return _shown_delta(statistics.groupBy("month").agg(*_statistics_of_events(own), *_means_and_medians(~own)))


def statistics_candidates(statistics: DataFrame, events: str = "events", accuracy: int = 10_000) -> DataFrame:
    """``events_vs_agg_candidates`` from ready statistics; see ``statistics_delta``."""
    own = F.col("kind") == events
    return _shown_candidates(statistics.groupBy("month").agg(*_statistics_of_events(own), *_definitions(~own, accuracy)))


def unit_ratio_check(
    monthly: DataFrame,
    month: Month,
    target: float,
    start: Month | None = None,
    end: Month | None = None,
) -> DataFrame:
    """Mean of country means in several units, and how far ``target`` is from it in one month."""
    mean = F.avg("mean_duration_sec")
    in_month = F.avg(F.when(F.col("month") == month_literal(month), F.col("mean_duration_sec")))
    return (
        _months(monthly, start, end)
        .groupBy("month")
        .agg(
            mean.alias("avg_sec"),
            hours(mean).alias("avg_hr"),
            (mean * 1000.0).alias("avg_ms"),
            (mean / 1000.0).alias("avg_if_ms"),
            (F.lit(float(target)) / in_month).alias("ratio_to_target"),
        )
        .orderBy("month")
        .withColumn("month", F.date_format("month", "yyyy-MM"))
    )
