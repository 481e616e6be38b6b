"""Binned counts with shares, snapshots compared, and medians read off bins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell.functions.bins import DURATION_BINS, FINE_BINS, BinSpec
from tallywell.functions.periods import Instant, before, within
from tallywell.sources.tables import stack_distinct


def binned_counts(
    rows: DataFrame, value: Column, bins: BinSpec, counts: Mapping[str, Column]
) -> DataFrame:
    """``(bin_ord, <counts>)``: one row per bin that occurs, at most one per bin.

    ``counts`` maps names to aggregates. Everything is combined map-side, so a
    task ships a dozen rows whatever it read.
    """
    binned = rows.withColumn("bin_ord", bins.ordinal(value))
    if bins.upper is not None:
        binned = binned.filter(F.col("bin_ord").isNotNull())
    return binned.groupBy("bin_ord").agg(*[agg.alias(name) for name, agg in counts.items()])


def share_within(count: Column, *group: str) -> Column:
    """Count over the sum of counts; NULL when that is 0.

    A window over the binned rows instead of a join with their total, which would
    read the input twice. The frame holds bins, never events.
    """
    return F.try_divide(count, F.sum(count).over(Window.partitionBy(*group)))


def _with_shares(counted: DataFrame, bins: BinSpec) -> DataFrame:
    return counted.select(
        bins.label(F.col("bin_ord")).alias("bin"),
        "bin_ord",
        "cnt",
        share_within(F.col("cnt")).alias("pct"),
    ).orderBy("bin_ord")


def duration_histogram(events: DataFrame, bins: BinSpec = DURATION_BINS) -> DataFrame:
    """``(bin, bin_ord, cnt, pct)`` of ``duration_sec``; empty bins give no row."""
    duration = F.col("duration_sec").cast("double")
    return _with_shares(binned_counts(events, duration, bins, {"cnt": F.count(F.lit(1))}), bins)


def duration_histogram_date_range(
    events: DataFrame, start: Instant, end_exclusive: Instant, bins: BinSpec = DURATION_BINS
) -> DataFrame:
    """The histogram of events on dates ``[start, end_exclusive)``, UTC."""
    return duration_histogram(events.filter(within(events, "event_timestamp", start, end_exclusive)), bins)


def duration_histogram_cutoff(
    events: DataFrame, cutoff: Instant, bins: BinSpec = DURATION_BINS
) -> DataFrame:
    """The histogram of events strictly before ``cutoff``, UTC."""
    return duration_histogram(events.filter(before(events, "event_timestamp", cutoff)), bins)


def histogram_from_aggregate(
    monthly: DataFrame,
    value: str = "mean_duration_sec",
    weight: str = "num_tracks",
    bins: BinSpec = DURATION_BINS,
) -> DataFrame:
    """Monthly rows binned by ``value``, each counting ``weight`` times."""
    return _with_shares(binned_counts(monthly, F.col(value), bins, {"cnt": F.sum(weight)}), bins)


def histogram_cutoff_comparison(
    events: DataFrame, cutoff: Instant, bins: BinSpec = DURATION_BINS
) -> DataFrame:
    """All events against those before ``cutoff``, from one pass.

    A bin without events before the cutoff counts 0 there, but its share and the
    difference of shares stay NULL.
    """
    early = before(events, "event_timestamp", cutoff)
    counted = binned_counts(
        events,
        F.col("duration_sec"),
        bins,
        {"cnt_all": F.count(F.lit(1)), "cnt_cutoff": F.count_if(early)},
    )
    seen = F.when(F.col("cnt_cutoff") > 0, F.col("cnt_cutoff"))
    return (
        counted.select(
            bins.label(F.col("bin_ord")).alias("bin"),
            "bin_ord",
            "cnt_all",
            "cnt_cutoff",
            share_within(F.col("cnt_all")).alias("pct_all"),
            share_within(seen).alias("pct_cutoff"),
        )
        .withColumn("pct_delta", F.col("pct_all") - F.col("pct_cutoff"))
        .orderBy("bin_ord")
        .drop("bin_ord")
    )


def snapshot_comparison(
    first: DataFrame, second: DataFrame, names: tuple[str, str] = ("first", "second"), bins: BinSpec = DURATION_BINS
) -> DataFrame:
    """Two histograms of different rows, bin by bin, over every label that either of them has.

    The distinct union of the labels drives two left joins: a bin that one side lacks counts 0 there,
    while its share and the difference of shares stay NULL. All three are as small as the bins.
    """
    sides = {name: side.select("bin", "cnt", "pct") for name, side in zip(names, (first, second))}
    joined = stack_distinct(side.select("bin") for side in sides.values())
    for name, side in sides.items():
        joined = joined.join(side.withColumnsRenamed({"cnt": f"cnt_{name}", "pct": f"pct_{name}"}), "bin", "left")
    a, b = names
    return joined.select(
        "bin",
        *[F.coalesce(f"cnt_{name}", F.lit(0)).alias(f"cnt_{name}") for name in names],
        *[f"pct_{name}" for name in names],
        (F.col(f"pct_{a}") - F.col(f"pct_{b}")).alias("pct_delta"),
    ).orderBy(bins.ordinal_of_label(F.col("bin")))


def fine_bin_counts(events: DataFrame, bins: BinSpec = FINE_BINS) -> DataFrame:
    """``(label, lo, hi, count)`` for every bin, zeros included; an open bin ends at infinity."""
    ordinal = bins.ordinal(F.col("duration_sec"))
    highs = [*bins.lower[1:], bins.upper]
    counted = events.select(ordinal.alias("bin_ord")).agg(
        *[F.expr(f"count_if(bin_ord = {i}) AS n{i}") for i in range(1, len(bins.labels) + 1)]
    )
    entries = [
        F.struct(
            F.lit(label).alias("label"),
            F.lit(float(lo)).alias("lo"),
            F.lit(float("inf") if hi is None else float(hi)).alias("hi"),
            F.col(f"n{i}").alias("count"),
        )
        for i, (label, lo, hi) in enumerate(zip(bins.labels, bins.lower, highs), start=1)
    ]
    return counted.select(F.inline(F.array(*entries)))


def _running(by: str | None) -> tuple[list[str], Column, Column]:
    group = [] if by is None else [by]
    frame = Window.partitionBy(*group).orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    return group, F.sum("count").over(frame), F.sum("count").over(Window.partitionBy(*group))


def interpolated_median(
    counts: DataFrame, by: str | None = None, q: float = 0.5, total: int | None = None
) -> DataFrame:
    """Quantile by linear interpolation in the first bin whose running count reaches ``q * total``.

    ``total`` replaces the sum of the counts when the bins cover only part of the
    recordings. Counts that are all zero, or a total the bins never reach, give
    a NULL median.
    """
    group, running, whole = _running(by)
    whole = whole if total is None else F.lit(total).cast("bigint")
    wanted = F.lit(float(q)) * F.col("total")
    reached = F.struct("lo", "hi", "label", "count", "cumulative")
    first = (
        counts.withColumns({"cumulative": running, "total": whole})
        .groupBy(*group)
        .agg(
            F.max("total").alias("total"),
            F.min_by(
                F.when(F.col("cumulative") >= wanted, reached),
                F.when(F.col("cumulative") >= wanted, F.col("lo")),
            ).alias("hit"),
        )
    )
    width = F.col("hit.hi") - F.col("hit.lo")
    missing = wanted - (F.col("hit.cumulative") - F.col("hit.count"))
    median = F.col("hit.lo") + F.try_divide(missing, F.col("hit.count")) * width
    return first.select(
        *group,
        median.alias("median"),
        F.col("hit.label").alias("bin"),
        F.col("hit.count").alias("bin_count"),
        F.col("hit.cumulative").alias("cumulative"),
        "total",
    )


def cumulative_distribution(counts: DataFrame, by: str | None = None) -> DataFrame:
    """Running count and percent per bin, marking the bin that holds the median."""
    group, running, whole = _running(by)
    half = F.col("total") / 2.0
    upto = F.col("cumulative")
    return (
        counts.withColumns({"cumulative": running, "total": whole})
        .select(
            *group,
            F.col("label").alias("bin"),
            "lo",
            "count",
            "cumulative",
            (F.try_divide(upto, F.col("total")) * 100).alias("cumulative_pct"),
            ((upto >= half) & (upto - F.col("count") < half)).alias("is_median_bin"),
        )
        .orderBy(*group, "lo")
        .drop("lo")
    )
