"""Finding the data snapshot that explains a histogram.

Every period is tried as the last one included: running bin counts, their
squared error against the target, and the earliest period with the least
error. The running sums are over periods, after the events were counted per
period and bin map-side; below the hour they are taken in two levels so that no
task orders more than one slice of the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywell.functions.bins import DURATION_BINS, BinSpec
from tallywell.functions.periods import (
    FIXED_GRAINS,
    ONE_DAY,
    Instant,
    epoch_micros,
    floor_to,
    grain_name,
    micros_of,
    within,
)
from tallywell.sources.tables import stack, tag

# Periods per ordered window stay below 86,400; coarser grains are few enough
# (8,784 hours a year) to be ordered in one.
SLICES = {"SECOND": ONE_DAY, "MINUTE": 30 * ONE_DAY}


def _size(grain: str) -> int:
    name = grain_name(grain)
    if name not in FIXED_GRAINS:
        raise ValueError("a sweep needs periods of fixed length: SECOND, MINUTE, HOUR or DAY")
    return FIXED_GRAINS[name]


def _count_columns(bins: BinSpec) -> list[str]:
    return [f"bin_{i}" for i in bins.ordinals]


def _counts_per_period(
    events: DataFrame, grain: str, bins: BinSpec, clamp: Instant | None
) -> DataFrame:
    """``(source, period, bin_1, ...)``: one row per period with a counter per bin.

    With ``clamp`` everything before it is counted in one base period just in
    front of it, so the same pass yields the base and the window.
    """
    size = _size(grain)
    start = floor_to(micros_of(events, "event_timestamp"), size)
    if clamp is not None:
        start = F.greatest(start, F.lit(_base_period(clamp, size)).cast("bigint"))
    rows = events.filter(F.col("event_timestamp").isNotNull()).select(
        "source", start.alias("period"), bins.ordinal(F.col("duration_sec")).alias("bin_ord")
    )
    return rows.groupBy("source", "period").agg(
        *[
            F.expr(f"count_if(bin_ord = {i}) AS {name}")
            for i, name in zip(bins.ordinals, _count_columns(bins))
        ]
    )


def _base_period(clamp: Instant, size: int) -> int:
    start = epoch_micros(clamp)
    return (start // size) * size - size


def _running(counts: DataFrame, grain: str, bins: BinSpec) -> DataFrame:
    """Replace the counters by their running sums over the periods of a source."""
    names = _count_columns(bins)
    slice_size = SLICES.get(grain_name(grain))
    if slice_size is None:
        upto = Window.partitionBy("source").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns({c: F.sum(c).over(upto) for c in names})

    # Events without a time are gone, so a slice is never NULL. Saying so keeps the
    # join from pushing a NULL filter into one of its sides, and the two sides
    # then share the one counting pass over the events.
    slice_start = F.coalesce(floor_to(F.col("period"), slice_size), F.lit(0).cast("bigint"))
    sliced = counts.withColumn("slice", slice_start)
    earlier = (
        Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        sliced.groupBy("source", "slice")
        .agg(*[F.expr(f"sum({c}) AS {c}") for c in names])
        .select(
            F.col("source").alias("of"),
            F.col("slice").alias("at"),
            *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in names],
        )
    )
    upto = (
        Window.partitionBy("source", "slice").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = sliced.withColumns({c: F.sum(c).over(upto) for c in names})
    # Both sides are hashed by (source, slice) already, so the join adds no shuffle.
    joined = inside.join(offsets, (F.col("source") == F.col("of")) & (F.col("slice") == F.col("at")))
    return joined.selectExpr("source", "period", *[f"{c} + before_{c} AS {c}" for c in names])


def _scored(running: DataFrame, target: DataFrame, grain: str, bins: BinSpec) -> DataFrame:
    """Add total, squared error and largest difference; bins without a target do not score."""
    names = _count_columns(bins)
    goals = target.agg(
        *[
            F.max(F.when(F.col("bin") == label, F.col("target"))).alias(f"goal_{i}")
            for i, label in zip(bins.ordinals, bins.all_labels)
        ]
    )
    deltas = [
        f"coalesce(coalesce(try_divide({name}, total_rows), 0.0D) - goal_{i}, 0.0D) AS delta_{i}"
        for i, name in zip(bins.ordinals, names)
    ]
    squares = " + ".join(f"delta_{i} * delta_{i}" for i in bins.ordinals)
    largest = ", ".join(f"abs(delta_{i})" for i in bins.ordinals)
    return (
        running.crossJoin(F.broadcast(goals))
        .selectExpr("*", f"{' + '.join(names)} AS total_rows")
        .selectExpr("source", "period", "total_rows", *names, *deltas)
        .selectExpr(
            "source",
            "timestamp_micros(period) AS include_through",
            f"timestamp_micros(period + {_size(grain)}L) AS cutoff_exclusive",
            f"{squares} AS sse",
            f"greatest({largest}, 0.0D) AS max_abs_diff",
            "total_rows",
            *names,
        )
    )


def _sweep(
    events: DataFrame,
    target: DataFrame,
    grain: str,
    bins: BinSpec,
    start: Instant | None = None,
) -> DataFrame:
    counts = _counts_per_period(events, grain, bins, start)
    scored = _scored(_running(counts, grain, bins), target, grain, bins)
    if start is None:
        return scored
    first = _base_period(start, _size(grain)) + _size(grain)
    return scored.filter(F.col("include_through") >= F.timestamp_micros(F.lit(first).cast("bigint")))


def _best(scored: DataFrame) -> DataFrame:
    """Least squared error per source; the earliest period wins ties."""
    row = F.struct(*[c for c in scored.columns if c != "source"])
    best = scored.groupBy("source").agg(F.min_by(row, F.struct("sse", "include_through")).alias("best"))
    return best.select("source", "best.*")


def cutoff_sweep_detail(
    sources: Mapping[str, DataFrame], target: DataFrame, grain: str = "HOUR",
    bins: BinSpec = DURATION_BINS,
) -> DataFrame:
    """Every period of every source as a candidate cutoff, with its score."""
    return _sweep(_tagged(sources), target, grain, bins).orderBy("source", "include_through")


def cutoff_sweep_sources(
    sources: Mapping[str, DataFrame], target: DataFrame, grain: str = "HOUR",
    bins: BinSpec = DURATION_BINS,
) -> DataFrame:
    """The best cutoff of each source.

    ``include_through`` is the last period counted and ``cutoff_exclusive`` the
    first instant left out. ``bin_1`` ... are the counts at the best cutoff.
    """
    return _best(_sweep(_tagged(sources), target, grain, bins)).orderBy("source")


def cutoff_sweep(
    events: DataFrame, target: DataFrame, grain: str = "HOUR", bins: BinSpec = DURATION_BINS
) -> DataFrame:
    """The best cutoff of one source: no row when there are no events."""
    return _best(_sweep(_tagged({"events": events}), target, grain, bins)).drop("source")


def cutoff_refine(
    events: DataFrame,
    target: DataFrame,
    start: Instant,
    end: Instant,
    grain: str = "SECOND",
    bins: BinSpec = DURATION_BINS,
) -> DataFrame:
    """The best cutoff inside ``[start, end)``, on top of everything before ``start``."""
    early = events.filter(within(events, "event_timestamp", None, end))
    return _best(_sweep(_tagged({"events": early}), target, grain, bins, start)).drop("source")


def best_cutoff_deltas(
    best: DataFrame, target: DataFrame, bins: BinSpec = DURATION_BINS
) -> DataFrame:
    """The winning histogram bin by bin: ``(bin, cnt, pct, target, delta)``.

    The winning row already holds its counts, so nothing is counted again.
    """
    entries = [
        F.struct(F.lit(label).alias("bin"), F.lit(i).alias("bin_ord"), F.col(name).alias("cnt"))
        for i, label, name in zip(bins.ordinals, bins.all_labels, _count_columns(bins))
    ]
    unfolded = best.select("total_rows", F.inline(F.array(*entries)))
    share = F.coalesce(F.try_divide(F.col("cnt"), F.col("total_rows")), F.lit(0.0))
    return (
        unfolded.withColumn("pct", share)
        .join(target, "bin")
        .select("bin", "bin_ord", "cnt", "pct", "target", (F.col("pct") - F.col("target")).alias("delta"))
        .orderBy("bin_ord")
        .drop("bin_ord")
    )


def _tagged(sources: Mapping[str, DataFrame]) -> DataFrame:
    return stack(
        tag(df.select("event_timestamp", "duration_sec"), label) for label, df in sources.items()
    )

