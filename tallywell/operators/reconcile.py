"""Comparing results with targets: scenarios, scores, series and histograms."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.functions.bins import DURATION_BINS, BinSpec
from tallywell.operators.histograms import binned_counts, share_within
from tallywell.sources.tables import stack

Predicate = Column | Callable[[DataFrame], Column] | None


def _test(df: DataFrame, predicate: Predicate) -> Column:
    if predicate is None:
        return F.lit(True)
    return predicate(df) if callable(predicate) else predicate


def histogram_scenarios(
    sources: Mapping[str, DataFrame],
    scenarios: Mapping[str, tuple[str, Predicate]],
    bins: BinSpec = DURATION_BINS,
) -> DataFrame:
    """``(scenario, bin, bin_ord, cnt, pct)`` for many (source, filter) hypotheses.

    Every source is read once, with one counter per scenario, instead of once per
    scenario; rows no scenario wants are filtered out first, which reaches the
    scan when the filters do.
    """
    parts = []
    for source, df in sources.items():
        tests = {name: _test(df, pred) for name, (of, pred) in scenarios.items() if of == source}
        if not tests:
            continue
        wanted = reduce(lambda a, b: a | b, tests.values())
        counters = {f"s{i}": F.count_if(test) for i, test in enumerate(tests.values())}
        counted = binned_counts(df.filter(wanted), F.col("duration_sec"), bins, counters)
        entries = [
            F.struct(F.lit(name).alias("scenario"), F.col(f"s{i}").alias("cnt"))
            for i, name in enumerate(tests)
        ]
        parts.append(counted.select("bin_ord", F.inline(F.array(*entries))).filter(F.col("cnt") > 0))
    return (
        stack(parts)
        .select(
            "scenario",
            bins.label(F.col("bin_ord")).alias("bin"),
            "bin_ord",
            "cnt",
            share_within(F.col("cnt"), "scenario").alias("pct"),
        )
        .orderBy("scenario", "bin_ord")
    )


def _scored(histograms: DataFrame, target: DataFrame, bins: BinSpec) -> DataFrame:
    """Per scenario the target bins in report order with share, target and difference.

    Both sides are at most one entry per bin, so they travel as arrays: no grid of
    scenarios and bins has to be joined, and a bin a scenario lacks counts as 0.
    """
    ordered = F.sort_array(
        F.collect_list(
            F.struct(bins.ordinal_of_label(F.col("bin")).alias("bin_ord"), "bin", "target")
        )
    )
    goals = target.agg(ordered.alias("goals"))
    shares = histograms.groupBy("scenario").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "pct"))).alias("shares")
    )

    def compare(goal: Column) -> Column:
        share = F.coalesce(F.try_element_at(F.col("shares"), goal["bin"]), F.lit(0.0))
        return F.struct(
            goal["bin_ord"].alias("bin_ord"),
            goal["bin"].alias("bin"),
            share.alias("pct"),
            goal["target"].alias("target"),
            (share - goal["target"]).alias("delta"),
        )

    return shares.crossJoin(F.broadcast(goals)).select(
        "scenario", F.transform("goals", compare).alias("bins")
    )


def scenario_scores(
    histograms: DataFrame, target: DataFrame, bins: BinSpec = DURATION_BINS
) -> DataFrame:
    """Squared error and largest absolute difference of each scenario, best first."""
    squares = F.aggregate("bins", F.lit(0.0), lambda acc, b: acc + b["delta"] * b["delta"])
    largest = F.aggregate("bins", F.lit(0.0), lambda acc, b: F.greatest(acc, F.abs(b["delta"])))
    return (
        _scored(histograms, target, bins)
        .select("scenario", squares.alias("sse"), largest.alias("max_abs_diff"))
        .orderBy("sse", "scenario")
    )


def scenario_deltas(
    histograms: DataFrame, target: DataFrame, bins: BinSpec = DURATION_BINS
) -> DataFrame:
    """The differences behind the scores: one row per scenario and target bin."""
    return (
        _scored(histograms, target, bins)
        .select("scenario", F.inline("bins"))
        .orderBy("scenario", "bin_ord")
        .select("scenario", "bin", "pct", "delta")
    )


def _mismatch(delta: Column, tolerance: float) -> Column:
    """Beyond the tolerance, or not comparable (missing or NaN on either side)."""
    return delta.isNull() | F.isnan(delta) | (F.abs(delta) > F.lit(float(tolerance)))


def series_compare(got: DataFrame, target: DataFrame, tol: float = 1e-9) -> DataFrame:
    """``(key, got, target, delta, mismatch)`` for every target key.

    ``got`` is ``(key, got)`` and ``target`` is ``(key, target)``. Keys only in
    ``got`` are ignored; a missing or NaN value is a mismatch.
    """
    delta = F.col("got") - F.col("target")
    return (
        target.join(got, "key", "left")
        .select("key", "got", "target", delta.alias("delta"), _mismatch(delta, tol).alias("mismatch"))
        .orderBy("key")
    )


def series_summary(compared: DataFrame) -> DataFrame:
    """One row over a comparison: does everything match, and the counts behind it."""
    return compared.agg(
        F.coalesce(F.bool_and(~F.col("mismatch")), F.lit(True)).alias("overall_match"),
        F.count(F.lit(1)).alias("compared"),
        F.count_if("mismatch").alias("mismatches"),
        F.max(F.abs("delta")).alias("max_abs_delta"),
    )


def histogram_compare(
    histogram: DataFrame,
    target: DataFrame,
    tol: float | None = None,
    bins: BinSpec = DURATION_BINS,
) -> DataFrame:
    """``(bin, got, target, delta, mismatch)`` per target bin; no flag without ``tol``."""
    delta = F.col("got") - F.col("target")
    flag = F.lit(None).cast("boolean") if tol is None else _mismatch(delta, tol)
    return (
        target.join(histogram.select("bin", F.col("pct").alias("got")), "bin", "left")
        .select("bin", "got", "target", delta.alias("delta"), flag.alias("mismatch"))
        .orderBy(bins.ordinal_of_label(F.col("bin")))
    )
