"""Small in-memory inputs with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallywell.functions.bins import DURATION_BINS, FINE_BINS
from tallywell.operators import durations, histograms, reconcile, sweeps, totals
from tallywell.sources.tables import bin_counts, stack, tag, target_histogram, target_series
from tests import golden as G

MIDPOINTS = [30, 100, 400, 700, 1000, 1300, 1600, 2000, 10000, 50000, 100000]
DAY = 86_400_000_000


def weighted(spark, counts):
    """Monthly rows whose mean falls in each bin, weighted by the bin's count."""
    rows = [(float(v), n) for v, n in zip(MIDPOINTS, counts)]
    return spark.createDataFrame(rows, "mean_duration_sec double, num_tracks bigint")


def shares(spark, counts, scenario=None):
    out = histograms.histogram_from_aggregate(weighted(spark, counts))
    return out if scenario is None else out.withColumn("scenario", F.lit(scenario))


def test_histogram_shares(spark):
    rows = shares(spark, G.COUNTS_ALL).collect()
    assert [r["bin"] for r in rows] == list(DURATION_BINS.labels)
    assert [r["cnt"] for r in rows] == G.COUNTS_ALL
    assert [r["pct"] for r in rows] == G.SHARES_ALL


def test_scenario_scores(spark):
    hist = stack(
        [
            shares(spark, G.COUNTS_BEST, "best"),
            shares(spark, G.COUNTS_REFRESH, "refresh"),
            shares(spark, G.COUNTS_ALL, "all"),
        ]
    )
    rows = reconcile.scenario_scores(hist, target_histogram(spark, G.AUDIO_TARGET)).collect()
    assert [r["scenario"] for r in rows] == ["best", "refresh", "all"]
    assert (rows[0]["sse"], rows[0]["max_abs_diff"]) == (G.BEST_SSE, G.BEST_MAX_ABS)
    assert (rows[1]["sse"], rows[1]["max_abs_diff"]) == (G.REFRESH_SSE, G.REFRESH_MAX_ABS)
    assert (rows[2]["sse"], rows[2]["max_abs_diff"]) == (G.ALL_SSE, G.ALL_MAX_ABS)


def test_scenario_deltas(spark):
    target = target_histogram(spark, G.AUDIO_TARGET)
    rows = reconcile.scenario_deltas(shares(spark, G.COUNTS_BEST, "best"), target).collect()
    assert [r["bin"] for r in rows] == list(DURATION_BINS.labels)
    assert rows[0]["delta"] == -5.6302336662872321e-06
    assert rows[7]["pct"] == 0.0069814377276315228


def test_cutoff_comparison(spark):
    """Counts scaled down a thousandfold keep the shape; shares come from the counts."""
    small_all = [max(1, n // 2000) for n in G.COUNTS_ALL]
    small_cut = [min(a, n // 2000) for a, n in zip(small_all, G.COUNTS_REFRESH)]
    rows = [
        (1 if i < cut else 2, float(v))
        for v, n, cut in zip(MIDPOINTS, small_all, small_cut)
        for i in range(n)
    ]
    events = spark.createDataFrame(rows, "event_timestamp bigint, duration_sec double")
    got = histograms.histogram_cutoff_comparison(events, "1970-01-01 00:00:00.000002").collect()
    total_all, total_cut = sum(small_all), sum(small_cut)
    assert [r["cnt_all"] for r in got] == small_all
    assert [r["cnt_cutoff"] for r in got] == small_cut
    for r, n, c in zip(got, small_all, small_cut):
        assert r["pct_all"] == n / total_all
        assert r["pct_cutoff"] == (c / total_cut if c else None)
        assert r["pct_delta"] == (n / total_all - c / total_cut if c else None)


def test_known_snapshot_deltas(spark):
    both = shares(spark, G.COUNTS_ALL).select("bin_ord", F.col("pct").alias("a")).join(
        shares(spark, G.COUNTS_REFRESH).select("bin_ord", F.col("pct").alias("b")), "bin_ord"
    )
    rows = both.orderBy("bin_ord").collect()
    assert [r["a"] for r in rows] == G.SHARES_ALL
    assert [r["b"] for r in rows] == G.SHARES_REFRESH
    assert [r["a"] - r["b"] for r in rows] == G.SHARE_DELTAS


def test_series_match(spark):
    got = target_series(spark, dict(zip(G.SERIES_MONTHS, G.MEAN_GOT))).withColumnRenamed("target", "got")
    target = target_series(spark, dict(zip(G.SERIES_MONTHS, G.MEAN_TARGET)))
    compared = reconcile.series_compare(got, target, tol=1e-12)
    assert not any(r["mismatch"] for r in compared.collect())
    summary = reconcile.series_summary(compared).first()
    assert summary["overall_match"] and summary["compared"] == 7
    assert summary["max_abs_delta"] == 8.526512829121202e-14


def test_series_mismatch(spark):
    got = target_series(spark, dict(zip(G.SERIES_MONTHS, G.MEAN_GOT))).withColumnRenamed("target", "got")
    target = target_series(spark, dict(zip(G.SERIES_MONTHS, G.OLD_MEAN_TARGET)))
    compared = reconcile.series_compare(got, target, tol=1e-4)
    assert all(r["mismatch"] for r in compared.collect())
    assert reconcile.series_summary(compared).first()["overall_match"] is False


def monthly(spark, column):
    rows = [
        (month, tracks[column], seconds[column])
        for (month, *tracks), seconds in zip(G.MONTHLY_TRACKS, G.MONTHLY_SECONDS)
    ]
    return spark.createDataFrame(rows, "month string, num_tracks bigint, total_duration_sec double")


def test_totals(spark):
    sources = {s: monthly(spark, i) for i, s in enumerate(("audio", "video", "livestream"))}
    by_month = totals.recording_totals_by_month(sources, "2025-09").collect()
    assert [
        (r["month"].strftime("%Y-%m"), r["audio_tracks"], r["video_tracks"], r["livestream_tracks"])
        for r in by_month
    ] == G.MONTHLY_TRACKS
    grand = totals.recording_grand_totals(sources).first()
    assert tuple(grand[f"{s}_tracks"] for s in sources) == G.GRAND_TRACKS
    for s, hours in zip(sources, G.GRAND_HOURS):
        assert grand[f"{s}_hours"] == pytest.approx(hours, rel=1e-13)


COUNT_NAMES = {"recording": "num_tracks", "imports": "num_imports", "exports": "num_exports"}


def trend_tables(spark):
    return {
        source: spark.createDataFrame(
            list(zip(G.SERIES_MONTHS, values)), f"month string, {COUNT_NAMES[source.split('_')[1]]} bigint"
        )
        for source, values in G.TREND.items()
    }


def test_trend(spark):
    rows = totals.six_source_trend(trend_tables(spark), "2025-09-01", "2026-05-01").collect()
    assert [r["month"] for r in rows] == G.SERIES_MONTHS
    for source, values in G.TREND.items():
        assert [r[source] for r in rows] == values


def test_numeric_grand_totals(spark):
    tables = {k: v for k, v in trend_tables(spark).items() if k in ("audio_imports", "audio_exports")}
    rows = {r["source"]: r for r in totals.numeric_grand_totals(tables).collect()}
    assert rows["audio_imports"]["num_imports"] == G.AUDIO_IMPORT_TOTAL
    assert rows["audio_imports"]["num_exports"] is None
    assert rows["audio_exports"]["num_exports"] == G.AUDIO_EXPORT_TOTAL


def fine(spark, counts):
    highs = [*FINE_BINS.lower[1:], FINE_BINS.upper]
    return bin_counts(spark, zip(FINE_BINS.labels, FINE_BINS.lower, highs, counts))


def test_interpolated_median(spark):
    counts = stack([tag(fine(spark, G.VIDEO_FINE), "video"), tag(fine(spark, G.AUDIO_FINE), "audio")])
    rows = {r["source"]: r for r in histograms.interpolated_median(counts, "source").collect()}
    assert rows["video"]["median"] == pytest.approx(20.939231, abs=5e-7)
    assert rows["audio"]["median"] == pytest.approx(14.025392, abs=5e-7)
    assert rows["video"]["bin"] == "20-26s" and rows["video"]["total"] == sum(G.VIDEO_FINE)
    whole = histograms.interpolated_median(fine(spark, G.AUDIO_FINE), total=23_948_792).first()
    below = sum(G.AUDIO_FINE[:4])  # recordings under 20 s; the next bin is 6 s wide
    by_hand = 20 + (23_948_792 / 2 - below) / G.AUDIO_FINE[4] * 6
    assert whole["median"] == pytest.approx(by_hand) and whole["bin"] == "20-26s"


def test_cumulative_distribution(spark):
    rows = histograms.cumulative_distribution(fine(spark, G.VIDEO_FINE)).collect()
    assert [r["bin"] for r in rows if r["is_median_bin"]] == ["20-26s"]
    assert rows[-1]["cumulative"] == sum(G.VIDEO_FINE) and rows[-1]["cumulative_pct"] == 100.0


def test_unit_ratio(spark):
    monthly_rows = spark.createDataFrame(
        [("2025-11", 93.36897325747668), ("2025-12", 86.9742738295131)],
        "month string, mean_duration_sec double",
    )
    rows = durations.unit_ratio_check(monthly_rows, "2025-11", 17459.998).collect()
    assert rows[0]["ratio_to_target"] == pytest.approx(187.0000000091236, rel=1e-12)
    assert rows[0]["avg_hr"] == pytest.approx(0.025935825904854635, rel=1e-14)
    assert rows[1]["ratio_to_target"] is None


def sweep_events(spark):
    """Bin counts of the best cutoff scaled down, then noise that only makes it worse."""
    scaled = [max(1, n // 20_000) for n in G.COUNTS_BEST]
    rows = [
        (day * DAY + i * 1_000_000, float(v))
        for v, n in zip(MIDPOINTS, scaled)
        for i in range(n)
        for day in (0, 1)
    ]
    rows += [(2 * DAY + i * 1_000_000, 30.0) for i in range(50)]
    total = 2 * sum(scaled)
    target = {b: 2 * n / total for b, n in zip(DURATION_BINS.labels, scaled)}
    return spark.createDataFrame(rows, "event_timestamp bigint, duration_sec double"), target, total


def test_sweep_finds_the_snapshot(spark):
    events, target, total = sweep_events(spark)
    best = sweeps.cutoff_sweep(events, target_histogram(spark, target), "DAY").first()
    # Days 0 and 1 hold the same histogram, so both score 0 and the earlier day wins.
    assert best["sse"] == 0.0 and best["total_rows"] == total // 2
    assert best["include_through"].isoformat() == "1970-01-01T00:00:00"
    assert best["cutoff_exclusive"].isoformat() == "1970-01-02T00:00:00"
    deltas = sweeps.best_cutoff_deltas(
        sweeps.cutoff_sweep(events, target_histogram(spark, target), "DAY"),
        target_histogram(spark, target),
    ).collect()
    assert [r["delta"] for r in deltas] == [0.0] * 11
