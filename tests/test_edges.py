"""Semantics that are easy to get wrong."""

from __future__ import annotations

import math
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallywell.functions.bins import DURATION_BINS, FINE_BINS, BinSpec
from tallywell.functions.numbers import at_least, parse_number
from tallywell.functions.periods import before, epoch_micros, period, within
from tallywell.operators import durations, histograms, reconcile, sweeps, totals, users
from tallywell.sources import tables
from tallywell.sources.tables import RAW_EVENTS_SCHEMA

EVENTS = "event_timestamp bigint, duration_sec double"
HOUR = 3_600_000_000
NAMES = {"audio": "a", "video": "v", "livestream": "l"}


def utc(text: str) -> int:
    return epoch_micros(text)


# --- bins -------------------------------------------------------------------------------


def test_bins_own_their_lower_edge(spark):
    values = [-5.0, 0.0, 59.999, 60.0, 300.0, 1800.0, 3600.0, 86399.9, 86400.0, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r["b"] for r in df.select(DURATION_BINS.label(DURATION_BINS.ordinal(F.col("x"))).alias("b")).collect()]
    assert got == [
        "0-1m", "0-1m", "0-1m", "1-5m", "5-10m", "0.5-1h", "1-8h", "8-24h", ">24h", ">24h", ">24h",
    ]


def test_null_bin_is_optional(spark):
    bins = DURATION_BINS.with_null_bin("unknown")
    df = spark.createDataFrame([(1, None), (2, math.nan), (3, 5.0)], EVENTS)
    rows = [(r["bin"], r["cnt"]) for r in histograms.duration_histogram(df, bins).collect()]
    assert rows == [("0-1m", 1), ("unknown", 2)]


def test_bounded_bins_leave_the_rest_out(spark):
    df = spark.createDataFrame([(1, v) for v in (-1.0, 0.0, 2.0, 59.9, 60.0, math.nan, None)], EVENTS)
    counts = {r["label"]: r["count"] for r in histograms.fine_bin_counts(df).collect()}
    assert len(counts) == 11 and sum(counts.values()) == 3
    assert counts["0-2s"] == 1 and counts["2-8s"] == 1 and counts["56-60s"] == 1
    rows = histograms.duration_histogram(df, FINE_BINS).collect()
    assert [r["cnt"] for r in rows] == [1, 1, 1]


def test_bin_spec_checks_itself():
    with pytest.raises(ValueError):
        BinSpec(("a",), (0, 1))
    with pytest.raises(ValueError):
        BinSpec(("a", "b"), (1, 1))


def test_unknown_labels_sort_last(spark):
    got = spark.range(1).select(
        DURATION_BINS.ordinal_of_label(F.lit("nope")).alias("a"),
        DURATION_BINS.ordinal_of_label(F.lit("0.5-1h")).alias("b"),
    ).first()
    assert (got["a"], got["b"]) == (99, 8)


def test_bin_table(spark):
    rows = FINE_BINS.table(spark).collect()
    assert (rows[0]["label"], rows[0]["lo"], rows[-1]["hi"]) == ("0-2s", 0.0, 60.0)
    assert DURATION_BINS.table(spark).collect()[-1]["hi"] is None


def test_empty_histogram(spark):
    assert histograms.duration_histogram(spark.createDataFrame([], EVENTS)).collect() == []


# --- time -------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["bigint", "timestamp", "timestamp_ntz"])
def test_time_filters_in_every_stored_type(spark, kind):
    micros = [utc("2024-01-31 23:59:59.999999"), utc("2024-02-01"), utc("2024-02-29 12:00:00")]
    df = spark.createDataFrame([(m,) for m in micros], "m bigint")
    moment = {"bigint": F.col("m")}.get(kind, F.timestamp_micros("m").cast(kind if kind != "bigint" else "timestamp"))
    df = df.select("m", moment.alias("t"))
    assert df.filter(before(df, "t", "2024-02-01")).count() == 1
    assert df.filter(within(df, "t", date(2024, 2, 1), datetime(2024, 2, 29, 12))).count() == 1
    months = [r["p"] for r in df.select(period(df, "t", "MONTH").alias("p")).collect()]
    assert months == [date(2024, 1, 1), date(2024, 2, 1), date(2024, 2, 1)]


@pytest.mark.parametrize(
    ("grain", "expected"),
    [
        ("SECOND", datetime(1969, 12, 31, 23, 59, 58)),
        ("MINUTE", datetime(1969, 12, 31, 23, 59)),
        ("HOUR", datetime(1969, 12, 31, 23)),
        ("DAY", date(1969, 12, 31)),
        ("MONTH", date(1969, 12, 1)),
        ("QUARTER", date(1969, 10, 1)),
        ("YEAR", date(1969, 1, 1)),
    ],
)
def test_periods_before_the_epoch(spark, grain, expected):
    df = spark.createDataFrame([(-1_500_000,)], "t bigint")
    assert df.select(period(df, "t", grain).alias("p")).first()["p"] == expected


def test_bigint_periods_ignore_the_session_zone(spark):
    df = spark.createDataFrame([(utc("2024-01-31 23:30:00"),)], "t bigint")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert df.select(period(df, "t", "MONTH").alias("p")).first()["p"] == date(2024, 1, 1)
        assert df.filter(before(df, "t", "2024-02-01")).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unknown_grain_and_type(spark):
    df = spark.createDataFrame([("x",)], "t string")
    with pytest.raises(TypeError):
        before(df, "t", "2024-01-01")
    with pytest.raises(ValueError):
        period(spark.createDataFrame([(1,)], "t bigint"), "t", "FORTNIGHT")


# --- numbers and nested parameters ------------------------------------------------------


def test_nan_fails_a_minimum(spark):
    df = spark.createDataFrame([(2.0,), (1.9,), (math.nan,), (None,)], "x double")
    assert df.filter(at_least(F.col("x"), 2.0)).count() == 1


def raw(spark, *rows):
    """rows: (user, day, event, [(key, number, text), ...])"""
    data = [
        Row(
            user_pseudo_id=user,
            event_date=day,
            event_name=event,
            event_params=None if params is None else [
                Row(key=k, value=Row(double_value=n, string_value=s)) for k, n, s in params
            ],
        )
        for user, day, event, params in rows
    ]
    return spark.createDataFrame(data, RAW_EVENTS_SCHEMA)


def test_active_users(spark):
    df = raw(
        spark,
        ("u1", "20240105", "a", [("duration", 2.0, None)]),
        ("u1", "20240120", "a", [("duration", 9.0, None)]),
        ("u1", "20240121", "v", [("duration", None, "2.5")]),
        ("u2", "20240105", "a", [("other", 50.0, None), ("duration", 1.99, None)]),
        ("u3", "20240105", "v", [("duration", 1.0, "3")]),  # either value may pass
        ("u4", "20240105", "l", []),
        ("u5", "20240105", "l", None),
        ("u6", "20240105", "zzz", [("duration", 9.0, None)]),
        (None, "20240105", "l", [("duration", 9.0, None)]),  # counts as no user
        ("u7", "20240301", "l", [("duration", 1.0, None), ("duration", 4.0, None)]),
        (None, "20240401", "l", [("duration", 9.0, None)]),
    )
    rows = [tuple(r) for r in users.active_users_from_events(df, NAMES).collect()]
    assert rows == [
        (date(2024, 1, 1), 1, 2, 0, 2),
        (date(2024, 3, 1), 0, 0, 1, 1),
        (date(2024, 4, 1), 0, 0, 0, 0),
    ]
    unnested = users.event_parameters(df, "duration")
    assert unnested.count() == 10
    pairs = {tuple(r) for r in users.distinct_users(df, NAMES).collect()}
    assert (date(2024, 1, 1), "u3") in pairs and len(pairs) == 5


def test_malformed_text_raises_unless_lenient(spark):
    df = raw(
        spark,
        ("u1", "20240105", "a", [("duration", None, "soon")]),
        ("u2", "20240105", "a", [("duration", None, "7")]),
        ("u3", "20240105", "a", [("title", None, "not a number")]),
    )
    with pytest.raises(PySparkException):
        users.active_users_from_events(df, NAMES).collect()
    lenient = users.active_users_from_events(df, NAMES, strict=False).first()
    assert lenient["active_audio"] == 1
    ignored = raw(spark, ("u3", "20240105", "a", [("title", None, "x"), ("duration", 3.0, None)]))
    assert users.active_users_from_events(ignored, NAMES).first()["active_audio"] == 1


def test_parse_number(spark):
    df = spark.createDataFrame([("1e3",), (None,)], "t string")
    assert [r["n"] for r in df.select(parse_number(F.col("t")).alias("n")).collect()] == [1000.0, None]


def test_distinct_over_all_events_is_not_the_sum(spark):
    df = raw(
        spark,
        ("u1", "20240105", "a", [("duration", 5.0, None)]),
        ("u1", "20240105", "v", [("duration", 5.0, None)]),
    )
    row = users.active_users_from_events(df, NAMES, grain="DAY").first()
    assert (row["period"], row["active_audio"], row["active_video"], row["total_active"]) == (date(2024, 1, 5), 1, 1, 1)
    with pytest.raises(ValueError):
        users.active_users_from_events(df, NAMES, grain="HOUR")


USERS = (
    "month date, country string, active_audio_users bigint, active_video_users bigint, "
    "active_livestream_users bigint, total_active_users bigint"
)


def test_users_by_month_and_lookup(spark):
    df = spark.createDataFrame(
        [
            (date(2025, 8, 1), "India", 9, 9, 9, 9),
            (date(2025, 9, 1), "India", 3, 1, 0, 4),
            (date(2025, 9, 1), "", 2, 0, 1, 3),
        ],
        USERS,
    )
    assert [tuple(r) for r in users.active_users_by_month(df, "2025-09").collect()] == [(date(2025, 9, 1), 5, 1, 1, 7)]
    assert users.active_users_lookup(df, "2025-09", "India").first()["total_active_users"] == 4
    assert users.active_users_lookup(df, date(2025, 9, 1), "").count() == 1


# --- totals -----------------------------------------------------------------------------

MONTHLY = "month date, country string, num_tracks bigint, total_duration_sec double"


def test_month_on_one_side_only_is_zero_filled(spark):
    a = spark.createDataFrame([(date(2025, 9, 1), "x", 5, 50.0)], MONTHLY)
    b = spark.createDataFrame([(date(2025, 10, 1), "x", 7, 70.0)], MONTHLY)
    rows = [tuple(r) for r in totals.recording_totals_by_month({"a": a, "b": b}, "2025-09").collect()]
    assert rows == [(date(2025, 9, 1), 5, 0, 50.0, 0.0), (date(2025, 10, 1), 0, 7, 0.0, 70.0)]


def test_empty_source_has_no_grand_total(spark):
    a = spark.createDataFrame([(date(2025, 9, 1), "x", 5, 3600.0)], MONTHLY)
    row = totals.recording_grand_totals({"a": a, "b": a.limit(0)}).first()
    assert tuple(row) == (5, None, 1.0, None)


def test_lookup_by_source(spark):
    a = spark.createDataFrame([(date(2025, 9, 1), "India", 5, 1.0), (date(2025, 9, 1), "Peru", 6, 1.0)], MONTHLY)
    rows = totals.recording_lookup_by_source({"video": a, "audio": a}, "2025-09", "India").collect()
    assert [(r["source"], r["num_tracks"]) for r in rows] == [("audio", 5), ("video", 5)]


def test_three_sources_catch_an_altered_row(spark):
    own = spark.createDataFrame([(date(2025, 9, 1), 5), (date(2025, 10, 1), 6)], "month date, n bigint")
    other = spark.createDataFrame([(date(2025, 9, 1), 5)], "month date, n bigint")
    ref = spark.createDataFrame([(date(2025, 9, 1), 4, 5)], "month date, a bigint, v bigint")
    rows = totals.three_source_vs_reference_delta(
        {"audio": (own, "n"), "video": (other, "n")}, ref, {"audio": "a", "video": "v"}, "2025-09"
    ).collect()
    assert tuple(rows[0])[1:] == (5, 4, 1, 5, 5, 0)
    assert tuple(rows[1])[1:] == (6, None, None, 0, None, None)


def test_month_range_includes_both_ends(spark):
    df = spark.createDataFrame([(f"2025-0{m}", m, "x") for m in range(1, 7)], "month string, num_tracks int, note string")
    rows = totals.numeric_totals_by_month({"t": df}, "2025-02-01", "2025-04-01").collect()
    assert [(r["month"], r["num_tracks"]) for r in rows] == [("2025-02", 2), ("2025-03", 3), ("2025-04", 4)]
    assert "note" not in rows[0].asDict()


def test_numeric_columns_include_decimals_and_can_be_picked(spark):
    df = spark.createDataFrame([(date(2025, 9, 1), 1, 2.0, "x")], "month date, a int, b double, c string")
    df = df.withColumn("d", F.lit("3.5").cast("decimal(38,9)"))
    assert totals.numeric_columns(df) == ["a", "b", "d"]
    assert totals.numeric_columns(df, ["d", "c"]) == ["d"]


def test_preferred_column(spark):
    def frame(schema):
        return spark.createDataFrame([], schema)

    assert totals.preferred_column(frame("month date, num_imports int, num_exports int")) == "num_exports"
    assert totals.preferred_column(frame("month date, other double, more int")) == "other"
    assert totals.preferred_column(frame("month date, name string")) is None


def test_trend_keeps_a_source_without_numbers(spark):
    a = spark.createDataFrame([("2025-09", 5)], "month string, num_tracks bigint")
    b = spark.createDataFrame([("2025-09", "x")], "month string, note string")
    assert [tuple(r) for r in totals.six_source_trend({"a": a, "b": b}, "2025-09", "2025-10").collect()] == [("2025-09", 5, 0)]


def test_samples(spark):
    df = spark.createDataFrame([(date(2025, 9, 1), c, i) for i, c in enumerate("dcba")], "month date, country string, n int")
    assert [r["country"] for r in totals.ordered_sample(df, n=2).collect()] == ["a", "b"]
    assert totals.sample(df, 3).count() == 3


def test_top_countries(spark):
    df = spark.createDataFrame(
        [(date(2025, 11, 1), c, n, 1.0, 1.0, 1.0) for c, n in [("b", 5), ("a", 5), ("c", 9), ("d", 1)]],
        "month date, country string, num_tracks int, mean_duration_sec double, "
        "median_duration_sec double, total_duration_sec double",
    )
    assert [r["country"] for r in totals.top_countries(df, "2025-11", 3).collect()] == ["c", "a", "b"]


# --- durations --------------------------------------------------------------------------

COUNTRY = (
    "month date, country string, num_tracks bigint, total_duration_sec double, "
    "max_duration_sec double, mean_duration_sec double, median_duration_sec double"
)


def country_rows(spark):
    month = date(2025, 11, 1)
    medians = [1.0, 2.0, 10.0, 20.0]
    return spark.createDataFrame(
        [(month, str(i), 10 ** i, 5.0, 3600.0 * i, float(i), m) for i, m in enumerate(medians)], COUNTRY
    )


def test_mean_of_means_and_both_medians(spark):
    df = country_rows(spark)
    approx = durations.mean_approx_median_by_month(df).first()
    exact = durations.mean_exact_median_by_month(df, "2025-11-01", "2025-11-01").first()
    assert approx["mean_duration_sec"] == 1.5 and approx["median_duration_sec"] == 2.0  # an element
    assert exact["median_duration_sec"] == 6.0  # interpolated
    assert durations.mean_median_aggregate_form(df).first() == exact
    both = durations.mean_weighted_vs_unweighted(df).first()
    assert (both["month"], both["mean_avg"], both["median_p50"]) == ("2025-11", 1.5, 6.0)
    assert both["mean_weighted"] == 20.0 / 1111
    assert durations.max_hours_by_month_agg(df).first()["max_duration_hour"] == 3.0


def test_events_vs_table_keeps_one_sided_months(spark):
    events = spark.createDataFrame([(utc("2025-12-05"), 3600.0)], EVENTS)
    rows = durations.events_vs_agg_delta(events, country_rows(spark)).collect()
    assert [r["month"] for r in rows] == [date(2025, 11, 1), date(2025, 12, 1)]
    assert rows[0]["mean_hour_events"] is None and rows[0]["mean_delta_hours"] is None
    assert rows[1]["mean_hour_events"] == 1.0 and rows[1]["mean_hour_agg"] is None
    wide = durations.events_vs_agg_candidates(events, country_rows(spark)).first()
    assert wide["median_max"] == 20.0 / 3600 and wide["median_median"] == 2.0 / 3600


def test_event_stats(spark):
    events = spark.createDataFrame(
        [(utc("2025-12-05"), v) for v in (1.0, 2.0, 10.0, 20.0)] + [(utc("2026-01-01"), None)], EVENTS
    )
    rows = durations.event_stats_by_month(events).collect()
    assert [tuple(r) for r in rows] == [
        (date(2025, 12, 1), 20.0, 20.0 / 3600, 8.25, 6.0),
        (date(2026, 1, 1), None, None, None, None),
    ]
    other = spark.createDataFrame([(utc("2026-02-01"), 4.0)], EVENTS)
    side = durations.event_stats_side_by_side({"a": events, "b": other}).collect()
    assert [(r["a_median_duration_sec"], r["b_median_duration_sec"]) for r in side] == [
        (6.0, None),
        (None, None),  # a month of "a" whose events have no duration
        (None, 4.0),
    ]


# --- reconciliation ---------------------------------------------------------------------


def test_missing_and_nan_are_mismatches(spark):
    got = spark.createDataFrame([("a", 1.0), ("b", math.nan), ("x", 9.0), ("e", 1.5)], "key string, got double")
    target = tables.target_series(spark, {"a": 1.0, "b": 1.0, "c": 1.0, "e": 1.0})
    rows = {r["key"]: r for r in reconcile.series_compare(got, target, tol=0.5).collect()}
    assert set(rows) == {"a", "b", "c", "e"}
    assert [rows[k]["mismatch"] for k in "abce"] == [False, True, True, False]  # 0.5 is within 0.5
    summary = reconcile.series_summary(reconcile.series_compare(got, target, tol=0.5)).first()
    assert summary["overall_match"] is False and summary["mismatches"] == 2


def test_histogram_compare(spark):
    hist = spark.createDataFrame([("0-1m", 0.75), ("1-5m", 0.25)], "bin string, pct double")
    target = tables.target_histogram(spark, {"1-5m": 0.2495, "0-1m": 0.74, ">24h": 0.01})
    rows = reconcile.histogram_compare(hist, target, tol=1e-3).collect()
    assert [(r["bin"], r["mismatch"]) for r in rows] == [("0-1m", True), ("1-5m", False), (">24h", True)]
    assert reconcile.histogram_compare(hist, target).first()["mismatch"] is None


def test_missing_bin_scores_as_zero(spark):
    hist = spark.createDataFrame([("s", "0-1m", 1, 4, 1.0)], "scenario string, bin string, bin_ord int, cnt bigint, pct double")
    target = tables.target_histogram(spark, {"0-1m": 0.5, "1-5m": 0.5})
    row = reconcile.scenario_scores(hist, target).first()
    assert (row["sse"], row["max_abs_diff"]) == (0.5, 0.5)


def test_scenarios_equal_separate_histograms(spark):
    events = spark.createDataFrame([(i * HOUR, float(i * i)) for i in range(200)], EVENTS)
    cut = "1970-01-03"
    scenarios = {
        "all": ("e", None),
        "cut": ("e", lambda df: before(df, "event_timestamp", cut)),
        "ge2": ("e", at_least(F.col("duration_sec"), 2.0)),
        "none": ("e", F.col("duration_sec") < 0),
    }
    got = reconcile.histogram_scenarios({"e": events, "unused": events}, scenarios)
    for name, frame in {
        "all": events,
        "cut": events.filter(before(events, "event_timestamp", cut)),
        "ge2": events.filter("duration_sec >= 2"),
    }.items():
        mine = got.filter(F.col("scenario") == name).select("bin", "bin_ord", "cnt", "pct")
        assert mine.orderBy("bin_ord").collect() == histograms.duration_histogram(frame).collect()
    assert got.filter("scenario = 'none'").count() == 0


def brute_sweep(rows, target, size):
    """Earliest period with the least squared error, over plain Python lists."""
    periods = sorted({t - t % size for t, _ in rows})
    best = None
    for p in periods:
        counts = [0] * 11
        for t, v in rows:
            if t < p + size:
                counts[sum(v >= e for e in DURATION_BINS.lower[1:])] += 1
        total = sum(counts)
        sse = 0.0
        for n, label in zip(counts, DURATION_BINS.labels):
            d = n / total - target[label]
            sse += d * d
        if best is None or sse < best[0]:
            best = (sse, p, counts)
    return best


def sweep_rows():
    import random

    rng = random.Random(3)
    return [(rng.randrange(0, 40 * 86_400) * 1_000_000, rng.expovariate(1 / 900)) for _ in range(700)]


TARGET = dict(zip(DURATION_BINS.labels, [0.07, 0.22, 0.2, 0.15, 0.1, 0.07, 0.06, 0.1, 0.03, 0.0, 0.0]))


@pytest.mark.parametrize(("grain", "size"), [("SECOND", 1_000_000), ("MINUTE", 60_000_000), ("HOUR", HOUR)])
def test_sweep_equals_brute_force(spark, grain, size):
    rows = sweep_rows()
    sse, through, counts = brute_sweep(rows, TARGET, size)
    events = spark.createDataFrame(rows, EVENTS)
    best = sweeps.cutoff_sweep(events, tables.target_histogram(spark, TARGET), grain).first()
    assert best["sse"] == sse
    assert int(best["include_through"].timestamp() * 1e6) == through or epoch_micros(best["include_through"]) == through
    assert [best[f"bin_{i}"] for i in range(1, 12)] == counts


def test_refine_counts_everything_before_the_window(spark):
    rows = sweep_rows()
    start, end = "1970-01-11", "1970-01-15"
    inside = [r for r in rows if r[0] < utc(end)]
    base = [r for r in inside if r[0] < utc(start)]
    best = None
    for p in sorted({t for t, _ in inside if t >= utc(start)}):
        upto = base + [r for r in inside if utc(start) <= r[0] <= p]
        sse = brute_sweep(upto, TARGET, 10**15)[0]
        if best is None or sse < best[0]:
            best = (sse, p, len(upto))
    events = spark.createDataFrame(rows, EVENTS)
    got = sweeps.cutoff_refine(events, tables.target_histogram(spark, TARGET), start, end).first()
    assert (got["sse"], epoch_micros(got["include_through"]), got["total_rows"]) == best


def test_sweep_of_several_sources(spark):
    events = spark.createDataFrame(sweep_rows(), EVENTS)
    target = tables.target_histogram(spark, TARGET)
    rows = sweeps.cutoff_sweep_sources({"b": events, "a": events.filter("duration_sec >= 100")}, target).collect()
    assert [r["source"] for r in rows] == ["a", "b"]
    alone = sweeps.cutoff_sweep(events, target).first()
    assert tuple(rows[1])[1:] == tuple(alone)


def test_sweep_without_events(spark):
    target = tables.target_histogram(spark, TARGET)
    assert sweeps.cutoff_sweep(spark.createDataFrame([], EVENTS), target).collect() == []
    with pytest.raises(ValueError):
        sweeps.cutoff_sweep(spark.createDataFrame([], EVENTS), target, "MONTH")


def test_sweep_ignores_events_without_time(spark):
    events = spark.createDataFrame([(None, 5.0), (0, 5.0)], EVENTS)
    assert sweeps.cutoff_sweep(events, tables.target_histogram(spark, TARGET)).first()["total_rows"] == 1


def test_zero_counts_give_no_median(spark):
    zeros = tables.bin_counts(spark, [("a", 0, 1, 0), ("b", 1, 2, 0)])
    row = histograms.interpolated_median(zeros).first()
    assert row["median"] is None and row["total"] == 0
    short = tables.bin_counts(spark, [("a", 0, 1, 5)])
    assert histograms.interpolated_median(short, total=100).first()["median"] is None
    assert [r["cumulative_pct"] for r in histograms.cumulative_distribution(zeros).collect()] == [None, None]


# --- sources and sinks ------------------------------------------------------------------


def test_shards_are_read_together(spark, tmp_path):
    for day in ("20240101", "20240102", "20240103"):
        raw(spark, ("u", day, "a", [("duration", 3.0, None)])).write.parquet(f"{tmp_path}/events_{day}")
    raw(spark, ("u", "20250101", "a", [])).write.parquet(f"{tmp_path}/other_20250101")
    assert tables.read_shards(spark, str(tmp_path)).count() == 3
    bounded = tables.read_shards(spark, str(tmp_path), first_day="20240102", last_day="20240102")
    assert bounded.count() == 1
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_date,20240102)" in plan


def test_results_are_written(spark, tmp_path):
    df = spark.createDataFrame([("audio", 1), ("video", 2)], "source string, n int")
    tables.write_result(df, f"{tmp_path}/out", partition_by=["source"])
    assert {tuple(r) for r in tables.read_table(spark, f"{tmp_path}/out").select("source", "n").collect()} == {("audio", 1), ("video", 2)}
    df.createOrReplaceTempView("some_view")
    assert tables.read_table(spark, "some_view").count() == 2
    assert tables.columns_of(df) == [("source", "string"), ("n", "int")]


def test_stacking(spark):
    df = spark.createDataFrame([("a",), ("b",)], "bin string")
    assert tables.stack([df, df]).count() == 4
    assert tables.stack_distinct([df, df]).count() == 2
    assert tables.tag(df, "s").columns == ["source", "bin"]
