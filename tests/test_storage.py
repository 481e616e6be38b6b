"""Shards, day replacement, bitmaps of users, sketches, constant targets and bare limits."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallywell.functions.bins import DURATION_BINS
from tallywell.operators import histograms, reconcile, sketches, totals, users
from tallywell.plans import catalog, oracle
from tallywell.plans.catalog import ReportTables
from tallywell.sources import star, storage, tables
from tests.compare import connect, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def report(spark):
    return ReportTables(spark, SF_DIR)


def test_day_range_prunes_shards(spark, report):
    found = report.shards("20240108", "20240121")
    scan = next(line for line in planned(found).splitlines() if "FileScan" in line)
    assert re.search(r"PartitionFilters: \[.*event_date#\d+ >= 20240108.*event_date#\d+ <= 20240121", scan)
    days = {r[0] for r in found.select("event_date").distinct().collect()}
    assert days == {f"202401{d:02d}" for d in range(8, 22)}
    assert len({f for f in found.inputFiles() if "event_date=20240107" in f}) == 0 or report.shards().count() > found.count()


def test_cutoff_reaches_the_stored_microseconds(spark, report):
    events = report.shard_events("audio")
    assert dict(events.dtypes)["event_timestamp"] == "bigint"
    plan = planned(histograms.duration_histogram_cutoff(events, "2024-01-20 07:00:00"))
    assert "LessThan(event_timestamp,1" in plan  # the plan shortens long lists of filters
    assert "event_timestamp#" in plan and "< 1705734000000000)" in plan
    assert "country" not in plan


def test_shards_keep_rows_without_a_time(spark, tmp_path):
    rows = [(1_704_067_200_000_000 + i, float(i)) for i in range(500)] + [(None, 1.0), (-1, 2.0)]
    events = spark.createDataFrame(rows, "event_timestamp bigint, duration_sec double")
    root = f"{tmp_path}/shards"
    storage.write_shards(events, root, files_per_day=4)
    found = storage.read_day_shards(spark, root, events.schema)
    assert found.count() == 502
    days = {r["event_date"]: r["n"] for r in found.groupBy("event_date").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert days == {"20240101": 500, "19691231": 1, None: 1}
    assert storage.read_day_shards(spark, root, events.schema, "20240101").count() == 500


def test_replacing_a_day_changes_only_that_day(spark, tmp_path):
    path = f"{tmp_path}/days"
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "day string, x int")
    storage.replace_partitions(rows, path, ["day"])
    untouched = {f for f in spark.read.parquet(path).filter("day = 'a'").inputFiles() if "day=a" in f}
    for _ in range(2):
        storage.replace_partitions(spark.createDataFrame([("b", 9), ("c", 4)], "day string, x int"), path, ["day"])
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select("day", "x").collect())) == [("a", 1), ("b", 9), ("c", 4)]
    assert untouched == {f for f in back.inputFiles() if "day=a" in f}
    storage.replace_partitions(rows.limit(0), path, ["day"])
    assert spark.read.parquet(path).count() == 3


def test_work_path_is_fresh_and_shared(spark):
    assert storage.work_path(spark, "x") != storage.work_path(spark, "x")

    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return default

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        storage.work_path(Session(), "x")


NAMES = {"audio": "play", "video": "watch"}


def raw(spark, rows):
    value = "value struct<double_value: double, string_value: string>"
    data = [(user, day, name, [("duration", (seconds, None))]) for user, day, name, seconds in rows]
    return spark.createDataFrame(
        data, f"user_pseudo_id string, event_date string, event_name string, event_params array<struct<key: string, {value}>>"
    )


def test_bitmaps_of_days_unite_to_months(spark):
    rng = random.Random(3)
    numbers = [0, -5, 5, 32767, 32768, 32769, 2**40, -(2**33), *range(100, 160)]
    rows = [
        (str(rng.choice(numbers)), f"2024{rng.choice((1, 2)):02d}{rng.randrange(1, 20):02d}", rng.choice(["play", "watch", "other"]), rng.choice([1.0, 3.0]))
        for _ in range(2000)
    ] + [(None, "20240301", "play", 9.0)]
    bitmaps = users.user_bitmaps(raw(spark, rows), NAMES)
    for grain in ("DAY", "MONTH", "YEAR"):
        got = users.active_users_from_bitmaps(bitmaps, grain)
        want = users.active_users_from_events(raw(spark, rows), NAMES, grain=grain)
        assert list(map(tuple, got.collect())) == list(map(tuple, want.select(*got.columns).collect())), grain
    whole = users.active_users_from_bitmaps(bitmaps, None).first()
    long_enough = {(u, n) for u, _, n, s in rows if u is not None and s >= 2 and n in NAMES.values()}
    assert whole["total_active"] == len({u for u, _ in long_enough})
    assert whole["active_audio"] == len({u for u, n in long_enough if n == "play"})
    with pytest.raises(ValueError):
        users.active_users_from_bitmaps(bitmaps, "HOUR")
    with pytest.raises(PySparkException):
        users.user_bitmaps(raw(spark, [("x1", "20240101", "play", 9.0)]), NAMES).collect()


def test_sketches_roll_up(spark):
    rng = random.Random(4)
    rows = [(f"m{k % 7}", f"c{k % 3}", rng.lognormvariate(2, 2)) for k in range(60_000)]
    rows += [("m0", "c0", None), ("m0", "c0", float("nan")), ("empty", "c0", None), (None, "c1", 5.0)]
    df = spark.createDataFrame(rows, "month string, country string, x double").repartition(6)
    groupings = {"month": ("month",), "country": ("country",), "all": ()}
    kept = sketches.sketch_table(df, ["month", "country"], "x")
    found = sketches.quantiles(sketches.levels(kept, groupings), {"low": 0.1, "median": 0.5, "high": 0.99}).collect()
    assert {(r["level"], r["month"], r["country"]) for r in found} == (
        {("month", f"m{k}", None) for k in range(7)} | {("month", "empty", None), ("month", None, None)}
        | {("country", None, f"c{k}") for k in range(3)} | {("all", None, None)}
    )
    for r in found:
        xs = sorted(
            x for m, c, x in rows
            if x is not None and x == x and (r["level"] != "month" or m == r["month"]) and (r["level"] != "country" or c == r["country"])
        )
        assert (r["n"], r["lowest"], r["highest"]) == (len(xs), min(xs, default=None), max(xs, default=None))
        for name, q in {"low": 0.1, "median": 0.5, "high": 0.99}.items():
            if not xs:
                assert r[name] is None
                continue
            bound = 2 * sketches.rank_error() + 1 / len(xs)
            assert sum(x < r[name] for x in xs) / len(xs) <= q + bound
            assert sum(x <= r[name] for x in xs) / len(xs) >= q - bound
    checked = sketches.rank_check(
        df, groupings, "x", sketches.quantiles(sketches.levels(kept, groupings), {"median": 0.5}), "median", 0.5, 2 * sketches.rank_error()
    ).collect()
    assert len(checked) == 12 and all(r["within"] for r in checked if r["month"] is not None or r["level"] != "month")


def test_rank_check_catches_a_wrong_estimate(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(1000)], "g string, x double")
    wrong = spark.createDataFrame([("g", "a", 540.0)], "level string, g string, median double")
    assert not sketches.rank_check(df, {"g": ("g",)}, "x", wrong, "median", 0.5, 0.01).first()["within"]


def test_sketched_medians_hold_at_a_larger_size(spark):
    folder = "/root/testdata/sf0.1"
    df = catalog.queries()["sketched_medians"](spark, folder)
    columns, want = sql_rows(connect(folder), oracle.oracle_sql()["sketched_medians"])
    assert sorted(columns) == sorted(df.columns) and spark_rows(df) == want


def test_labels_of_one_side_only(spark):
    def histogram(values):
        return histograms.duration_histogram(spark.createDataFrame([(v,) for v in values], "duration_sec double"))

    rows = histograms.snapshot_comparison(histogram([1.0, 2.0, 90.0, 90000.0]), histogram([3.0, 700.0])).collect()
    assert [tuple(r) for r in rows] == [
        ("0-1m", 2, 1, 0.5, 0.5, 0.0),
        ("1-5m", 1, 0, 0.25, None, None),
        ("10-15m", 0, 1, None, 0.5, None),
        (">24h", 1, 0, 0.25, None, None),
    ]


def test_constant_targets(spark):
    target = tables.target_series(spark, {"a": 1.0, "it's": None, "c": 2})
    assert sorted(map(tuple, target.collect())) == [("a", 1.0), ("c", 2.0), ("it's", None)]
    assert "ExistingRDD" not in planned(target)
    assert tables.target_series(spark, {}).collect() == []
    got = spark.createDataFrame([("a", 1.5), ("z", 9.0)], "key string, got double")
    compared = reconcile.series_compare(got, target, tol=1.0).collect()
    assert [(r["key"], r["mismatch"]) for r in compared] == [("a", False), ("c", True), ("it's", True)]
    shares = tables.target_histogram(spark, {label: 0.0 for label in DURATION_BINS.labels})
    assert shares.columns == ["bin", "target"] and shares.count() == len(DURATION_BINS.labels)


def test_bare_limit_stops_the_scan(spark, report):
    plan = planned(totals.sample_facts(report.table("events").select("event_id"), 7))
    below = [line.strip(" :+-*()0123456789") for line in plan.splitlines()]
    at = next(i for i, line in enumerate(below) if line.startswith("LocalLimit"))
    assert "FileScan" in "".join(below[at + 1 : at + 4])
    assert not any("Sort" in line for line in below)
    empty = totals.sample_facts(report.table("events").select("event_id").limit(0), 7).first()
    assert tuple(empty) == (0, 1, 0)


def test_countries_of_event_shards(report):
    located = star.located_events(report.table("events"), report.table("customer"), report.table("nation"))
    assert [f.simpleString() for f in located.schema][:4] == [f.simpleString() for f in tables.RECORDING_EVENTS_SCHEMA]
