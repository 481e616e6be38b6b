"""What the plans must look like to hold at scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_module
from tallywell.functions.periods import before
from tallywell.operators import durations, histograms, users
from tallywell.plans import catalog
from tallywell.plans.catalog import ReportTables
from tallywell.sources import star

SF_DIR = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df) -> str:
    df.collect()
    return planned(df).split("== Initial Plan ==")[0]


def scans(plan: str) -> int:
    return plan.count("FileScan")


@pytest.fixture
def tables(spark):
    return ReportTables(spark, SF_DIR)


def test_cutoffs_reach_the_scan(spark, tables):
    plan = planned(histograms.duration_histogram_cutoff(tables.events("audio"), "2024-01-20 07:00:00"))
    # Long filter lists are shortened in the plan text, so read the condition itself.
    assert re.search(r"DataFilters: \[.*ts#\d+L? < 2024-01-20 07:00:00|DataFilters: \[.*\(ts#\d+ < 2", plan)
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_micros_cutoff_is_pushed(spark, tmp_path):
    spark.createDataFrame([(1, 2.0, "x")], "event_timestamp bigint, duration_sec double, country string").write.parquet(f"{tmp_path}/e")
    df = spark.read.parquet(f"{tmp_path}/e")
    plan = planned(df.filter(before(df, "event_timestamp", "1970-01-02")).select("duration_sec"))
    assert "LessThan(event_timestamp,86400000000)" in plan
    assert "country" not in plan


def test_scenarios_read_each_source_once(spark):
    plan = planned(entry_module.queries()["histogram_scenarios"](spark, SF_DIR))
    assert scans(plan) == 2


def test_snapshot_comparison_reads_once(spark):
    assert scans(planned(entry_module.queries()["histogram_cutoff_comparison"](spark, SF_DIR))) == 1


def test_refinement_counts_events_once(spark):
    """One scan for the events and one for the target; the second use is shared."""
    plan = executed(entry_module.queries()["cutoff_refine_seconds"](spark, SF_DIR))
    assert scans(plan) == 2 and "ReusedExchange" in plan


def test_monthly_medians_shuffle_values_of_located_cells_only(spark, tables):
    plan = executed(durations.mean_exact_median_by_month(tables.monthly("audio")))
    assert len(re.findall(r"FileScan parquet \[o_", plan)) <= 2
    by_value = re.findall(r"Exchange hashpartitioning\([^)]*_x#", plan)
    assert len(by_value) <= 2 and all("_cell" in e for e in by_value)


def test_event_statistics_read_events_twice(spark, tables):
    plan = executed(durations.event_stats_by_month(tables.events("video")))
    assert scans(plan) <= 2


@pytest.mark.parametrize(
    ("name", "events", "orders"),
    [
        ("event_stats_side_by_side", 2, 0),
        ("events_vs_agg_delta", 2, 2),
        ("events_vs_agg_candidates", 2, 2),
        ("numeric_totals_of_recordings", 0, 3),  # a third read, where one exchange is not shared
    ],
)
def test_labelled_quantile_job_reads_each_table_twice(spark, name, events, orders):
    plan = executed(catalog.queries()[name](spark, SF_DIR))
    # only the events have these columns; reused exchanges read nothing
    assert len(re.findall(r"FileScan parquet \[[^]]*event_type#", plan)) <= events
    assert len(re.findall(r"FileScan parquet \[[^]]*o_orderstatus#", plan)) <= orders
    assert "FileScan" in plan


@pytest.mark.parametrize(
    ("name", "table", "most"),
    [
        ("six_source_trend", "l_", 1),
        ("numeric_totals_by_month", "l_", 1),
        ("numeric_grand_totals", "l_", 1),
        ("recording_totals_by_month", "o_", 1),
        ("recording_grand_totals", "o_", 1),
        ("recording_lookup_by_source", "o_", 1),
        ("weighted_mean_two_sources", "o_", 1),
        ("three_source_vs_reference_delta", "o_", 2),
    ],
)
def test_tables_are_read_once(spark, name, table, most):
    plan = planned(catalog.queries()[name](spark, SF_DIR))
    assert 1 <= len(re.findall(rf"FileScan parquet \[{table}", plan)) <= most


def test_unused_median_is_not_computed(spark, tables):
    plan = planned(tables.monthly("audio", median=False).groupBy("month").sum("num_tracks"))
    assert "Window" not in plan and "o_totalprice" not in plan


def test_distinct_users_copy_no_rows(spark, tables):
    plan = planned(users.active_users_from_events(tables.raw(), star.EVENT_TYPES))
    assert "Expand" not in plan and "Generate" not in plan


def test_no_python_in_any_plan(spark):
    for name, query in catalog.queries().items():
        plan = planned(query(spark, SF_DIR))
        assert "Python" not in plan and "ExistingRDD" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_entry_has_rows(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["bin", "bin_ord", "cnt", "pct"] and df.count() > 0
