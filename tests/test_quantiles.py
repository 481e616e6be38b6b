"""The distributed quantile against brute force on awkward groups."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallywell.operators.quantiles import Rank, _coarse_cell, distribution, exact_quantile


def interpolated(values: list[float], q: float) -> float:
    ordered = sorted(values)
    position = q * (len(ordered) - 1)
    low, high = ordered[math.floor(position)], ordered[math.ceil(position)]
    return low if low == high else low + (high - low) * (position - math.floor(position))


def groups() -> dict[str, list[float]]:
    rng = random.Random(5)
    return {
        "one": [7.25],
        "two": [1.0, 2.0],
        "even": [1.0, 2.0, 10.0, 20.0],
        "ties": [3.0] * 400 + [4.0],
        "negative": [rng.uniform(-5e4, 5e4) for _ in range(501)],
        "around_zero": [0.0, -0.0, 1e-9, -1e-9, 1e-12],
        "tight": [60.0 + rng.random() * 1e-9 for _ in range(400)],
        "wide": [math.exp(rng.uniform(-20, 20)) for _ in range(700)],
        "hot": [rng.choice([1.5, 2.5, rng.uniform(0, 1e6)]) for _ in range(3000)],
        "infinite": [1.0, 2.0, math.inf],
    }


@pytest.fixture(scope="module")
def rows(spark):
    data = [(key, value) for key, values in groups().items() for value in values]
    data += [("even", None), ("empty", None)]
    return spark.createDataFrame(data, "g string, x double").repartition(7)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_equals_brute_force(rows, q):
    got = {r["g"]: r["quantile"] for r in exact_quantile(rows, ["g"], "x", q).collect()}
    assert set(got) == set(groups())
    for key, values in groups().items():
        assert got[key] == pytest.approx(interpolated(values, q), rel=1e-12, abs=1e-15), key


def test_equals_builtin_percentile(rows):
    ours = {r["g"]: r["quantile"] for r in exact_quantile(rows, ["g"], "x", 0.5).collect()}
    built_in = rows.groupBy("g").agg(F.percentile("x", 0.5).alias("p")).where("p is not null")
    for r in built_in.collect():
        assert ours[r["g"]] == pytest.approx(r["p"], rel=1e-12, abs=1e-15), r["g"]


def test_moments(spark):
    rng = random.Random(9)
    values = [float(rng.randint(1, 40)) for _ in range(999)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", None)], "g string, x double")
    got = {r["g"]: r for r in distribution(df, ["g"], "x", 0.3).collect()}
    a = got["a"]
    assert a["quantile"] == pytest.approx(interpolated(values, 0.3))
    assert (a["rows"], a["n"], a["total"], a["lowest"], a["highest"]) == (1000, 999, sum(values), min(values), max(values))
    assert a["stddev"] == pytest.approx(statistics.stdev(values), rel=1e-12)
    assert got["b"].asDict() == {
        "g": "b", "rows": 1, "n": 0, "total": None, "lowest": None, "highest": None, "stddev": None, "quantile": None
    }


def test_stddev_does_not_cancel(spark):
    df = spark.createDataFrame([(1e9 + v,) for v in (0.1, 0.2, 0.3, 0.4)], "x double")
    assert distribution(df, [], "x").first()["stddev"] == pytest.approx(0.1290994, abs=1e-6)


def test_values_near_zero_spread_over_cells(spark):
    rng = random.Random(4)
    values = [rng.uniform(0, 1e-9) for _ in range(3000)] + [rng.uniform(0, 1e-2) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_quantile(df, [], "x").first()["quantile"] == pytest.approx(interpolated(values, 0.5), rel=1e-12)
    cells = df.select(_coarse_cell(F.col("x")).alias("c")).groupBy("c").count().agg(F.max("count")).first()[0]
    assert cells < 200


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    assert {r["g"]: r["quantile"] for r in exact_quantile(df, ["g"], "x").collect()} == {None: 2.0, "a": 5.0}


def test_nan_sorts_last(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (math.nan,)], "x double")
    assert exact_quantile(df, [], "x", 0.5).first()["quantile"] == 2.0
    assert math.isnan(exact_quantile(df, [], "x", 1.0).first()["quantile"])


def test_same_without_broadcasts(spark, rows):
    plain = {r["g"]: r["quantile"] for r in exact_quantile(rows, ["g"], "x").collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = exact_quantile(rows, ["g"], "x")
        assert {r["g"]: r["quantile"] for r in again.collect()} == plain
        assert "Broadcast" not in again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_group_is_gathered(rows):
    plan = exact_quantile(rows, ["g"], "x")._jdf.queryExecution().executedPlan().toString().lower()
    assert "collect_" not in plan and "percentile(" not in plan and "objecthashaggregate" not in plan


def test_several_ranks_of_labelled_sources_in_one_job(spark):
    rng = random.Random(21)
    groups = {
        ("a", 1): [rng.lognormvariate(3, 2) for _ in range(997)],
        ("a", 2): [5.0] * 300 + [rng.uniform(-9, 9) for _ in range(200)],
        ("b", 1): [1.5],
        ("b", None): [2.0, 8.0, -4.0, 8.0],
        ("b", 3): [None, None],
    }
    df = spark.createDataFrame([(s, g, x) for (s, g), xs in groups.items() for x in xs], "source string, g int, x double").repartition(4)
    levels = (0.0, 0.1, 0.5, 0.9, 0.999, 1.0)
    ranks = {f"between{i}": Rank(q) for i, q in enumerate(levels)} | {f"element{i}": Rank(q, False) for i, q in enumerate(levels)}
    got = {(r["source"], r["g"]): r for r in distribution(df, ["source", "g"], "x", ranks=ranks).collect()}
    assert set(got) == set(groups)
    for key, xs in groups.items():
        known = sorted(x for x in xs if x is not None)
        assert got[key]["n"] == len(known) and got[key]["rows"] == len(xs)
        for i, q in enumerate(levels):
            if not known:
                assert got[key][f"between{i}"] is None and got[key][f"element{i}"] is None
                continue
            assert got[key][f"between{i}"] == pytest.approx(interpolated(known, q), rel=1e-12)
            assert got[key][f"element{i}"] == known[max(math.ceil(q * len(known)) - 1, 0)]
