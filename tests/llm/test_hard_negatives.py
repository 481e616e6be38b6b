"""Hard negatives against brute force and SQL; the index's bounds and cell order."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywell.llm import hard_negatives, multi_index, queries
from tests.compare import connect, spark_rows, sql_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows: list[tuple], step: int = 100) -> list[tuple]:
    """Every anchor against every row, as the definition says."""
    known = {}
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        known[(vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector))] = None
    out = []
    for a, la, va in known:
        if a % step:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in known]
        for minus, p, _ in sorted(s for s in scored if s[2] == la and s[1] != a)[:5]:
            fits = sorted(s for s in scored if s[2] != la and 80 * -minus <= 100 * -s[0] <= 100 * -minus)[:5]
            out += [(a, p, n, i, -minus, -s) for n, (s, i, _) in enumerate(fits, start=1)]
    return sorted(out)


def vectors(spread: float, rows: int = 900, width: int = 9) -> list[tuple]:
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, width))
    found = centres[rng.integers(0, 6, rows)] + spread * rng.normal(size=(rows, width))
    return [(k, [float(x) for x in v], int(rng.integers(0, 4))) for k, v in enumerate(found)]


def mined(spark, rows: list[tuple], **options) -> list[tuple]:
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("cell", "key", "score", "N", "v", "targets"):
        table = table.withColumn(name, F.lit("extra"))
    got = hard_negatives.mine(hard_negatives.prepared(table), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_rounds_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "GROWTH", 3)
    rows = vectors(spread)
    got = mined(spark, rows, block_rows=50)
    assert got == plain(rows)
    assert len(got) > 50


def test_odd_rows(spark):
    rows = vectors(0.5, rows=400)
    rows += [(1000 + k, rows[0][1], k % 2) for k in range(300)]  # copies: ties by id, in one cell
    rows += [rows[100]] * 200 + [rows[5]] * 200  # repeated rows
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2100, [1.0, None], 1), (2200, [math.nan] * 9, 0), (2300, [math.inf] * 9, 0)]
    rows += [(2400, rows[0][1], None), (2500, [], 0), (2600, [0.5, -0.5], 2), (2700, [0.0] * 9, 3), (-100, rows[7][1], 1)]
    got = mined(spark, rows, block_rows=64)
    assert got == plain(rows)
    assert {0, 100, -100} <= {r[0] for r in got}


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2 ** (15 + k % 3)), 1.0 + k / 256, -float(2**14)], k % 2) for k in range(0, 300)]
    assert mined(spark, rows) == plain(rows)


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (200, [1.0], 1)]) == []


def test_bounds_and_order():
    rng = np.random.default_rng(4)
    points = np.floor(60 * rng.normal(size=(3000, 8)))
    index = multi_index.fitted(points[:500], len(points))
    cell, first, second = index.assign(points)
    cells = np.unique(cell)
    full = index.with_cells(
        cells, *(np.array([f(cell == c) for c in cells]) for f in (np.sum, lambda m: first[m].max(), lambda m: second[m].max()))
    )
    for q in points[:20]:
        products = points @ q
        seen = list(full.order(q))
        assert sorted(c for c, *_ in seen) == sorted(cells)
        bounds = [b for _, b, _, _ in seen]
        assert all(a >= b - 1e-6 for a, b in zip(bounds, bounds[1:]))
        for c, bound, upper, lower in seen:
            assert lower <= products[cell == c].min() and products[cell == c].max() <= upper <= bound + 2 * multi_index.SLACK


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, size):
    folder = f"/root/testdata/{size}"
    df = queries.op11_hard_negatives(spark, folder)
    columns, want = sql_rows(connect(folder), queries.oracle_sql()["op11_hard_negatives"])
    assert sorted(df.columns) == sorted(columns)
    assert spark_rows(df) == want
