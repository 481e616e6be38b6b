"""The registered comparisons hold every computed key against a target from the tables."""

from __future__ import annotations

import duckdb
import pytest

from tallywell.plans import catalog, oracle
from tests.compare import connect, spark_rows, sql_rows

MONTHS = [f"{y}-{m:02d}" for y in range(1996, 2000) for m in range(1, 13)]


def write(folder, name: str, columns: str, rows: list[tuple]) -> None:
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t ({columns})")
    con.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(rows[0]))})", rows)
    con.execute(f"COPY t TO '{folder}/{name}.parquet' (FORMAT parquet)")


@pytest.fixture
def orders(tmp_path):
    """Two countries; in the n-th month medians of 100 n and 100 n + 50, and a month before and after the range."""
    rows = []
    for n, month in enumerate(["1995-12", *MONTHS, "2000-01"]):
        prices = {1: (100.0 * n - 7, 100.0 * n, 100.0 * n + 9), 2: (100.0 * n + 50, None)}
        rows += [(1, who, "O", p, f"{month}-15 01:00:00", "5-LOW") for who, found in prices.items() for p in found]
        rows.append((2, 1, "F", 1e6, f"{month}-15 01:00:00", "5-LOW"))  # another source
    write(
        tmp_path, "orders",
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
        rows,
    )
    write(tmp_path, "customer", "c_custkey BIGINT, c_nationkey INTEGER", [(1, 1), (2, 2)])
    write(tmp_path, "nation", "n_nationkey INTEGER, n_name VARCHAR", [(1, "A"), (2, "B")])
    return str(tmp_path)


def test_series_compare_holds_every_month_against_the_tables(spark, orders):
    df = catalog.queries()["series_compare"](spark, orders)
    rows = {r["key"]: r for r in df.collect()}
    assert sorted(rows) == MONTHS
    for n, month in enumerate(MONTHS, start=1):
        value, r = 100.0 * n + 25, rows[month]
        shift = 1.0 if month == "1997-03" else 0.0
        assert r["target"] == value + shift
        if month == "1998-02":
            assert (r["got"], r["delta"], r["mismatch"]) == (None, None, True)
        else:
            assert (r["got"], r["delta"], r["mismatch"]) == (value, -shift, shift > 0)
    assert spark_rows(df) == sql_rows(connect(orders), oracle.oracle_sql()["series_compare"])[1]


def test_series_summary_counts_every_month(spark, orders):
    df = catalog.queries()["series_compare_summary"](spark, orders)
    row = df.first()
    assert (row["compared"], row["mismatches"], row["max_abs_delta"], row["overall_match"]) == (48, 2, 1.0, False)
    assert spark_rows(df) == sql_rows(connect(orders), oracle.oracle_sql()["series_compare_summary"])[1]


def test_histogram_compare_takes_its_target_from_the_events(spark, tmp_path):
    """Seconds are squares of the values. By the cutoff: 5 of 10 below a minute, 4 of 1-5 and 1 of 5-10 minutes."""
    early, late = "2024-01-20 06:59:59", "2024-01-20 07:00:00"
    seconds = [(1.0, early)] * 2 + [(9.0, early)] * 3 + [(100.0, early)] * 4 + [(400.0, early)]
    seconds += [(400.0, late)] * 2 + [(7200.0, late)] * 6
    rows = [(i, ts, 1, "click", sec**0.5, None) for i, (sec, ts) in enumerate(seconds)]
    rows.append((99, early, 1, "view", 10.0, None))  # another source
    write(tmp_path, "events", "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR", rows)
    df = catalog.queries()["histogram_compare"](spark, str(tmp_path))
    # Ours are all 16 of at least two seconds; a bin that only they have is not asked for.
    assert [(r["bin"], r["got"], r["target"], r["delta"], r["mismatch"]) for r in df.collect()] == [
        ("0-1m", 0.1875, 0.5, -0.3125, True),
        ("1-5m", 0.25, 0.4, -0.15, True),
        ("5-10m", 0.1875, 0.1, 0.0875, True),
    ]
    assert spark_rows(df) == sql_rows(connect(str(tmp_path)), oracle.oracle_sql()["histogram_compare"])[1]
