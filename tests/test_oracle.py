"""Every registered query against its SQL, value for value."""

from __future__ import annotations

import pytest

from tallywell.plans import catalog, oracle
from tests.compare import connect, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.01"
QUERIES = catalog.queries()
ORACLE = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    columns, expected = sql_rows(con, ORACLE[name])
    assert sorted(df.columns) == sorted(columns)
    got = spark_rows(df)
    assert len(got) > 0
    assert got == expected
