"""Comparing a Spark result with the SQL run in DuckDB over the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((value is None, str(type(value)), str(value)) for value in row)


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def normal_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=_key)


def spark_rows(df: DataFrame) -> list[tuple]:
    return normal_rows(df.columns, [tuple(row) for row in df.collect()])


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return columns, normal_rows(columns, result.fetchall())
