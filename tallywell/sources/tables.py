"""Reading tables, views and date shards; literal tables; writing results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalogue table or view by name, or a parquet location by path."""
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def read_shards(
    spark: SparkSession,
    root: str,
    prefix: str = "events_",
    first_day: str | None = None,
    last_day: str | None = None,
    day_column: str = "event_date",
) -> DataFrame:
    """Every ``<root>/<prefix>*`` shard as one DataFrame.

    Without bounds all shards are read. The optional ``YYYYMMDD`` bounds (both
    inclusive) compare the stored text, which sorts like the dates do, so they
    are pushed to the scan.
    """
    shards = spark.read.parquet(f"{root.rstrip('/')}/{prefix}*")
    if first_day is not None:
        shards = shards.filter(F.col(day_column) >= first_day)
    if last_day is not None:
        shards = shards.filter(F.col(day_column) <= last_day)
    return shards


def target_series(spark: SparkSession, values: Mapping[str, float]) -> DataFrame:
    """``(key, target)`` from numbers read off a report: a constant relation inside the plan."""
    rows = [
        F.struct(F.lit(key).cast("string").alias("key"), F.lit(None if value is None else float(value)).cast("double").alias("target"))
        for key, value in values.items()
    ]
    listed = F.array(*rows).cast("array<struct<key: string, target: double>>")
    return spark.range(1).select(F.inline(listed))


def target_histogram(spark: SparkSession, shares: Mapping[str, float]) -> DataFrame:
    """``(bin, target)`` from shares read off a report."""
    return target_series(spark, shares).withColumnRenamed("key", "bin")


def bin_counts(spark: SparkSession, rows: Iterable[tuple[str, float, float, int]]) -> DataFrame:
    """``(label, lo, hi, count)`` from ready-made bin counts."""
    data = [(label, float(lo), float(hi), int(count)) for label, lo, hi, count in rows]
    return spark.createDataFrame(data, "label string, lo double, hi double, count bigint")


def tag(df: DataFrame, label: str, column: str = "source") -> DataFrame:
    """Prefix a literal column naming where the rows come from."""
    return df.select(F.lit(label).alias(column), "*")


def stack(frames: Iterable[DataFrame], allow_missing: bool = False) -> DataFrame:
    """UNION ALL by column name."""
    first, *rest = list(frames)
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=allow_missing)
    return first


def stack_distinct(frames: Iterable[DataFrame]) -> DataFrame:
    """UNION DISTINCT by column name."""
    return stack(frames).distinct()


def write_result(
    df: DataFrame,
    path: str,
    partition_by: Iterable[str] = (),
    mode: str = "errorifexists",
    file_format: str = "parquet",
) -> None:
    df.write.mode(mode).format(file_format).partitionBy(*partition_by).save(path)


def save_result(df: DataFrame, table: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).format("parquet").saveAsTable(table)


def columns_of(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types in order: the schema is known without a query."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


RECORDING_EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("duration_sec", T.DoubleType()),
    ]
)

RAW_EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField("event_date", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField(
            "event_params",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("key", T.StringType()),
                        T.StructField(
                            "value",
                            T.StructType(
                                [
                                    T.StructField("double_value", T.DoubleType()),
                                    T.StructField("string_value", T.StringType()),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

RECORDINGS_MONTHLY_SCHEMA = T.StructType(
    [
        T.StructField("month", T.DateType()),
        T.StructField("country", T.StringType()),
        T.StructField("num_tracks", T.LongType()),
        T.StructField("total_duration_sec", T.DoubleType()),
        T.StructField("min_duration_sec", T.DoubleType()),
        T.StructField("max_duration_sec", T.DoubleType()),
        T.StructField("mean_duration_sec", T.DoubleType()),
        T.StructField("stddev_duration_sec", T.DoubleType()),
        T.StructField("median_duration_sec", T.DoubleType()),
        T.StructField("num_lossless", T.LongType()),
    ]
)
