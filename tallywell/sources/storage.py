"""Day-partitioned tables in shared storage: shards with pruning, and writes that replace whole days."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywell.functions.periods import micros_of, utc_date

DAY_COLUMN = "event_date"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share.

    Without that setting only a local session gets one, in a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = getattr(spark.sparkContext, "_tallywell_work", None)
        if shared is None:
            shared = "file://" + tempfile.mkdtemp(prefix="tallywell-work-")
            spark.sparkContext._tallywell_work = shared
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def with_day(events: DataFrame, column: str = "event_timestamp") -> DataFrame:
    """The rows with their UTC day as ``YYYYMMDD`` text in front; rows without a time have no day."""
    return events.select(F.date_format(utc_date(micros_of(events, column)), "yyyyMMdd").alias(DAY_COLUMN), "*")


def write_shards(events: DataFrame, root: str, column: str = "event_timestamp", files_per_day: int = 1) -> None:
    """One folder per day below ``root``.

    Rows meet by day and a slot within it, so a day that holds most of the rows is written by
    ``files_per_day`` tasks and every task keeps few files open.
    """
    dated = with_day(events, column)
    slot = F.pmod(F.xxhash64(*[F.col(c) for c in events.columns]), F.lit(files_per_day))
    dated.repartition(DAY_COLUMN, slot).write.partitionBy(DAY_COLUMN).parquet(root)


def read_day_shards(
    spark: SparkSession, root: str, schema: T.StructType, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """All shards below ``root``, or those of the days ``first_day`` to ``last_day`` (``YYYYMMDD``, both included).

    The day is a folder name, so a bound drops whole shards before anything is listed or read. ``schema`` is
    that of the rows without their day; giving it keeps the day a text.
    """
    full = T.StructType([*schema.fields, T.StructField(DAY_COLUMN, T.StringType())])
    shards = spark.read.schema(full).parquet(root)
    if first_day is not None:
        shards = shards.filter(F.col(DAY_COLUMN) >= first_day)
    if last_day is not None:
        shards = shards.filter(F.col(DAY_COLUMN) <= last_day)
    return shards


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Writes ``df`` so that it replaces exactly the partitions that it has rows for.

    Writing the same rows again changes nothing, and a job that is run twice or restarted leaves one
    copy; partitions that ``df`` does not mention stay as they are.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
