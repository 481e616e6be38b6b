"""Helpers that the operators share: shared storage, bounded samples, shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tallywell_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), "tallywell_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, str(path.relative_to(_PACKAGE.parent)))
    context.addPyFile(archive)
    context._tallywell_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is missing in a local session a temporary folder is
    made and set as the checkpoint folder of the context; a cluster needs the setting.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    known = getattr(spark.sparkContext, "_tallywell_shared", None)
    if known is None:
        known = "file://" + tempfile.mkdtemp(prefix="tallywell-")
        spark.sparkContext.setCheckpointDir(known)
        spark.sparkContext._tallywell_shared = known
    return known


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage,
    and a lost executor costs no recomputation of what stands there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(df: DataFrame) -> None:
    """Free the files of a ``stored`` table which nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(name) for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def row_key(docs: DataFrame) -> Column:
    """Id and digest of the text: equal for rows that are the same document only."""
    return F.concat_ws("|", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), F.col("doc_id").cast("string"))


def rows_with_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is in ``keys (key)``, all columns, one row per key:
    of rows equal in id and text the greatest in the other columns."""
    names = docs.columns
    wide = docs.select(
        row_key(docs).alias("key"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row")
    )
    found = wide.join(keys.select("key"), "key", "left_semi").groupBy("key").agg(F.max("row").alias("row"))
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])


def fresh_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores until it clashes with no column (names ignore case)."""
    lowered = {name.lower() for name in taken}
    while wanted.lower() in lowered:
        wanted += "_"
    return wanted


def bounded_sample(rows: DataFrame, key: str, stratum: str, limit: int, seed: int) -> DataFrame:
    """About ``limit`` rows per value of ``stratum`` at most, chosen by a hash of ``key``.

    A value with n rows keeps each with probability min(1, limit / n); the size
    stays below limit + 5 * sqrt(limit) but for one run in millions. The choice
    depends on the ids alone, needs no shuffle of the rows and is repeatable.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(stratum).count().collect()}
    chosen = F.lit(False)
    spread = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30))
    for value, n in sorted(counts.items(), key=lambda item: str(item[0])):
        if value is not None:
            edge = int(min(1.0, limit / n) * (1 << 30))
            chosen = chosen | ((F.col(stratum) == F.lit(value)) & (spread < edge))
    return rows.filter(chosen)


def labelled_sample(
    docs: DataFrame, marks: DataFrame, label: str, limit: int, seed: int
) -> DataFrame:
    """``(doc_id, text, label)`` of a bounded sample of the labelled documents.

    ``marks`` holds the ids that may be learned from. The ids are sampled before
    the join, so the side that is broadcast is bounded by ``limit`` per class
    whatever the size of the tables. Ids labelled both ways are left out.
    """
    known = (
        marks.select("doc_id", F.col(label).cast("int").alias("label"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_most"))
        .filter(F.col("label") == F.col("_most"))
        .select("doc_id", "label")
    )
    chosen = bounded_sample(known, "doc_id", "label", limit, seed)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
