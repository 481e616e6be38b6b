"""Exact deduplication by a streaming query with disk-backed keyed state.

A slim table (digest of the normalised text, length, id, row number as content
locator) is written once and streamed in micro-batches into an aggregation keyed
by digest. Its state lives in RocksDB on disk, checkpointed to the shared
folder, and never expires: per digest it holds the number of rows and the
identifier and locator of the best one. Map-side combining sends one row per
digest and task to the state, so a group of any size is a handful of rows there.
The state is then read as a table. Digests met more than once are hits: the full
normalised texts behind them are compared, byte by byte, by grouping on the text
itself, and a digest that stands for several texts is split by text.

Defined cases: a null text counts as empty, and empty texts equal each other;
null ids sort before all others. Of rows equal in text, length and id exactly one
stays. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tallywell.llm.common import new_path, row_key, rows_with_keys, stored

#: The characters that equality of texts ignores.
IGNORED = "\x20\x09\x0a\x0b\x0c\x0d"
MICRO_BATCHES = 3
_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no megabytes set aside in each
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rank() -> Column:
    """Smallest first: most code points, then smallest id, then locator."""
    return F.struct(
        (-F.col("chars")).alias("less"), F.col("id").isNotNull().alias("has"), "id", F.col("locator")
    )


def slim_rows(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """``(digest, id, chars, locator, key)``, stored once so that the locators hold from then on."""
    return stored(
        docs.select(
            digest(normalised(F.col("text"))).alias("digest"),
            F.col("doc_id").alias("id"),
            F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
            F.monotonically_increasing_id().alias("locator"),
            row_key(docs).alias("key"),
        ),
        "digests",
    )


def streamed_state(slim: DataFrame, micro_batches: int = MICRO_BATCHES) -> DataFrame:
    """Run the stream over the files of ``slim`` to its end and read its state:
    ``(digest, n, best)`` with ``best`` as in ``_rank``."""
    spark = slim.sparkSession
    files = slim.inputFiles()
    schema = StructType(
        [
            StructField("digest", slim.schema["digest"].dataType),
            StructField("n", slim.select(F.count("*").alias("n")).schema["n"].dataType),
            StructField("best", slim.select(_rank().alias("b")).schema["b"].dataType),
        ]
    )
    if not files:
        return spark.createDataFrame([], schema)
    before = {key: spark.conf.get(key, None) for key in _STATE_SETTINGS}
    at = new_path(spark, "dedup-state")
    try:
        for key, value in _STATE_SETTINGS.items():
            spark.conf.set(key, value)
        query = (
            spark.readStream.schema(slim.schema)
            .option("maxFilesPerTrigger", -(-len(files) // micro_batches))
            .parquet(files[0].rpartition("/")[0])
            .groupBy("digest")
            .agg(F.count("*").alias("n"), F.min(_rank()).alias("best"))
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", at)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    state = spark.read.format("statestore").load(at)
    held = state.schema["value"].dataType.fieldNames()
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col("value").getField(held[0]).alias("n"),
        F.col("value").getField(held[1]).cast(schema["best"].dataType).alias("best"),
    )


def _texts(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = normalised(F.col("text"))
    return docs.select(
        digest(text).alias("digest"),
        text.alias("text"),
        F.col("doc_id").alias("id"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("locator"),
        row_key(docs).alias("key"),
    )


def _decisions(rows: DataFrame) -> DataFrame:
    """From ``(digest, id, locator)`` with ``(n, best)`` of the group, null for a text met once."""
    alone = F.col("n").isNull()
    return rows.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.locator") == F.col("locator"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "key",
    )


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, key)``, one row per row of ``docs``.

    ``digest`` may be a weaker function of the normalised text: what then collides is
    told apart by its bytes.
    """
    slim = slim_rows(docs, digest)
    hits = stored(streamed_state(slim).filter("n > 1"), "hits")
    # full bytes of every hit: the grouping compares whole texts, after combining per task
    behind = _texts(docs, digest).join(
        hits.select("digest").hint("merge"), "digest", "left_semi"
    )
    several = stored(
        behind.groupBy("digest", "text")
        .agg(F.count("*").alias("n"))
        .groupBy("digest")
        .agg(F.count("*").alias("texts"))
        .filter("texts > 1")
        .select("digest"),
        "collisions",
    )
    joined = slim.join(hits, "digest", "left")
    if several.isEmpty():
        return _decisions(joined)
    mixed = stored(_texts(docs, digest).join(several, "digest", "left_semi"), "mixed")
    by_text = mixed.groupBy("digest", "text").agg(F.count("*").alias("n"), F.min(_rank()).alias("best"))
    return _decisions(joined.join(several, "digest", "left_anti")).unionByName(
        _decisions(mixed.join(by_text, ["digest", "text"]))
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return rows_with_keys(docs, deduplicate(docs).filter("kept").select("key"))
