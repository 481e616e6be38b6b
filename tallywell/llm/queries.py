"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.llm import (
    conversations,
    exact_dedup,
    fingerprints,
    hard_negatives,
    language_id,
    language_model,
    licenses,
    near_dedup,
    packing,
    quality,
    sentencepieces,
    token_counts,
    toxicity,
)
from tallywell.llm.common import crc_mod, documents, labels

QUALITY_THRESHOLD = 0.7
TOXICITY_THRESHOLD = 0.5


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs.filter(~held_out))
    return language_id.identify(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("nearest").alias("lang_pred"),
        "score",
        "rejected",
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir)).withColumn(
        "over_limit", F.col("n_tokens") > token_counts.LIMIT
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(documents(spark, sf_dir)).drop("key")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, labels(spark, sf_dir).filter(~held_out))
    return docs.select(
        "doc_id", held_out.alias("held_out"), quality.score_column(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels(spark, sf_dir).filter(~held_out))
    return docs.select(
        "doc_id", held_out.alias("held_out"), toxicity.score_column(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= TOXICITY_THRESHOLD).cast("int"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).drop("key")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_and_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.scores(documents(spark, sf_dir), crc_mod(F.col("doc_id"), 7) != 2)
    return scored.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_fingerprints": op2_fingerprints,
        "op3_packing": op3_packing,
        "op4_licenses": op4_licenses,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_token_counts": op6_token_counts,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_quality": op8_quality,
        "op9_toxicity": op9_toxicity,
        "op10_near_dedup": op10_near_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_language_model": op13_language_model,
    }


OP7_SQL = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), ranked AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size,
         row_number() OVER w AS place
  FROM normal
  WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS FIRST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256
FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_licenses": licenses.scan_sql(),
        "op7_exact_dedup": OP7_SQL,
        "op11_hard_negatives": hard_negatives.SQL,
        "op12_conversation_repair": conversations.SQL,
    }
