"""A training corpus from the documents table: five stages, each one operator of ``tallywell.llm``.

Every stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.llm import exact_dedup, near_dedup, packing, quality, toxicity
from tallywell.llm.common import crc_mod, documents, fresh_name, labels, new_path
from tallywell.llm.queries import QUALITY_THRESHOLD, TOXICITY_THRESHOLD


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score reaches the threshold."""
    model = quality.fit(docs, labels(spark, sf_dir).filter(crc_mod(F.col("doc_id"), 4) != 2))
    name = fresh_name(docs.columns, "_quality")
    scored = docs.withColumn(name, quality.score_column(model, F.col("text")))
    return scored.filter(F.col(name) >= QUALITY_THRESHOLD).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity score stays below the threshold."""
    model = toxicity.fit(docs, labels(spark, sf_dir).filter(crc_mod(F.col("doc_id"), 5) != 0))
    name = fresh_name(docs.columns, "_toxicity")
    scored = docs.withColumn(name, toxicity.score_column(model, F.col("text")))
    return scored.filter(F.col(name) < TOXICITY_THRESHOLD).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of those with equal texts."""
    return exact_dedup.keep_first(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


#: Classifiers and tokenizers can't be written as SQL: the tests hold run() against brute force.
ORACLE_SQL = None
