"""Nulls, empty and long texts, repeated rows, ties, clashing extra columns, empty tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallywell.llm import queries

SF_DIR = "/root/testdata/sf0.001"
#: Rows of the edge table beside the sampled ones: each id and text.
ODD = [(None, "a row without an id"), (900001, None), (900002, ""), (900003, " \t\n"), (900004, "\U0001f600 ́x")]


@pytest.fixture(scope="module", params=["odd", "empty"])
def sf_dir(spark, tmp_path_factory, request):
    folder = str(tmp_path_factory.mktemp(request.param))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    if request.param == "empty":
        docs = docs.limit(0)
    else:
        odd = spark.createDataFrame(ODD + [(900005, "word " * 60000), (900006, "x" * 200000)], "doc_id bigint, text string")
        some = docs.filter("doc_id < 300")
        docs = some.unionByName(some.filter("doc_id < 3")).unionByName(odd, allowMissingColumns=True)
    for name in ("key", "score", "label", "rank", "length", "Bucket", "_quality"):
        docs = docs.withColumn(name, F.lit("extra"))
    docs.write.parquet(f"{folder}/documents.parquet")
    os.symlink(f"{SF_DIR}/labels.parquet", f"{folder}/labels.parquet")
    return folder


#: These read other tables; their own tests hold the odd rows.
OTHERS = ("op11_hard_negatives", "op12_conversation_repair")


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(OTHERS)))
def test_whole_result(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.queries()[name](spark, sf_dir)
    if name in ("op3_packing", "op4_licenses"):
        ids = {r[0] for r in got.select("doc_id").distinct().collect()}
        every = {r[0] for r in docs.select("doc_id").collect()}
        assert ids == every if name == "op3_packing" else ids <= every
    else:
        want = sorted(map(str, (r[0] for r in docs.select("doc_id").collect())))
        assert sorted(map(str, (r[0] for r in got.select("doc_id").collect()))) == want


def test_pipeline_runs(spark, sf_dir):
    columns = {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    got = corpus_pipeline.run(spark, sf_dir)
    assert columns <= set(got.columns)
    got.collect()
