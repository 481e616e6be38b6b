"""What odd rows get, value by value: nulls, empty and blank texts, repeated ids, no labels, one class, text ids."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tallywell.llm import fingerprints, quality, queries, toxicity

SF_DIR = "/root/testdata/sf0.001"
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
LONG = "word " * 60000
#: ids beyond those of the table; the first three count as empty where white space does not
ODD = [(900001, None), (900002, ""), (900003, " \t\n"), (900004, "12 34!"), (900005, LONG), (900006, "x" * 200000)]
NO_LETTERS = (900001, 900002, 900003, 900004)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("values"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string")
    docs.filter("doc_id < 300").unionByName(odd, allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(spark, sf_dir, name):
    rows = queries.queries()[name](spark, sf_dir).filter("doc_id > 900000").collect()
    return {r["doc_id"]: r for r in rows}


def test_language(spark, sf_dir):
    rows = rows_of(spark, sf_dir, "op1_language_id")
    assert [rows[d]["lang_pred"] for d in NO_LETTERS] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_fingerprints(spark, sf_dir):
    rows = rows_of(spark, sf_dir, "op2_fingerprints")
    assert [rows[d]["n_chars"] for d in sorted(rows)] == [0, 0, 3, 6, len(LONG), 200000]
    assert rows[900001]["edited_sha256"] == rows[900002]["edited_sha256"] == EMPTY_DIGEST
    assert rows[900001]["fingerprint"] == rows[900002]["fingerprint"] == rows[900001]["edited_fingerprint"]
    assert rows[900001]["near_next"] == 1.0
    # the last quarter of "12 34!" is one character, the next document starts with a "w"
    assert rows[900004]["edited_sha256"] == hashlib.sha256(b"12 34w").hexdigest()


def test_packing(spark, sf_dir):
    got = queries.op3_packing(spark, sf_dir).filter(F.col("doc_id").isin(900001, 900002)).collect()
    want = zlib.crc32(struct.pack("<I", 1))
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == [
        (900001, 0, 1, want, 1),
        (900002, 0, 1, want, 1),
    ]


def test_tokens(spark, sf_dir):
    rows = rows_of(spark, sf_dir, "op6_token_counts")
    assert [tuple(rows[d][c] for c in ("n_bytes", "n_tokens", "over_limit")) for d in (900001, 900002)] == [
        (0, 0, False)
    ] * 2
    assert rows[900005]["over_limit"] and rows[900005]["n_bytes"] == len(LONG)
    pieces = rows_of(spark, sf_dir, "op5_sentencepiece")
    assert [(list(pieces[d]["ids"]), pieces[d]["n_tokens"]) for d in (900001, 900002)] == [([], 0)] * 2
    assert pieces[900002]["decoded_sha256"] == EMPTY_DIGEST and all(r["round_trip"] for r in (pieces[900003], pieces[900005]))


def test_exact_dedup(spark, sf_dir):
    rows = rows_of(spark, sf_dir, "op7_exact_dedup")
    got = [tuple(rows[d][c] for c in ("keep_id", "group_size", "kept", "text_sha256")) for d in (900001, 900002, 900003)]
    assert got == [(900003, 3, False, EMPTY_DIGEST)] * 2 + [(900003, 3, True, EMPTY_DIGEST)]


def test_language_model(spark, sf_dir):
    rows = rows_of(spark, sf_dir, "op13_language_model")
    assert [rows[d]["n_tokens"] for d in (900001, 900002, 900003, 900005)] == [1, 1, 1, 60001]
    assert rows[900001]["score"] == rows[900002]["score"] < 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_no_or_one_class(spark, sf_dir, module):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    label = "quality" if module is quality else "toxic"
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for kept, least, most in ((F.lit(False), 0, 0.5), (F.col(label) == 1, 0.5, 1), (F.col(label) == 0, 0, 0.5)):
        model = module.fit(docs, marks.filter(kept))
        scores = {r[0] for r in docs.select(module.score_column(model, F.col("text"))).collect()}
        assert len(scores) == 1 and least <= min(scores) <= most


@pytest.mark.parametrize("module", [quality, toxicity])
def test_equal_texts_get_equal_scores(spark, sf_dir, module):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = module.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    twice = docs.unionByName(docs)
    scored = twice.select(F.coalesce("text", F.lit("")).alias("text"), module.score_column(model, F.col("text")).alias("s"))
    assert scored.groupBy("text").agg(F.count_distinct("s").alias("n")).filter("n > 1").count() == 0


def test_text_ids_over_several_ranges(spark):
    ids = [f"{'é' if i % 3 else 'z'}{i:03d}{'-long' * (i % 4)}" for i in range(60)]
    docs = spark.createDataFrame([(d, f"text of {d}") for d in [None, *ids]], "doc_id string, text string")
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(docs, range_rows=10).collect()}
    order = [None, *sorted(ids)]
    assert len(rows) == len(order)
    for one, after in zip(order, order[1:] + order[:1], strict=True):
        text, following = f"text of {one}", f"text of {after}"
        n = len(text) // 4
        assert rows[one]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()
