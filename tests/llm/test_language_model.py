"""The language model against plain Python: counts, base and model scores, gradients, normalisation."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywell.llm import language_model as lm
from tallywell.llm import queries
from tallywell.llm.common import crc_mod

ODD = [
    (None, "No id at all."),
    (70001, None),
    (70002, ""),
    (70003, " \t\r\n"),
    (70004, "NON BREAKING İstanbul \u0085x \x1cy the the"),
    (70005, "a b " * 40_000),
    (70006, "x" * 300_000),
]


def words_of(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w] + ["\n"]


def held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


@pytest.fixture(scope="module")
def table(spark):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 120").select("doc_id", "text")
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    docs = some.unionByName(some.filter("doc_id < 5")).unionByName(odd).repartition(3)
    for name in ("learn", "word", "c", "leaf", "block", "ids"):
        docs = docs.withColumn(name, F.lit("extra"))
    return docs


def test_against_plain_python(spark, table):
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    learn = crc_mod(F.col("doc_id"), 7) != 2
    blocks, known = lm.prepared(table, learn, block_chars=60_000)
    assert blocks.count() > 3
    model = lm.train(blocks, known.tokens)
    got = {}
    for r in lm.scored(blocks, known, model).collect():
        got.setdefault(r["doc_id"], []).append(r)

    counts = Counter(w for i, t in rows if not held_out(i) for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    assert (known.tokens, known.words) == (n, v)
    every = sorted({w for _, t in rows for w in words_of(t)})
    listed = spark.createDataFrame([(w, counts[w]) for w in every], "word string, c long")
    leaf = {r["word"]: r["leaf"] for r in known.leaves(listed).collect()}
    tokens_of, words_in = Counter(), Counter()
    for w, c in counts.items():
        tokens_of[leaf[w]] += c
        words_in[leaf[w]] += 1

    def softmax(factor: lm.Factor, keys: list[int]) -> np.ndarray:
        rows = [int((k + 1) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - 15)) for k in keys]
        logits = factor.weights[rows].sum(0, dtype=np.float64)
        chances = np.exp(logits - logits.max())
        return chances / chances.sum()

    for doc_id, text in rows:
        if text is not None and len(text) > 100_000:
            continue
        words = words_of(text)
        past = [0, 0] + [leaf[w] + 1 for w in words]
        score = 0.0
        for k, w in enumerate(words):
            second, first = past[k : k + 2]
            pair = first * (lm.CLASSES * lm.GROUPS + 1) + second
            keys = [x * lm.FEATURES + kind for kind, x in enumerate((first, second, pair))]
            cls, group = divmod(leaf[w], lm.GROUPS)
            score += math.log10(softmax(model[0], keys)[cls])
            score += math.log10(softmax(model[1], [(x + 1) * (lm.CLASSES + 1) + cls + 1 for x in keys])[group])
            score += math.log10((counts[w] + 1) / (tokens_of[leaf[w]] + words_in[leaf[w]] + 1))
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        for r in got[doc_id]:
            assert r["learn"] == (not held_out(doc_id))
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
            assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
            assert r["score"] == pytest.approx(score, rel=1e-4, abs=1e-3)
    assert sum(map(len, got.values())) == len(rows)


def test_shares_and_factors_sum_to_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 60")
    _, known = lm.prepared(docs, F.lit(True))
    counts = Counter(w for r in docs.collect() for w in words_of(r["text"]))
    listed = known.leaves(spark.createDataFrame(list(counts.items()), "word string, c long")).collect()
    leaf, c = (np.array([r[k] for r in listed]) for k in ("leaf", "c"))
    mass = np.bincount(leaf, 10 ** known.share(leaf, c), lm.CLASSES * lm.GROUPS)
    unknown = 10 ** known.share(np.arange(len(mass)), np.zeros(len(mass)))
    assert np.allclose(mass + unknown, 1)
    factor = lm.Factor.empty(lm.CLASSES)
    factor.weights[:] = np.random.default_rng(1).normal(size=factor.weights.shape)
    rows = lm.buckets(np.arange(80, dtype=np.uint64).reshape(20, 4))
    assert np.allclose(factor.probabilities(rows).sum(1), 1, atol=1e-5)


def test_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    factor = lm.Factor.empty(5)
    factor.weights[:] = rng.normal(size=factor.weights.shape)
    rows = rng.integers(0, 3, (6, 4)).astype(np.uint16)
    truth = rng.integers(0, 5, 6)
    gradient = np.zeros_like(factor.weights, np.float64)
    for tokens, y in zip(rows, truth):
        logits = sum(factor.weights[r].astype(float) for r in tokens)
        slope = np.exp(logits) / np.exp(logits).sum() - np.eye(5)[y]
        for r in tokens:
            gradient[r] += slope
    before = factor.weights.copy()
    factor.step(rows, truth)
    want = before - lm.STEP * gradient / np.sqrt(1 + (gradient**2).sum(1))[:, None]
    assert np.allclose(factor.weights, want, atol=1e-5)


def test_held_out_text_is_predicted_better_than_by_counts(spark):
    found = queries.op13_language_model(spark, "/root/testdata/sf0.01").toPandas()
    held = found[found["held_out"]]
    assert held["score"].sum() > 0.96 * held["base_score"].sum()
    assert (held["score"] > held["base_score"]).mean() > 0.85
    assert (found["score"] < 0).all()


@pytest.mark.parametrize("rows", [[], [("b", "one two"), ("a", None)]])
def test_no_training_documents(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = lm.scores(docs, F.lit(False)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    uniform = -math.log10(lm.CLASSES * lm.GROUPS)
    for r in got:
        assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0)
        assert r["score"] == pytest.approx(uniform * r["n_tokens"], rel=1e-5)
