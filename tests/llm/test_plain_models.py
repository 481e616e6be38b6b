"""Language ID and the quality classifier against plain, per-document versions over a whole small table."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywell.llm import language_id, quality
from tallywell.llm.common import crc_mod, documents, labels

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF_DIR)


def test_languages_by_a_plain_search_over_all_centroids(spark, docs):
    learnable = docs.filter(crc_mod(F.col("doc_id"), 3) != 1)
    model = language_id.fit(learnable)
    known = [r for r in learnable.collect() if r["lang"] is not None and language_id.has_letter(r["text"])]
    holders: dict[int, int] = {}
    for r in known:
        for gram in language_id.gram_counts(r["text"])[0].tolist():
            holders[gram] = holders.get(gram, 0) + 1
    centroids = model.centroids.T.astype(float)
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1, atol=1e-4)
    assert set(model.names) == {r["lang"] for r in known}
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    for r in docs.collect():
        answer = got[r["doc_id"]]
        if not language_id.has_letter(r["text"]):
            assert (answer["nearest"], answer["score"], answer["rejected"]) == ("und", 0.0, True)
            continue
        grams, counts = language_id.gram_counts(r["text"])
        weights = {
            g: (1 + math.log(c)) * (math.log((1 + len(known)) / (1 + holders.get(g, 0))) + 1)
            for g, c in zip(grams.tolist(), counts.tolist())
        }
        length = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * c[g] for g, w in weights.items()) / length for c in centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert answer["score"] == pytest.approx(cosines[best], abs=1e-3)
        near = {model.names[k] for k, c in enumerate(cosines) if c > cosines[best] - 1e-4}
        assert answer["nearest"] in near
        assert answer["rejected"] == (answer["score"] < model.floors[model.names.index(answer["nearest"])]) or len(near) > 1


def walk(model: quality.Trees, row: list[float]) -> float:
    margin = model.base
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
        at = 0
        for _ in range(quality.DEPTH):
            at = 2 * at + (2 if row[feature[at]] > cut[at] else 1)
        margin += leaf[at - len(feature)]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def test_quality_by_walking_each_tree_alone(spark, docs):
    model = quality.fit(docs, labels(spark, SF_DIR).filter(crc_mod(F.col("doc_id"), 4) != 2))
    assert len(model.feature) == quality.TREES
    got = {r[0]: r[1] for r in docs.select("doc_id", quality.score_column(model, F.col("text"))).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == pytest.approx(walk(model, quality.statistics(r["text"])), abs=1e-9)


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(17)
    rows = rng.normal(size=(400, len(quality.FEATURES)))
    label = (rows[:, 3] + 0.4 * rng.normal(size=400) > 0.3).astype(float)
    model = quality.grow(rows, label, trees=1)
    gradient, weight = label - label.mean(), np.full(400, label.mean() * (1 - label.mean()))

    def gain(left: np.ndarray) -> float:
        parts = [(gradient[m].sum() ** 2) / (weight[m].sum() + quality.LEAF_PENALTY) for m in (left, ~left)]
        return sum(parts) - gradient.sum() ** 2 / (weight.sum() + quality.LEAF_PENALTY)

    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for f in range(rows.shape[1])]
    best = max(((gain(rows[:, f] <= e), f, e) for f in range(rows.shape[1]) for e in edges[f]))
    assert (model.feature[0][0], model.cut[0][0]) == (best[1], pytest.approx(best[2]))
    assert model.feature[0][0] == 3


@pytest.mark.parametrize("value", [0, 1, None])
def test_labels_of_one_class_or_none(spark, docs, value):
    marks = spark.createDataFrame([(k, value) for k in range(20)], "doc_id long, quality int")
    model = quality.fit(docs, marks)
    rows = docs.limit(20).unionByName(spark.createDataFrame([(900, None)], "doc_id long, text string"), allowMissingColumns=True)
    scores = [r[0] for r in rows.select(quality.score_column(model, F.col("text"))).collect()]
    assert len(set(scores)) == 1
    assert {0: scores[0] < 0.01, 1: scores[0] > 0.99, None: scores[0] == 0.5}[value]
