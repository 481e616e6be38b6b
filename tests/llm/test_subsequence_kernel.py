"""The subsequence kernel against plain enumeration, and what the machine makes of rare and altered words."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tallywell.llm import toxicity


def plain_kernel(a: str, b: str) -> float:
    def weights(word: str) -> dict:
        marked = "<" + word + ">"
        found: dict = defaultdict(float)
        for i, j, k in combinations(range(len(marked)), 3):
            if k - i < toxicity.SPAN:
                found[marked[i], marked[j], marked[k]] += toxicity.DECAY ** (k - i + 1)
        norm = math.sqrt(sum(v * v for v in found.values()))
        return {s: v / norm for s, v in found.items()}

    x, y = weights(a), weights(b)
    return sum(v * y.get(s, 0.0) for s, v in x.items())


def test_kernel_equals_enumeration():
    rng = random.Random(12)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcde", k=rng.randrange(1, 14))) for _ in range(2))
        assert toxicity.kernel(a, b) == pytest.approx(plain_kernel(a, b), abs=1e-9)
    assert toxicity.kernel("moron", "moron") == pytest.approx(1.0)


def test_landmark_kernels_are_the_sharpened_kernel():
    words = ["moron", "mooron", "m", "tree", "morning"]
    got = toxicity.Landmarks(["moron", "tree"]).kernels(words)
    want = [[math.exp(toxicity.SHARPNESS * (plain_kernel(w, m) - 1)) for m in ("moron", "tree")] for w in words]
    assert np.allclose(got, want, atol=1e-5)


@pytest.fixture(scope="module")
def machine():
    rng = random.Random(13)
    clean = {"".join(rng.choices("aeioubcdfglmnprst", k=rng.randrange(3, 10))): rng.randrange(1, 4) for _ in range(50_000)}
    clean |= {"tree": 900, "house": 800}
    words = list(clean) + ["moron", "grobnik"]  # an insult said often, another one seen in a single document
    toxic = np.array([0.0] * len(clean) + [300.0, 1.0])
    return toxicity.fit_machine(words, toxic, np.array([*clean.values(), 0.0, 0.0]))


def test_altered_insults_stay_toxic(machine):
    scorer = toxicity.Scorer(machine)
    plain = scorer.sentence("tree house tree")
    for text in ("you moron", "you m-o-r-o-n", "m o r o n", "mor0n moroon", "a mxoron!"):
        assert scorer.sentence(text) > 0 > plain, text


def test_rare_words_are_examples_too(machine):
    """More than fifty thousand commoner words don't push a rare insult out."""
    scores = machine.scores(["grobnik", "tree", "house"])
    assert scores[0] > scores[1:].max()


def test_one_class_of_labels(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(30)] + [(99, None)], "doc_id long, text string")
    for value, low, high in ((0, 0.0, 0.01), (1, 0.99, 1.0)):
        marks = spark.createDataFrame([(k, value) for k in range(30)], "doc_id long, toxic int")
        model = toxicity.fit(docs, marks)
        scores = [r[0] for r in docs.select(toxicity.score_column(model, docs["text"])).collect()]
        assert all(low <= s <= high for s in scores)
    none = toxicity.fit(docs, marks.limit(0))
    assert {r[0] < 1e-6 for r in docs.select(toxicity.score_column(none, docs["text"])).collect()} == {True}
