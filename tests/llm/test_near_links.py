"""Near-duplicates where it is hard: pairs just above the threshold, crowded buckets, heavy members."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from tallywell.llm import near_dedup
from tests.llm.test_operators import brute_classes


def classes(spark, texts: dict[int, str]) -> dict[int, int]:
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    return {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}


def changed(words: list[str], places: list[int], rng: random.Random) -> list[str]:
    words = list(words)
    for p in places:
        words[p] = f"new{rng.getrandbits(40)}"
    return words


def test_recall_just_above_the_threshold(spark):
    rng = random.Random(8)
    texts, near = {}, []
    for k in range(2000):
        n = rng.randrange(150, 500)
        words = [f"w{rng.getrandbits(30)}" for _ in range(n)]
        # r changed words, apart from each other, leave n - 4 - 5r of n - 4 + 5r shingles
        most = int((n - 4) * 0.2 / 1.8 / 5)
        other = changed(words, rng.sample(range(5, n - 5, 6), most), rng)
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(other)
        score = near_dedup.similarity(near_dedup.weighted_set(texts[2 * k]), near_dedup.weighted_set(texts[2 * k + 1]))
        if 0.8 <= score <= 0.85:
            near.append(2 * k)
    found = classes(spark, texts)
    assert len(near) > 1500
    recall = sum(found[k] == found[k + 1] for k in near) / len(near)
    print("recall between 0.80 and 0.85:", recall, "of", len(near))
    assert recall >= 0.995
    assert all(found[k] // 2 == k // 2 for k in texts)  # and nothing else is joined


def test_crowded_buckets_lose_no_class(spark, monkeypatch):
    """Texts of one template, most of them below the threshold of each other, in parts of a few members."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"t{k}" for k in range(240)]
    texts = {}
    for k in range(260):
        words = changed(base, rng.sample(range(5, 235), rng.randrange(1, 9)), rng)
        texts[k] = " ".join(words)
    texts[1000] = " ".join(base * 400)  # a heavy one with the same words
    got, want = classes(spark, texts), brute_classes(texts)
    together = defaultdict(set)
    for d, c in got.items():
        together[c].add(d)
    assert all(len({want[d] for d in members}) == 1 for members in together.values())
    links = len(texts) - len(set(want.values()))
    assert links > 50 and len(texts) - len(together) >= 0.995 * links


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(10)
    for _ in range(12):
        elements = np.unique(rng.integers(0, 2**60, 300).astype(np.uint64))
        one = rng.integers(1, 9, len(elements))
        two = np.maximum(one - rng.integers(0, 5, len(elements)), 0)
        a, b = (elements, one), (elements[two > 0], two[two > 0])
        same = (near_dedup.signature(*a) == near_dedup.signature(*b)).mean()
        assert abs(same - near_dedup.similarity(a, b)) < 5 * np.sqrt(0.25 / near_dedup.COORDINATES)
