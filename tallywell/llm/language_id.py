"""Language of a text by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of hashed byte n-grams of its
lower-cased words. Each language has several centroids (spherical k-means over a
bounded sample of its documents), and a text gets the language of the centroid
with the largest cosine. A text further from that centroid than nearly all
training texts of the language is rejected.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so
is every text if there is nothing to learn from. Repeated rows are scored each
on its own. Ties go to the language first in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.cache import release
from tallywell.llm.common import bounded_sample, ship_package

UNKNOWN = "und"
DIMENSIONS = 1 << 14
GRAMS = (2, 3, 4)
SAMPLE_PER_LANGUAGE = 500
CLUSTERS = 4
#: A text is rejected below this share of the cosine that 99 % of the sample reach.
SLACK = 0.6

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes other than lower-case letters become a space; bytes of other scripts stay.
_CLEAN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_SPACES = re.compile(rb"  +")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the text: their numbers in order, and how often each occurs."""
    raw = text.lower().encode("utf-8", "replace").translate(_CLEAN)
    codes = np.frombuffer(_SPACES.sub(b" ", b" " + raw + b" "), np.uint8).astype(np.uint32)
    total = np.zeros(DIMENSIONS, np.int64)
    for n in GRAMS:
        if len(codes) < n:
            break
        mixed = np.full(len(codes) - n + 1, n, np.uint32)
        for k in range(n):
            mixed = (mixed ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x01000193)
        mixed ^= mixed >> np.uint32(15)
        total += np.bincount(mixed & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    found = np.flatnonzero(total)
    return found, total[found]


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = gram_counts(text)
    values = ((1.0 + np.log(counts)) * idf[found]).astype(np.float32)
    length = float(np.sqrt((values * values).sum()))
    return found, values / length if length else values


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and, per row, the cosine with its own. Seeds are far apart: the row
    nearest the mean, then always the row furthest from all seeds so far."""
    mean = rows.mean(0)
    seeds = [int(np.argmax(rows @ mean))]
    while len(seeds) < min(k, len(rows)):
        seeds.append(int(np.argmin((rows @ rows[seeds].T).max(1))))
    centroids = rows[seeds].copy()
    for _ in range(rounds):
        nearest = np.argmax(rows @ centroids.T, 1)
        for j in range(len(centroids)):
            if (nearest == j).any():
                total = rows[nearest == j].sum(0)
                centroids[j] = total / max(float(np.linalg.norm(total)), 1e-12)
    return centroids, (rows @ centroids.T).max(1)


@dataclass
class LanguageModel:
    idf: np.ndarray
    names: list[str]  # per centroid
    centroids: np.ndarray  # dimensions x centroids
    floors: np.ndarray  # per centroid: cosine below which a text is rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Nearest language, its cosine, and whether the text is too far from it."""
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0, True
        found, values = tf_idf(text, self.idf)
        near = values @ self.centroids[found]
        best = int(np.argmax(near))
        score = float(min(1.0, max(0.0, near[best])))
        return self.names[best], score, score < self.floors[best]


def document_frequencies(learnable: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all these texts each hashed n-gram occurs, and their number.

    A task sends its sums only: a row for each of the fixed number of dimensions.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                if has_letter(text):
                    seen[gram_counts(text)[0]] += 1
                    n += 1
        if n:
            used = np.flatnonzero(seen)
            yield pd.DataFrame({"gram": np.append(used, -1), "n": np.append(seen[used], n)})

    sums = learnable.select("text").mapInPandas(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    frequencies, total = np.zeros(DIMENSIONS, np.int64), 0
    for gram, n in sums.collect():
        if gram < 0:
            total = n
        else:
            frequencies[gram] = n
    return frequencies, total


def fit(learnable: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from ``(doc_id, text, lang)``; rows without a language or a letter teach nothing.

    Document frequencies cover all rows. The centroids of a language come from about ``sample``
    documents of it (see ``bounded_sample``), clustered in one group per language; what
    reaches the driver is ``clusters`` vectors per language.
    """
    ship_package(learnable.sparkSession)
    rows = learnable.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    frequencies, total = document_frequencies(rows)
    idf = (np.log((1 + total) / (1 + frequencies)) + 1.0).astype(np.float32)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(t for t in group["text"] if has_letter(t))
        dense = np.zeros((len(texts), DIMENSIONS), np.float32)
        for i, text in enumerate(texts):
            found, values = tf_idf(text, idf)
            dense[i, found] = values
        if not texts:
            return pd.DataFrame({"lang": [], "cluster": [], "centroid": [], "floor": []})
        centroids, near = spherical_kmeans(dense, clusters)
        floor = float(np.quantile(near, 0.01)) * SLACK
        return pd.DataFrame(
            {
                "lang": group["lang"].iloc[0],
                "cluster": range(len(centroids)),
                "centroid": [c.astype(np.float32).tobytes() for c in centroids],
                "floor": floor,
            }
        )

    found = (
        bounded_sample(rows, "doc_id", "lang", sample, 11)
        .groupBy("lang")
        .applyInPandas(cluster, "lang string, cluster int, centroid binary, floor double")
        .collect()
    )
    found.sort(key=lambda r: (r["lang"], r["cluster"]))
    stacked = np.array([np.frombuffer(r["centroid"], np.float32) for r in found], np.float32)
    return LanguageModel(
        idf,
        [r["lang"] for r in found],
        np.ascontiguousarray(stacked.reshape(len(found), DIMENSIONS).T),
        np.array([r["floor"] for r in found]),
    )


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang, nearest, score, rejected)`` for every row: ``nearest`` is the language of
    the closest centroid, ``lang`` the same or ``und`` if the text is rejected."""
    ship_package(docs.sparkSession)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            answers = [model.predict(text) for text in batch["text"]]
            out = pd.DataFrame(answers, columns=["nearest", "score", "rejected"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out["lang"] = out["nearest"].where(~out["rejected"].astype(bool), UNKNOWN)
            yield out[["doc_id", "lang", "nearest", "score", "rejected"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        predict, f"doc_id {kind}, lang string, nearest string, score double, rejected boolean"
    )
