"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics of a text (shares of character classes, repetition of words and
lines, symbol runs, lengths) are cut into at most 64 quantile bins. Trees of one
fixed depth are grown on gradient histograms and kept as flat arrays: node k of
a tree has children 2k+1 and 2k+2, so that scoring is a few numpy gathers over a
whole batch of documents and trees.

Defined cases: a null text is scored as the empty text. With no label of one of the
classes to learn from, the score is the share of label 1 (0.5 without labels).
Repeated rows get equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.cache import release
from tallywell.llm.common import labelled_sample, ship_package

SAMPLE_PER_LABEL = 6000
BINS = 64
DEPTH = 4
TREES = 120
RATE = 0.1
LEAF_PENALTY = 1.0
LEAST_WEIGHT = 8.0
_SEED = 23
_RUN = re.compile(r"([^\w\s])\1+")

FEATURES = (
    "log_chars log_words upper lower digit space newline ascii_punct other_bytes bang percent amp star dollar hash "
    "pipe dot comma word_length distinct_words top_word distinct_pairs log_lines distinct_lines top_line "
    "line_length lines_ended symbol_runs upper_words deflate"
).split()


def _class(chars: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[[ord(c) for c in chars]] = True
    return mask


_UPPER, _LOWER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
_PUNCT = _class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SINGLES = [ord(c) for c in "!%&*$#|.,"]


def statistics(text: str | None) -> list[float]:
    """The document statistics named in ``FEATURES``, over the whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(len(raw), 1)
    words = text.split()
    n = max(len(words), 1)
    tally = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [line for line in text.split("\n") if line.strip()]
    kinds = Counter(lines)
    m = max(len(lines), 1)
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(words))),
        *(counts[mask].sum() / size for mask in (_UPPER, _LOWER, _DIGIT)),
        counts[32] / size,
        counts[10] / size,
        counts[_PUNCT].sum() / size,
        counts[128:].sum() / size,
        *(counts[_SINGLES] / size),
        sum(map(len, words)) / n,
        len(tally) / n,
        max(tally.values(), default=0) / n,
        pairs / max(n - 1, 1),
        float(np.log1p(len(lines))),
        len(kinds) / m,
        max(kinds.values(), default=0) / m,
        len(text) / m,
        sum(line.rstrip()[-1:] in ".!?" for line in lines) / m,
        len(_RUN.findall(text)) / n,
        sum(map(str.isupper, words)) / n,
        len(zlib.compress(raw, 1)) / size,
    ]


@dataclass
class Trees:
    """Flat trees: ``feature`` and ``cut`` per inner node, ``leaf`` per leaf, all of one depth."""

    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << DEPTH) - 1), np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << DEPTH) - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << DEPTH)))

    def probability(self, rows: np.ndarray) -> np.ndarray:
        """Walks all rows through all trees at once, level by level."""
        margin = np.full(len(rows), self.base)
        if len(self.feature) and len(rows):
            tree = np.arange(len(self.feature))[None, :]
            at = np.zeros((len(rows), len(self.feature)), np.int64)
            own = np.arange(len(rows))[:, None]
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[own, self.feature[tree, at]] > self.cut[tree, at])
            margin = margin + self.leaf[tree, at - ((1 << DEPTH) - 1)].sum(1)
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def grow(rows: np.ndarray, label: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Boost on the logistic loss; splits maximise the gain read from gradient histograms."""
    n = len(label)
    share = min(max(float(label.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))))
    if n == 0 or label.min() == label.max():
        return model
    width = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], "left") for f in range(width)], 1)
    shift = np.arange(width) * BINS
    inner = (1 << DEPTH) - 1
    margin = np.full(n, model.base)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        gradient, weight = label - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int32), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, nodes = (1 << level) - 1, 1 << level
            cell = ((at - first)[:, None] * (width * BINS) + shift + binned).ravel()
            size = nodes * width * BINS
            g = np.bincount(cell, np.repeat(gradient, width), size).reshape(nodes, width, BINS).cumsum(2)
            h = np.bincount(cell, np.repeat(weight, width), size).reshape(nodes, width, BINS).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = (
                g * g / (h + LEAF_PENALTY)
                + (all_g - g) ** 2 / (all_h - h + LEAF_PENALTY)
                - all_g * all_g / (all_h + LEAF_PENALTY)
            )
            gain[(h < LEAST_WEIGHT / 4) | (all_h - h < LEAST_WEIGHT / 4)] = 0.0
            best = gain.reshape(nodes, -1).argmax(1)
            node_feature, node_bin = best // BINS, best % BINS
            useful = gain.reshape(nodes, -1).max(1) > 1e-6
            bin_cut = np.where(useful, node_bin, BINS)
            for k in np.flatnonzero(useful):
                feature[first + k] = node_feature[k]
                cut[first + k] = edges[node_feature[k]][node_bin[k]]
            own = at - first
            at = 2 * at + 1 + (binned[np.arange(n), node_feature[own]] > bin_cut[own])
        leaf_of = at - inner
        g = np.bincount(leaf_of, gradient, inner + 1)
        h = np.bincount(leaf_of, weight, inner + 1)
        leaf = rate * g / (h + LEAF_PENALTY)
        margin = margin + leaf[leaf_of]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    model.feature, model.cut, model.leaf = np.array(features), np.array(cuts), np.array(leaves)
    return model


def fit(docs: DataFrame, marks: DataFrame, label: str = "quality", sample: int = SAMPLE_PER_LABEL) -> Trees:
    """Trees for ``label`` (0 or 1) of ``marks (doc_id, label)``, the rows that may be learned from.

    About ``sample`` documents per class at most are taken by hash; their statistics are
    computed where they are, and only those numbers reach the driver. The classes are
    weighted back to their true shares through the starting margin.
    """
    ship_package(docs.sparkSession)
    counts = {r[0]: r[1] for r in marks.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    chosen = labelled_sample(docs, marks.filter(F.col(label).isin(0, 1)), label, sample, _SEED)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for batch in batches:
            values = [np.array(statistics(text), np.float64).tobytes() for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "label": batch["label"].to_numpy(), "x": values})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = chosen.mapInPandas(measure, f"doc_id {kind}, label int, x binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    rows = np.array([np.frombuffer(r["x"]) for r in found]).reshape(len(found), len(FEATURES))
    y = np.array([r["label"] for r in found], float)
    model = grow(rows, y)
    taken = {0: float((y == 0).sum()), 1: float((y == 1).sum())}
    if taken[0] and taken[1]:  # back to the true shares
        model.base += float(np.log(counts[1] / taken[1]) - np.log(counts[0] / taken[0]))
    return model


def score_column(model: Trees, text: Column) -> Column:
    """The probability of label 1 as a column; the other columns stay in the JVM."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = np.array([statistics(t) for t in batch], np.float64).reshape(len(batch), len(FEATURES))
            parts = [model.probability(rows[i : i + 2048]) for i in range(0, len(rows), 2048)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)
