"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The subsequence kernel of two words sums, over all subsequences of three characters that both
contain (gaps allowed, up to a span), decay to the power of the two spans, and is
normalised by the words' own kernels; an insult with gaps or inserted characters
thus stays near the plain one. The machine uses exp(SHARPNESS * (kernel - 1)), the Gaussian of
the distance that this kernel defines. Landmarks are words of labelled sentences; a word's
features are its kernels with the landmarks, whitened by the landmarks' own
kernel matrix, and a linear machine with squared hinge loss is fitted to all words of the
sentences labelled toxic and clean: the unit of training is a word, weighted by the documents that
have it in a sentence. So a phrase of words that are each harmless is not recognised.

A sentence counts as its most toxic word. A text's score comes from the words of its sentences
by a logistic model, fitted on labelled documents that the machine did not see.

Signs inside a word are dropped ("i-d-i-o-t"), and three or more single letters in a row
("i d i o t") are read as one word as well.

Defined cases: a null text is scored as the empty text, which gets the score of a text
without toxic words. Without labels of both classes the score is the share of label 1 (0 without
labels). Repeated rows get equal scores. Words are scored up to any length.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.llm.cache import GenerationCache, held
from tallywell.llm.common import labelled_sample, ship_package

SAMPLE_PER_LABEL = 4000
LANDMARKS = 256
DECAY = 0.7
SHARPNESS = 8.0
RIDGE = 0.3
#: Words most typical of toxic sentences, of which variants with an inserted letter are learned, too.
STRETCHED = 60
#: Characters that a subsequence may span; longer gaps weigh nothing.
SPAN = 6
_SEED = 31
_SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_CODES = 64  # per character; larger alphabets share codes by hash

_OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_WEIGHTS = np.array([DECAY ** (j + 1) for _, j in _OFFSETS])


def words_of(text: str) -> list[str]:
    """Lower-cased words; three or more single letters in a row count joined, too."""
    words = text.lower().split()
    ones = [i for i, w in enumerate(words) if len(w) == 1]
    if len(ones) > 2:
        run = [ones[0]]
        for i in [*ones[1:], -1]:
            if i == run[-1] + 1:
                run.append(i)
                continue
            if len(run) > 2:
                words.append("".join(words[k] for k in run))
            run = [i]
    return words


def sentences_of(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


#: Words handled at once: their number, a code and an offset fit into 32 bits.
_CHUNK = 128
#: Examples whose features are in double precision at once, while the machine is fitted.
_EXAMPLES = 8192


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word number, code, weight)`` of the subsequences of three characters within the span of up to
    ``_CHUNK`` words, each once per word, in order of word and code, scaled to unit length per word.

    A word stands between two marks, so that its start and its end count as characters.
    """
    lengths = np.array([len(w) for w in words], np.int32) + 2
    ends = lengths.cumsum()
    flat = np.zeros(int(ends[-1]) if len(words) else 0, np.int32)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4").astype(np.int32)
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = False
    inner[ends - lengths] = False
    flat[inner] = 3 + np.where((letters >= 97) & (letters <= 122), letters - 97, 26 + letters % 34)
    flat[ends - 1], flat[ends - lengths] = 1, 2
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    parts = []
    for k, (i, j) in enumerate(_OFFSETS):
        n = len(flat) - j
        if n > 0:
            code = ((owner[:n] * _CODES + flat[:n]) * _CODES + flat[i : i + n]) * _CODES + flat[j:]
            parts.append((code * 16 + k)[owner[:n] == owner[j:]])
    keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int32)
    if not len(keys):
        return keys, keys, np.zeros(0)
    codes = keys >> 4
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    total = np.add.reduceat(_WEIGHTS[keys & 15], first)
    own, code = codes[first] // _CODES**3, codes[first] % _CODES**3
    norm = np.sqrt(np.bincount(own, total * total, len(words)))
    return own, code, total / norm[own]


def kernel(a: str, b: str) -> float:
    """The normalised subsequence kernel of two words."""
    own, code, weight = subsequences([a, b])
    x, y = (dict(zip(code[own == k].tolist(), weight[own == k].tolist(), strict=True)) for k in (0, 1))
    return sum(v * y.get(k, 0.0) for k, v in x.items())


class Landmarks:
    """The landmarks' subsequence weights, to compute their kernels with many words at once."""

    def __init__(self, words: list[str]) -> None:
        found = [subsequences(words[i : i + _CHUNK]) for i in range(0, len(words), _CHUNK)]
        rows = np.unique(np.concatenate([code for _, code, _ in found]))
        self.at = np.full(_CODES**3, -1, np.int32)
        self.at[rows] = np.arange(len(rows))
        self.dense = np.zeros((len(rows), len(words)), np.float32)
        for k, (own, code, weight) in enumerate(found):
            self.dense[self.at[code], own + k * _CHUNK] = weight

    def kernels(self, words: list[str]) -> np.ndarray:
        """A row per word, ``_CHUNK`` words at most: the sharpened kernel with each landmark."""
        out = np.zeros((len(words), self.dense.shape[1]), np.float32)
        own, code, weight = subsequences(words)
        row = self.at[code]
        known = row >= 0
        own, row, weight = own[known], row[known], weight[known].astype(np.float32)
        bounds = np.searchsorted(own, np.arange(len(words) + 1)).tolist()
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if a < b:
                np.dot(weight[a:b], self.dense.take(row[a:b], axis=0), out=out[k])
        out -= 1.0
        out *= SHARPNESS
        return np.exp(out, out=out)


@dataclass
class Machine:
    landmarks: Landmarks | None
    weights: np.ndarray  # per landmark, whitening included
    bias: float
    name: str

    def scores(self, words: list[str]) -> np.ndarray:
        if self.landmarks is None or not words:
            return np.full(len(words), self.bias)
        parts = [self.landmarks.kernels(words[i : i + _CHUNK]) @ self.weights for i in range(0, len(words), _CHUNK)]
        return np.concatenate(parts).astype(np.float64) + self.bias


def fit_machine(words: list[str], toxic: np.ndarray, clean: np.ndarray, landmarks: int = LANDMARKS) -> Machine:
    """From words with the numbers of toxic and of clean documents that hold them in a sentence."""
    if not len(words) or toxic.sum() == 0 or clean.sum() == 0:
        return Machine(None, np.zeros(0, np.float32), -1.0, uuid.uuid4().hex)
    share = toxic.sum() / (toxic.sum() + clean.sum())

    def lifts() -> np.ndarray:
        return (toxic - share * (toxic + clean)) / np.sqrt(share * (toxic + clean) + 1)

    words, lift = list(words), lifts()
    for i in np.argsort(-lift, kind="stable")[:STRETCHED].tolist():
        word = words[i]
        if lift[i] > 0 and len(word) > 3:
            more = [word[:k] + c + word[k:] for k in range(1, len(word)) for c in sorted({word[k - 1], "x"})]
            words += more
            toxic = np.append(toxic, np.full(len(more), max(1.0, toxic[i] / len(more))))
            clean = np.append(clean, np.zeros(len(more)))
    # three eighths typical words, as many variants, and common words of clean sentences
    by_lift, part = np.argsort(-lifts(), kind="stable"), 3 * landmarks // 8
    variant = by_lift >= len(lift)
    typical, stretched = by_lift[~variant][:part], by_lift[variant][:part]
    common = np.argsort(-clean, kind="stable")[:landmarks]
    chosen = list(dict.fromkeys(np.concatenate([typical, stretched, common]).tolist()))[:landmarks]
    marks = Landmarks([words[i] for i in chosen])
    own = [words[i] for i in chosen]
    gram = np.concatenate([marks.kernels(own[i : i + _CHUNK]) for i in range(0, len(own), _CHUNK)])
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    good = values > 1e-5 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    z = np.ones((len(words), int(good.sum()) + 1), np.float32)
    for i in range(0, len(words), _CHUNK):
        z[i : i + _CHUNK, :-1] = marks.kernels(words[i : i + _CHUNK]) @ whiten
    # primal Newton steps on the squared hinge; each word is an example of either class, by its counts
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1]) * RIDGE
    ridge[-1, -1] = 1e-3
    for _ in range(25):
        left, right = ridge.copy(), np.zeros(len(w))
        for i in range(0, len(words), _EXAMPLES):
            x = z[i : i + _EXAMPLES].astype(np.float64)
            margin = x @ w
            positive, negative = (margin < 1) * toxic[i : i + _EXAMPLES], (margin > -1) * clean[i : i + _EXAMPLES]
            active = positive + negative > 0
            x, positive, negative = x[active], positive[active], negative[active]
            left += (x * (positive + negative)[:, None]).T @ x
            right += x.T @ (positive - negative)
        fresh = np.linalg.solve(left, right)
        settled = np.abs(fresh - w).max() < 1e-6
        w = fresh
        if settled:
            break
    return Machine(marks, (whiten @ w[:-1]).astype(np.float32), float(w[-1]), uuid.uuid4().hex)


class Scorer:
    """Scores texts with a machine; a word is scored once per worker while it stays in the cache."""

    WIDTH = 7

    def __init__(self, machine: Machine) -> None:
        self.machine = machine
        self.raw: GenerationCache[float] = GenerationCache(400_000)
        self.plain: GenerationCache[float] = GenerationCache(500_000)

    def words(self, words: list[str]) -> list[float]:
        found = list(map(self.raw.new.get, words))
        if None not in found:
            return found
        missing = {w: None for w, v in zip(words, found, strict=True) if v is None and self.raw.get(w) is None}
        letters = {w: _NOT_LETTERS.sub("", w) for w in missing}
        new = [p for p in dict.fromkeys(letters.values()) if self.plain.get(p) is None]
        values = dict(zip(new, np.clip(self.machine.scores(new), -2.0, 2.0).tolist(), strict=True))
        for p, value in values.items():
            self.plain.put(p, value)
        for w, p in letters.items():
            missing[w] = values[p] if p in values else self.plain.get(p)
            self.raw.put(w, missing[w])
        return [
            v if v is not None else (missing[w] if w in missing else self.raw.get(w))
            for w, v in zip(words, found, strict=True)
        ]

    def sentence(self, sentence: str) -> float:
        """The most toxic word's score (the bias for a sentence without words)."""
        return max(self.words(words_of(sentence)), default=self.machine.bias)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row per text. Words that are new to the worker are scored together."""
        rows = np.zeros((len(texts), self.WIDTH))
        for first in range(0, len(texts), 64):
            split = [words_of(text or "") for text in texts[first : first + 64]]
            self.words(list(set().union(*split)))
            for k, words in enumerate(split, first):
                scores = np.array(self.words(words) or [self.machine.bias])
                n = len(scores)
                top = np.sort(np.partition(scores, n - min(3, n))[n - min(3, n) :])
                positive = float(np.maximum(scores, 0).sum())
                rows[k] = (
                    top[-1],
                    top.mean(),
                    top[0],
                    math.log1p(positive),
                    positive / math.sqrt(n),
                    float((scores > 0.5).sum()) / n,
                    math.log1p(n),
                )
        return rows


def scorer_of(machine: Machine) -> Scorer:
    """The worker's scorer for this machine."""
    return held(machine.name, lambda: Scorer(machine))


@dataclass
class Model:
    machine: Machine
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the bias

    def probability(self, rows: np.ndarray) -> np.ndarray:
        x = (rows - self.mean) / self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_logistic(rows: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = rows.mean(0), np.maximum(rows.std(0), 1e-6)
    x = np.hstack([(rows - mean) / scale, np.ones((len(rows), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(docs: DataFrame, marks: DataFrame, label: str = "toxic", sample: int = SAMPLE_PER_LABEL) -> Model:
    """Learn ``label`` (0 or 1) of ``marks (doc_id, label)``, the rows that may be learned from.

    About ``sample`` documents per class at most are taken by hash. Their sentences carry the
    document's label. One half of them gives the words, counted where the sentences are, of which all
    reach the driver (the sample is their bound), the other half the logistic model.
    """
    ship_package(docs.sparkSession)
    valid = marks.filter(F.col(label).isin(0, 1))
    counts = {r[0]: r[1] for r in valid.groupBy(label).count().collect()}
    chosen = labelled_sample(docs, valid, label, sample, _SEED)
    half = F.pmod(F.xxhash64("doc_id", F.lit(_SEED + 1)), F.lit(2))

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch["text"], batch["label"], strict=True):
                held: set[str] = set()
                for sentence in sentences_of(text or ""):
                    held.update(_NOT_LETTERS.sub("", w) for w in words_of(sentence))
                for word in held:
                    if word:
                        seen.setdefault(word, [0, 0])[y] += 1
        held = np.array(list(seen), object)
        yield pd.DataFrame(
            {"word": held, "clean": [c for c, _ in seen.values()], "toxic": [t for _, t in seen.values()]}
        )

    words = (
        chosen.filter(half == 0)
        .mapInPandas(tally, "word string, clean long, toxic long")
        .groupBy("word")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .collect()
    )
    words.sort(key=lambda r: (-r["clean"] - r["toxic"], r["word"]))
    machine = fit_machine(
        [r["word"] for r in words],
        np.array([r["toxic"] for r in words], float),
        np.array([r["clean"] for r in words], float),
    )

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(machine)
        for batch in batches:
            values = [row.tobytes() for row in scorer.features(list(batch["text"]))]
            yield pd.DataFrame({"label": batch["label"].to_numpy(), "x": values})

    found = chosen.filter(half == 1).mapInPandas(measure, "label int, x binary").collect()
    found.sort(key=lambda r: (r["label"], r["x"]))
    rows = np.array([np.frombuffer(r["x"]) for r in found]).reshape(len(found), Scorer.WIDTH)
    y = np.array([r["label"] for r in found], float)
    if len(y) == 0 or y.min() == y.max():
        n = sum(counts.values())
        share = min(max(counts.get(1, 0) / n if n else 0.0, 1e-9), 1 - 1e-9)
        flat = np.append(np.zeros(Scorer.WIDTH), math.log(share / (1 - share)))
        return Model(machine, np.zeros(Scorer.WIDTH), np.ones(Scorer.WIDTH), flat)
    mean, scale, weights = fit_logistic(rows, y)
    # back from the sample's shares of the classes to the true ones
    weights[-1] += math.log(counts[1] / (y == 1).sum()) - math.log(counts[0] / (y == 0).sum())
    return Model(machine, mean, scale, weights)


def score_column(model: Model, text: Column) -> Column:
    """The probability of label 1 as a column; the other columns stay in the JVM."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of(model.machine)
        for batch in batches:
            yield pd.Series(model.probability(scorer.features(list(batch))))

    return score(text)


def toxic_sentences(text: str | None, scorer: Scorer, least: float = 0.0) -> list[tuple[int, str, float]]:
    """Start, text and score of the sentences above ``least``."""
    out, at = [], 0
    for sentence in sentences_of(text or ""):
        at = (text or "").index(sentence, at)
        value = scorer.sentence(sentence)
        if value > least:
            out.append((at, sentence, value))
        at += len(sentence)
    return out
