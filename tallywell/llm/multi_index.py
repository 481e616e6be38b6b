"""Inverted multi-index over integer vectors: two half-space codebooks, cells, and certified cell order.

A vector is cut into two halves, each assigned to the nearest word of its codebook; the pair
of words is its cell. For a query q and a codeword c with the radius r of the halves assigned
to it, no half scores above ``q.c + |q| r`` nor below ``q.c - |q| r``. The multi-sequence heap
gives cells by falling sum of the two upper bounds, so a search may stop at the first
sum that no wanted score reaches: everything unvisited is certified to be irrelevant.

The codebooks are fitted on a bounded sample (``SAMPLE`` rows); every row is indexed. Their
size follows the number of rows, up to ``MOST_WORDS``, which bounds the cells at 65,536.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Rows on which the codebooks are fitted at most.
SAMPLE = 20_000
MOST_WORDS = 256
LEAST_WORDS = 4
#: Added to every bound against rounding.
SLACK = 1e-3


def words_for(rows: int) -> int:
    """Codewords per half: as many cells as the root of the number of rows."""
    return int(min(MOST_WORDS, max(LEAST_WORDS, round(rows**0.25))))


def _nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1)[None, :] - 2 * points @ words.T).argmin(1)


def codebook(points: np.ndarray, words: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k-means from a random choice of distinct points."""
    known = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = known[rng.choice(len(known), min(words, len(known)), replace=False)]
    for _ in range(rounds):
        label = _nearest(points, centres)
        size = np.bincount(label, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, label, points)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    """Codebooks of the two halves and what is known of the cells ``first word * words of the second + second``."""

    books: tuple[np.ndarray, np.ndarray]
    #: Rows per cell, and the largest distance of a half to its codeword there.
    sizes: np.ndarray
    radii: tuple[np.ndarray, np.ndarray]

    @property
    def width(self) -> int:
        return sum(book.shape[1] for book in self.books)

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.books[0].shape[1]
        return vectors[:, :cut], vectors[:, cut:]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell and the two distances of every vector."""
        words, gaps = [], []
        for half, book in zip(self.halves(vectors), self.books):
            words.append(_nearest(half, book))
            gaps.append(np.sqrt(((half - book[words[-1]]) ** 2).sum(1)))
        return words[0] * len(self.books[1]) + words[1], gaps[0], gaps[1]

    def with_cells(self, cells: np.ndarray, sizes: np.ndarray, first: np.ndarray, second: np.ndarray) -> Index:
        full = [np.zeros(len(self.books[0]) * len(self.books[1])) for _ in range(3)]
        for column, values in zip(full, (sizes, first, second)):
            column[cells] = values
        return Index(self.books, full[0].astype(np.int64), (full[1], full[2]))

    def order(self, vector: np.ndarray) -> Iterator[tuple[int, float, float, float]]:
        """``(cell, bound, upper, lower)`` of the cells that hold rows. ``bound`` falls from cell to cell and
        holds for all that follow; ``upper`` and ``lower`` enclose the scores within the cell."""
        second = len(self.books[1])
        by_cell = [r.reshape(-1, second) for r in self.radii]
        reach = [by_cell[0].max(1), by_cell[1].max(0)]
        parts = self.halves(vector[None, :])
        norms = [float(np.linalg.norm(p)) for p in parts]
        middles = [book @ p[0] for book, p in zip(self.books, parts)]
        uppers = [m + n * r for m, n, r in zip(middles, norms, reach)]
        ranks = [np.argsort(-u, kind="stable") for u in uppers]
        uppers = [u[r] for u, r in zip(uppers, ranks)]
        heap = [(-(uppers[0][0] + uppers[1][0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            # every cell has one way to be pushed: along the second half, and down the first from its head
            if j + 1 < len(uppers[1]):
                heapq.heappush(heap, (-(uppers[0][i] + uppers[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(uppers[0]):
                heapq.heappush(heap, (-(uppers[0][i + 1] + uppers[1][0]), i + 1, 0))
            a, b = ranks[0][i], ranks[1][j]
            cell = int(a * second + b)
            if self.sizes[cell]:
                middle = middles[0][a] + middles[1][b]
                spread = norms[0] * self.radii[0][cell] + norms[1] * self.radii[1][cell] + SLACK
                yield cell, -bound + SLACK, middle + spread, middle - spread


def fitted(sample: np.ndarray, rows: int, seed: int = 11) -> Index:
    """Codebooks from a sample; the cells are still unknown."""
    cut = (sample.shape[1] + 1) // 2
    words = words_for(rows)
    books = (codebook(sample[:, :cut], words, seed), codebook(sample[:, cut:], words, seed + 1))
    empty = np.zeros(len(books[0]) * len(books[1]))
    return Index(books, empty.astype(np.int64), (empty, empty))
