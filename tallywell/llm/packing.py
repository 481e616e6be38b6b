"""Packing documents into sequences: shortest-pack-first over the length histogram.

Each document's ids, closed by an end id, are cut into full sequences and a rest, so
lengths are known without comparing documents. The histogram of piece lengths (at most
``capacity`` rows) is all the packing needs: lengths are placed from the longest to the
shortest, each time into the pattern with the most room left, and a pattern is kept once
with the number of sequences that follow it. Every pattern then claims a range of
ranks of each of its lengths, and pieces find their sequence by their rank among the
pieces of that length. Ranks come from counts per length and chunk of pieces, so that
no length, however common, is sorted in one task.

Defined cases: a null text is empty, and an empty text is one piece with the end id alone; an empty table
gives no rows. Repeated rows are packed each, told apart by a row number.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywell.llm.common import ship_package, stored
from tallywell.llm.pretokens import pretokenizer, vocabulary_path

CAPACITY = 2048
END_ID = 1
#: Pieces that one chunk of the ranking holds on average.
CHUNK_ROWS = 50_000


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: full sequences and the rest of each document."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = pretokenizer(path).ids
        for batch in batches:
            owner, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = ids_of(text.as_py() or "") + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    owner.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
            columns = [batch.column(0).take(pa.array(owner, pa.int64()))]
            columns += [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


@dataclass
class Claim:
    """Ranks ``first`` up to ``first + sequences * times`` of a length lie in the sequences from
    ``sequence`` on, ``times`` to each, the first of them at ``offset``."""

    length: int
    first: int
    sequences: int
    times: int
    sequence: int
    offset: int


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns as ``(sequences, ((length, times), ...))``, longest length first.

    Placing a length splits at most one pattern and opens at most one, so there are
    no more than two patterns per length of the histogram and level of filling.
    """
    # room left (negated, for a heap), age, sequences, content
    open_patterns: list[tuple[int, int, int, tuple[tuple[int, int], ...]]] = []
    done: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    age = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if open_patterns and -open_patterns[0][0] >= length:
                room, _, sequences, content = heapq.heappop(open_patterns)
                room = -room
                times = 1
                if left >= sequences:  # as deep as the supply lasts, but not below the next pattern
                    below = -open_patterns[0][0] if open_patterns else 0
                    times = max(1, min(left // sequences, (room - below) // length, room // length))
                used = min(sequences, left)
                if used < sequences:
                    age += 1
                    heapq.heappush(open_patterns, (-room, age, sequences - used, content))
                content, room = (*content, (length, times)), room - times * length
                left -= used * times
            else:
                per = capacity // length
                whole = left // per
                if whole:
                    used, times = whole, per
                else:
                    used, times = 1, left
                content, room = ((length, times),), capacity - times * length
                left -= used * times
            if room == 0:
                done.append((used, content))
            else:
                age += 1
                heapq.heappush(open_patterns, (-room, age, used, content))
    return done + [(sequences, content) for _, _, sequences, content in sorted(open_patterns)]


def claims(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[Claim]:
    """The ranks that each pattern takes of its lengths, in the order of the patterns."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for sequences, content in patterns:
        offset = 0
        for length, times in content:
            first = taken.get(length, 0)
            out.append(Claim(length, first, sequences, times, sequence, offset))
            taken[length] = first + sequences * times
            offset += length * times
        sequence += sequences
    return out


def ranked(found: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``found`` with ``rank``, counted from 0 among the pieces of its length."""
    chunks = max(1, -(-found.count() // chunk_rows))
    split = found.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(chunks))
    )
    split = stored(split, "pieces")
    sizes = split.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = sizes.select(
        "length",
        "chunk",
        (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before"),
    )
    own = F.row_number().over(Window.partitionBy("chunk", "length").orderBy("doc_id", "start", "row"))
    return split.withColumn("own", own).join(before, ["length", "chunk"]).withColumn(
        "rank", F.col("before") + F.col("own") - 1
    )


def place(found: DataFrame, listed: list[Claim]) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ranked pieces. The claims are bounded by the
    capacity, not by the data, and go along with the tasks."""
    table = pd.DataFrame([vars(c) for c in listed])
    by_length = {int(n): g.sort_values("first").to_numpy() for n, g in table.groupby("length")} if len(table) else {}
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for n in np.unique(length):
                rows, own = np.flatnonzero(length == n), by_length[int(n)]
                claim = own[np.searchsorted(own[:, 1], rank[rows], "right") - 1]
                along = rank[rows] - claim[:, 1]
                sequence[rows] = claim[:, 4] + along // claim[:, 3]
                offset[rows] = claim[:, 5] + along % claim[:, 3] * n
            out = batch[columns].copy()
            out["sequence_id"], out["offset"] = sequence, offset
            yield out

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select(*columns, "rank").mapInPandas(
        assign,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row per piece."""
    path = path or vocabulary_path()
    ship_package(docs.sparkSession)
    cut = stored(pieces(docs, path, capacity, end_id), "cut")
    found = stored(ranked(cut), "ranked")
    histogram = {int(r[0]): int(r[1]) for r in found.groupBy("length").count().collect()}
    return place(found, claims(shortest_pack_first(histogram, capacity)))
