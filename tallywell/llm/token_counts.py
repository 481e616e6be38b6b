"""Tokens per document from pre-token frequencies, without materialising ids.

Documents are read once, in blocks. A block holds the pre-token frequencies of its
documents as index pairs and lists each of its pre-tokens once. The pre-tokens of
all blocks are reduced to distinct ones, whose pieces are counted once each; the
counts are joined back to the blocks' lists, and a document's tokens are the sum of
frequency times pieces. A pre-token in every document is one row per block, so no
key is hot, and pairs of document and pre-token are never shuffled by pre-token.

Defined cases: a null text is empty and has 0 tokens; rows repeat as they come; an
empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import ship_package, stored
from tallywell.llm.pretokens import pretokenizer, vocabulary_path

#: Characters after which a block is closed (a longer document is a block of its own).
BLOCK_CHARS = 64_000_000
LIMIT = 2048


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers by byte planes: the high bytes are nearly all zero."""
    planes = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


class _Block:
    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.ids: list = []
        self.bytes: list[int] = []
        self.sizes: list[int] = []  # distinct pre-tokens per document
        self.words: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: object, text: str, pretokens: list[str]) -> None:
        index = self.index
        for p in set(pretokens):
            if p not in index:
                index[p] = len(index)
        at = np.fromiter(map(index.__getitem__, pretokens), np.int32, len(pretokens))
        found, times = np.unique(at, return_counts=True)
        self.ids.append(doc_id)
        self.bytes.append(len(text.encode("utf-8", "replace")))
        self.sizes.append(len(found))
        self.words.append(np.diff(found, prepend=0).astype("<i4"))
        self.times.append(times.astype("<i4"))
        self.chars += len(text)

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        empty = np.zeros(0, "<i4")
        values = [
            [uuid.uuid4().int >> 65],
            [self.ids],
            [self.bytes],
            [list(self.index)],
            [_packed(np.array(self.sizes, "<i4"))],
            [_packed(np.concatenate([empty, *self.words]))],
            [_packed(np.concatenate([empty, *self.times]))],
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(values, schema, strict=True)], schema=schema)


def frequencies(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per block: its documents' ids and bytes, its distinct pre-tokens, and packed
    per-document frequencies (sizes; differences of sorted pre-token numbers; times)."""
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema(
        [
            ("block", pa.int64()),
            ("ids", pa.list_(to_arrow_type(kind))),
            ("bytes", pa.list_(pa.int64())),
            ("pretokens", pa.list_(pa.string())),
            ("sizes", pa.binary()),
            ("words", pa.binary()),
            ("times", pa.binary()),
        ]
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pretokenizer(path).split
        block = _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                block.add(doc_id, text, split(text))
                if block.chars >= block_chars:
                    yield block.row(schema)
                    block = _Block()
        if block.ids:
            yield block.row(schema)

    return docs.select("doc_id", "text").mapInArrow(
        gather,
        f"block long, ids array<{kind.simpleString()}>, bytes array<bigint>, pretokens array<string>, "
        "sizes binary, words binary, times binary",
    )


def piece_counts(pretokens: DataFrame, path: str) -> DataFrame:
    """``(pretoken, pieces)`` of distinct pre-tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["pieces"] = pretokenizer(path).count(batch["pretoken"].tolist())
            yield batch

    return pretokens.mapInPandas(count, "pretoken string, pieces int")


def count_tokens(docs: DataFrame, path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for every row of ``docs``."""
    path = path or vocabulary_path()
    ship_package(docs.sparkSession)
    blocks = stored(frequencies(docs, path, block_chars), "pretokens")
    listed = blocks.select("block", F.posexplode("pretokens").alias("at", "pretoken"))
    pieces = piece_counts(listed.select("pretoken").distinct(), path)
    # position and count share one long, so that a block gets its counts back as one plain array
    back = (
        listed.join(pieces, "pretoken")
        .groupBy("block")
        .agg(F.collect_list(F.shiftleft(F.col("at").cast("long"), 32) + F.col("pieces")).alias("counts"))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, size, sizes, words, times, counts = (batch.column(k).slice(i, 1) for k in range(6))
                sizes = _unpacked(sizes[0].as_py())
                listed = counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                pieces = np.zeros(len(listed), np.int64)
                pieces[listed >> 32] = listed & 0xFFFFFFFF
                owner = np.repeat(np.arange(len(sizes)), sizes)
                steps = _unpacked(words[0].as_py()).astype(np.int64).cumsum()
                first = np.concatenate([[0], sizes.cumsum()[:-1]]).astype(np.int64)
                before = np.where(first > 0, steps[np.maximum(first - 1, 0)], 0) if len(steps) else np.zeros(len(sizes), np.int64)
                at = steps - before[owner]
                tokens = np.bincount(owner, _unpacked(times[0].as_py()) * pieces[at], len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [ids.flatten(), size.flatten(), pa.array(tokens.astype(np.int64))],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    return (
        blocks.join(back, "block", "left")
        .select("ids", "bytes", "sizes", "words", "times", F.coalesce("counts", F.array().cast("array<bigint>")))
        .mapInArrow(total, f"doc_id {kind}, n_bytes long, n_tokens long")
    )
