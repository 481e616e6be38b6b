"""Lempel-Ziv phrase fingerprints of documents and their likeness.

A text is parsed into the phrases of an LZ78 dictionary: the shortest piece not seen
before becomes a phrase, and the next one starts after it. The phrases are hashed, and the
``SIZE`` smallest hashes of the set are the fingerprint, written as hexadecimal
text. The likeness of two fingerprints estimates the Jaccard similarity of the phrase sets
from the smallest hashes of their union: texts that compress well together share phrases.

Neighbours in order of id meet without a global sort: ids are cut into ranges that start at
sampled ids, a range's rows stand sorted in one task, and the first row of a range is sent to
the range before it, too. Texts are shuffled once.

Defined cases: a null text is empty; an empty text has an empty fingerprint, which is like
another empty one (1) and unlike all others (0). Null ids come first; rows of one id are
ordered by text. A single document is its own next document. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import ship_package

SIZE = 128
#: Rows per range of ids, about, while there are at most ``MOST_RANGES`` ranges.
RANGE_ROWS = 3_000
MOST_RANGES = 20_000


def parse(text: str, known: set[str], piece: str = "") -> tuple[list[str], str]:
    """Adds the phrases of ``text`` to ``known``, going on from the unfinished ``piece``; gives the new
    phrases and what is unfinished at the end."""
    new: list[str] = []
    add, note = known.add, new.append
    for char in text:
        piece += char
        if piece not in known:
            add(piece)
            note(piece)
            piece = ""
    return new, piece


def _hashes(phrases: list[str]) -> np.ndarray:
    raw = np.fromiter((zlib.crc32(p.encode("utf-8", "replace")) for p in phrases), np.uint64, len(phrases))
    raw = (raw + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    raw = (raw ^ (raw >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (raw >> np.uint64(32)).astype(np.uint32)


def _least(hashes: np.ndarray, size: int) -> np.ndarray:
    """The smallest distinct hashes in order."""
    if len(hashes) > 4 * size:
        some = np.unique(np.partition(hashes, 2 * size)[: 2 * size])
        if len(some) >= size:
            return some[:size]
    return np.unique(hashes)[:size]


def fingerprint(text: str | None, size: int = SIZE) -> np.ndarray:
    new, rest = parse(text or "", set())
    return _least(_hashes([*new, rest] if rest else new), size)


def fingerprint_pair(text: str, keep: int, tail: str, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``text`` and of its first ``keep`` code points followed by ``tail``; the
    common start is parsed and hashed once."""
    known: set[str] = set()
    new, open_piece = parse(text[:keep], known)
    start = _hashes(new)
    own, own_rest = parse(text[keep:], set(known), open_piece)
    other, other_rest = parse(tail, known, open_piece)
    return tuple(
        _least(np.concatenate([start, _hashes([*added, rest] if rest else added)]), size)
        for added, rest in ((own, own_rest), (other, other_rest))
    )


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of two phrase sets, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    merged = np.sort(np.concatenate([a, b]))
    repeated = merged[1:] == merged[:-1]
    distinct = np.concatenate([[True], ~repeated])
    counted = np.concatenate([repeated, [False]])[distinct][:size]  # per distinct hash: in both
    return float(counted.sum()) / len(counted)


def written(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def neighbours(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(range, ahead, doc_id, text)``, a range's rows sorted by id in one partition: the row after a
    row is its next document. ``ahead`` marks rows of the next range's first id, which stand last.

    What the driver sees is a sample of at most about eight ids per range.
    """
    total, least, nulls = docs.agg(
        F.count("*"), F.min("doc_id"), F.sum(F.col("doc_id").isNull().cast("long"))
    ).first()
    ranges = min(MOST_RANGES, max(1, -(-total // range_rows)))
    edge = int(min(1.0, 8 * ranges / max(total, 1)) * (1 << 30))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(47)), F.lit(1 << 30))
    sample = sorted(r[0] for r in docs.select("doc_id").dropna().filter(spread < edge).distinct().collect())
    step = max(1, len(sample) // ranges)
    starts = [s for s in sample[step::step] if s > least] if least is not None else []
    firsts = [None if nulls else least, *starts]
    numbers = np.array(starts, object if starts and isinstance(starts[0], str) else None)

    @F.pandas_udf("struct<own:int,before:int>")
    def place(ids: pd.Series) -> pd.DataFrame:
        known = ids.notna().to_numpy()
        own = np.zeros(len(ids), np.int32)
        if len(numbers) and known.any():
            own[known] = np.searchsorted(numbers, ids[known].to_numpy().astype(numbers.dtype), "right")
        before = pd.Series([None] * len(ids), dtype="Int32")
        for i, (value, at) in enumerate(zip(ids, own, strict=True)):
            first = firsts[at]
            if (first is None and not known[i]) or (first is not None and known[i] and value == first):
                before.iloc[i] = int(at - 1) if at else len(firsts) - 1
        return pd.DataFrame({"own": own, "before": before})

    copies = F.when(
        F.col("at.before").isNull(), F.array(F.struct(F.col("at.own").alias("range"), F.lit(False).alias("ahead")))
    ).otherwise(
        F.array(
            F.struct(F.col("at.own").alias("range"), F.lit(False).alias("ahead")),
            F.struct(F.col("at.before").alias("range"), F.lit(True).alias("ahead")),
        )
    )
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place("doc_id").alias("at"))
        .select(F.explode(copies).alias("to"), "doc_id", "text")
        .select("to.range", "to.ahead", "doc_id", "text")
        .repartitionById(len(firsts), F.col("range"))
        .sortWithinPartitions("range", "ahead", F.asc_nulls_first("doc_id"), "text")
    )


def fingerprints(docs: DataFrame, size: int = SIZE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``
    per row: fingerprints of the text and of the text whose last quarter is replaced by the start of
    the next document, and the likeness of the first to the second and to the next document's."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def answers(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Rows ``(range, ahead, doc_id, text)``; a row is done when the fingerprint of the next is known."""
        held = print_of_held = done = None  # the last row, and the one before it with its answer but the last column
        for row in rows:
            if held is not None and row[0] == held[0]:
                if held[1]:  # a second copy of the first id ahead
                    continue
                text, quarter = held[3], len(held[3]) // 4
                keep, tail = len(text) - quarter, row[3][:quarter]
                own, edited = fingerprint_pair(text, keep, tail, size)
                if done is not None:
                    yield (*done, likeness(print_of_held, own, size))
                digest = hashlib.sha256((text[:keep] + tail).encode("utf-8", "replace")).hexdigest()
                done = (held[2], len(text), digest, written(own), written(edited), likeness(own, edited, size))
                print_of_held = own
            if row[1] and not (held is not None and held[1] and held[0] == row[0]):
                if done is not None:
                    yield (*done, likeness(print_of_held, fingerprint(row[3], size), size))
                done = None
            held = row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)

        chunk = []
        for answer in answers(rows()):
            chunk.append(answer)
            if len(chunk) == 1000:
                yield _batch(chunk)
                chunk = []
        if chunk:
            yield _batch(chunk)

    id_type = _arrow_type(docs)

    def _batch(chunk: list[tuple]) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = zip(*chunk, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return neighbours(docs, range_rows).mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)
