"""SentencePiece encoding and decoding as weighted transducers with tropical shortest paths.

The model file is compiled into two transducers, which every input is composed with.

The normaliser is deterministic: its arcs read one character and write the normalised ones, a mark in front
of the first and for every space; for models that trim, its states hold back the spaces before they are known
to stand between words.

The pieces' transducer has the states (place, last piece). One arc reads the characters of a piece and writes
its id; the arcs of byte fallback read one character that is no piece and write its bytes' ids (the unknown id in
models without them). A path's weight is the sum of its arcs, the best path the least. In a BPE model an arc weighs
0 if piece and last piece can stand side by side - if merging their joined characters gives just
these two again - and infinity otherwise. A sequence of pieces is what merging gives for the whole
exactly if all neighbours can stand so, so one path of finite weight remains; that merging takes the
leftmost of equal pairs first is part of these weights, so runs of one character need no rule of their own. In a
unigram model an arc weighs the piece's negated score, a fallback arc more than any piece.

No piece reaches over a change from other characters to the mark or over a line feed, so these cut
the input into units, which are composed one by one, short ones once per worker while they stay in the cache.

Defined cases: null and empty texts have no ids; decoding no ids gives the empty text; an empty table has no rows.
Rows repeat as they come. Texts and units of any length take time and memory in proportion to their length.
Models with character maps, control pieces within texts or user-defined pieces are refused.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from tallywell.llm.cache import GenerationCache, held
from tallywell.llm.common import ship_package

MODEL = "piece_bpe_32k.model"
MARK = "▁"
# Field numbers and kinds of the public model format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER_DEFINED, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: How much more than the dearest piece a fallback arc weighs in a unigram model (fixed by the public library).
_FALLBACK_PENALTY = 10.0
#: Longer units are rare and seldom repeat: they are composed anew each time.
_CACHED_UNIT = 256


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class Normaliser:
    """States START (nothing written yet), WORD and, if spaces are trimmed, GAP (a space held back).

    ``arcs[state]`` holds the next state and what is written, for a space and for (before) any other character.
    """

    START, WORD, GAP = 0, 1, 2

    def __init__(self, dummy_prefix: bool, trim: bool) -> None:
        start, word, gap = self.START, self.WORD, self.GAP
        front = MARK if dummy_prefix else ""
        if trim:
            self.space = {start: (start, ""), word: (gap, ""), gap: (gap, "")}
        else:
            self.space = {start: (word, front + MARK), word: (word, MARK), gap: (word, MARK)}
        self.other = {start: (word, front), word: (word, ""), gap: (word, MARK)}

    def compose(self, state: int, unit: str) -> tuple[int, str]:
        """The state after the unit and what is written for it."""
        out = []
        for part in _RUNS.findall(unit):
            if part == " ":
                state, written = self.space[state]
                out.append(written)
            else:
                state, written = self.other[state]
                out.append(written + part)
        return state, "".join(out)


class Transducer:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        trainer = dict(next((_fields(v) for k, v in parts if k == _TRAINER), iter(())))
        normalizer = dict(next((_fields(v) for k, v in parts if k == _NORMALIZER), iter(())))
        if normalizer.get(2):
            raise ValueError("models with a character map are not supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.trim = bool(normalizer.get(4, 1))
        self.bpe = trainer.get(3, _UNIGRAM) == _BPE
        if trainer.get(3, _UNIGRAM) not in (_UNIGRAM, _BPE):
            raise ValueError("only BPE and unigram models are supported")
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.surface: list[bytes] = []
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        for number, raw in enumerate(v for k, v in parts if k == _PIECES):
            piece = dict(_fields(raw))
            text, kind = piece[1].decode(), piece.get(3, _NORMAL)
            self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            self.surface.append(text.replace(MARK, " ").encode())
            if kind == _NORMAL:
                self.ids[text] = number
            elif kind == _BYTE:
                self.bytes[int(text[3:5], 16)] = number
                self.surface[-1] = bytes([int(text[3:5], 16)])
            elif kind == _UNKNOWN:
                self.unknown = number
                self.surface[-1] = " ⁇ ".encode()
            elif kind == _CONTROL:
                self.surface[-1] = b""
            elif kind == _USER_DEFINED:
                raise ValueError("models with user-defined pieces are not supported")
        self.longest = max(map(len, self.ids), default=1)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids if len(p) > 1):
            raise ValueError("pieces must not reach over the mark or a line feed")
        self._score = {piece: self.scores[number] for piece, number in self.ids.items()}
        self._fallback_weight = _FALLBACK_PENALTY - min(self._score.values(), default=0.0)
        self._written = {piece: struct.pack("<i", number) for piece, number in self.ids.items()}
        # the arcs by the first three characters they read: how many they read, most first
        reads: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 2:
                reads.setdefault(piece[:3], {1, 2} if piece[:2] in self.ids else {1}).add(len(piece))
        self._reads = {start: tuple(sorted(sizes, reverse=True)) for start, sizes in reads.items()}
        self.normaliser = Normaliser(self.dummy_prefix, self.trim)
        self._weights: dict[tuple[str, str], float] = {}
        # per state before the unit: START, WORD, GAP
        self._units = [GenerationCache[tuple[int, bytes]](limit) for limit in (50_000, 450_000, 50_000)]

    def merged(self, text: str) -> list[str]:
        """What merging the best neighbours, leftmost first among equals, leaves of the characters."""
        score, never = self._score.get, -math.inf
        parts = list(text)
        pairs = [score(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == never:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], never)
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], never)
        return parts

    def weight(self, last: str, piece: str) -> float:
        """The weight of an arc that reads ``piece`` from a state whose last piece is ``last`` ("" at the start)."""
        if not self.bpe:
            found = -self._score[piece] if piece in self._score else self._fallback_weight
        else:
            found = 0.0 if self.merged(last + piece) == ([last, piece] if last else [piece]) else math.inf
        if len(self._weights) >= 1_000_000:
            self._weights.clear()
        self._weights[last, piece] = found
        return found

    def best_path(self, unit: str) -> list[str]:
        """The arcs, by what they read, of the best path through the composition of the normalised unit."""
        return self._finite_path(unit) if self.bpe else self._least_path(unit)

    def _sizes(self, unit: str, at: int) -> tuple[int, ...]:
        """How many characters the arcs at this place may read, most first."""
        return self._reads.get(unit[at : at + 3]) or (_TWO if unit[at : at + 2] in self.ids else _ONE)

    def _least_path(self, unit: str) -> list[str]:
        """Place by place. Per place one state is kept, the one of least weight: arcs do not depend on the last piece."""
        weights, pieces = [0.0] + [math.inf] * len(unit), [""] * (len(unit) + 1)
        for start in range(len(unit)):
            for size in self._sizes(unit, start):
                piece = unit[start : start + size]
                if len(piece) == size and (size == 1 or piece in self.ids):
                    total = weights[start] + self.weight("", piece)
                    if total < weights[start + size]:
                        weights[start + size], pieces[start + size] = total, piece
        out, at = [], len(unit)
        while at:
            out.append(pieces[at])
            at -= len(pieces[at])
        return out[::-1]

    def _finite_path(self, unit: str) -> list[str]:
        """Where arcs weigh 0 or infinity, the first finite path found is the least: depth first, longer arcs first.

        A place has one last piece on all finite paths to it - what merging leaves of the characters
        before it ends in that one -, so a place that led nowhere is not entered again, and the
        search takes time in proportion to the unit.
        """
        ids, sizes, arcs = self.ids, self._sizes, self._weights.get
        total, at, last = len(unit), 0, ""
        path: list[str] = []
        dead: set[int] = set()
        while at < total:
            for size in sizes(unit, at):
                piece = unit[at : at + size]
                if len(piece) < size or (size > 1 and piece not in ids) or at + size in dead:
                    continue
                arc = arcs((last, piece))
                if (self.weight(last, piece) if arc is None else arc) == 0.0:
                    path.append(piece)
                    at, last = at + size, piece
                    break
            else:
                dead.add(at)
                at -= len(path.pop())
                last = path[-1] if path else ""
        return path

    def written(self, piece: str) -> bytes:
        """What the arc that reads ``piece`` writes: its id, or those of the bytes of a character that is no piece."""
        found = self._written.get(piece)
        if found is not None:
            return found
        if not self.bytes:
            return struct.pack("<i", self.unknown)
        return b"".join(struct.pack("<i", self.bytes[b]) for b in piece.encode("utf-8", "replace"))

    def compose(self, state: int, unit: str) -> tuple[int, bytes]:
        """The normaliser's state after the unit, and the ids along the best path of the composition."""
        after, normal = self.normaliser.compose(state, unit)
        found = after, b"".join(map(self.written, self.best_path(normal)))
        return self._units[state].put(unit, found) if len(unit) <= _CACHED_UNIT else found

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the text."""
        out, state = [], Normaliser.START
        for unit in _UNITS.findall(text):
            cache = self._units[state]
            state, ids = cache.new.get(unit) or cache.get(unit) or self.compose(state, unit)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The inverse: the pieces' characters, marks as spaces, byte pieces joined, the first space taken away."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids.tolist()])
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_ONE, _TWO = (1,), (2, 1)
_RUNS = re.compile(" |[^ ]+")
_UNITS = re.compile(f"\n|[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+")


def transducer(path: str) -> Transducer:
    """One instance per worker process and model file."""
    return held(("pieces", path), lambda: Transducer(path))


def model_path(name: str = MODEL) -> str:
    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids, n_tokens, decoded_sha256, round_trip)`` per row: the ids of the whole text, the digest of
    what they decode to, and whether that is the text again."""
    path = path or model_path()
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                flat, ends, digests, same = [], [0], [], []
                for text in batch.column(1).to_pylist():
                    text = text or ""
                    ids = machine.encode(text)
                    back = machine.decode(np.frombuffer(ids, "<i4"))
                    flat.append(ids)
                    ends.append(ends[-1] + len(ids) // 4)
                    digests.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                    same.append(back == text)
                values = pa.array(np.frombuffer(b"".join(flat), "<i4"))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), listed, pa.array(np.diff(ends)), pa.array(digests), pa.array(same)],
                    names=["doc_id", "ids", "n_tokens", "decoded_sha256", "round_trip"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean"
    )
