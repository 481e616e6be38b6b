"""The SentencePiece transducer against the library: runs, byte fallback, trimming, unigram weights, long units."""

from __future__ import annotations

import random
import struct
import time

import numpy as np
import pytest
import sentencepiece

from tallywell.llm.sentencepieces import MARK, Normaliser, Transducer, model_path


def ids(machine: Transducer, text: str) -> list[int]:
    return np.frombuffer(machine.encode(text), "<i4").tolist()


def field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message (tags, lengths and numbers below 16,384)."""

    def varint(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_file(folder, trim: bool) -> str:
    """A unigram model of pieces with made scores, with or without trimming."""
    pieces = {"ab": -2.0, "abc": -2.5, "bc": -1.0, "a": -3.0, "b": -3.0, "c": -3.5, MARK: -1.5, MARK + "a": -2.2}
    pieces |= {MARK + "abc": -6.0, "cab": -3.1, "d": -4.0}
    message = field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2))
    for piece, score in pieces.items():
        message += field(1, field(1, piece.encode()) + field(2, score) + field(3, 1))
    message += field(2, field(3, 1)) + field(3, field(3, 1) + field(4, int(trim)) + field(5, 1))
    path = str(folder / f"unigram-{trim}.model")
    with open(path, "wb") as file:
        file.write(message)
    return path


@pytest.fixture(scope="module")
def machine() -> Transducer:
    return Transducer(model_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 7, 16, 17, 31, 33, 100, 1001])
def test_runs_equal_the_library(machine, library, n):
    for text in (" " * n, " " * n + "a", "a" + " " * n + "\n" + " " * n, "-" * n, "=" * n + " " * n, "ab" * n, "\n" * n):
        assert ids(machine, text) == library.encode(text), text[:20]


def test_odd_characters_equal_the_library(machine, library):
    for text in ("", MARK, f" {MARK} x{MARK}", "͸é\U0010ffff", "a\tb\r\n c", "语言　模型", "é ﬁ", "<0x41> <s>"):
        assert ids(machine, text) == library.encode(text), text


def test_random_texts_equal_the_library(machine, library):
    draw = random.Random(5)
    for _ in range(400):
        letters = draw.choice([" ab", "  \n=", "aeiount hrs.", "日本 éü͸", "0123 .,-"])
        text = "".join(draw.choices(letters, k=draw.randrange(60)))
        assert ids(machine, text) == library.encode(text), text


@pytest.mark.parametrize("unit", [" ", "a", "xq", "语", "ab "])
def test_long_units_take_time_in_proportion(machine, unit):
    def seconds(n: int) -> float:
        begun = time.process_time()
        machine.encode(unit * n)
        return time.process_time() - begun

    seconds(2000)  # fills the arcs' weights
    assert seconds(200_000 // len(unit)) < 3


def test_merging_agrees_with_the_path(machine):
    draw = random.Random(6)
    for _ in range(300):
        unit = MARK * draw.randrange(4) + "".join(draw.choices("etaoinshr", k=draw.randrange(1, 24)))
        assert machine.best_path(unit) == machine.merged(unit)


@pytest.mark.parametrize("trim", [False, True])
def test_unigram_model_equals_the_library(tmp_path, trim):
    path = unigram_file(tmp_path, trim)
    machine, library = Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    draw = random.Random(7)
    for _ in range(300):
        text = "".join(draw.choices("abcd  ", k=draw.randrange(25)))
        assert ids(machine, text) == library.encode(text), text


def test_normaliser_states():
    keep, trim = Normaliser(True, False), Normaliser(True, True)
    assert keep.compose(Normaliser.START, "  a") == (Normaliser.WORD, MARK * 3 + "a")
    assert keep.compose(Normaliser.WORD, " a ") == (Normaliser.WORD, MARK + "a" + MARK)
    assert trim.compose(Normaliser.START, "  a  b ") == (Normaliser.GAP, f"{MARK}a{MARK}b")
    assert trim.compose(Normaliser.GAP, "a") == (Normaliser.WORD, MARK + "a")
    assert trim.compose(Normaliser.START, "  ") == (Normaliser.START, "")
    assert Normaliser(False, False).compose(Normaliser.START, "a") == (Normaliser.WORD, "a")
