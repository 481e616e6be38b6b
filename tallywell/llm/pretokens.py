"""Pre-tokens of a word-end BPE file of the ``tokenizers`` library, and their ids.

The file's pipeline (NFC, white space to spaces, lower case, a splitting pattern)
is followed by Python's ``re`` on texts whose characters behave alike in both
engines: Latin letters, ASCII and common punctuation. Any other text goes through the
library's own normaliser and pre-tokeniser. Special strings inside a text are
tokens of their own, as is the library's default.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallywell.llm.cache import GenerationCache, held

VOCABULARY = "word_bpe_49k.json"
#: Fixed value: the splitting pattern of the file, for texts of plain characters.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Controls, numbers beyond ASCII digits and all letters beyond Latin are not plain.
_NOT_PLAIN = re.compile("[^\t\n\r -~ -±´-¸º»¿-ɏ‐-‧‰-›€]")


class PreTokenizer:
    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        special = self.library.get_added_tokens_decoder().values()
        self.special = {t.content for t in special}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special))) + ")") if special else None
        self._model = self.library.model
        self._words = GenerationCache()
        self._pieces = GenerationCache()

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings, these included."""
        if self._special is None or not any(s in text for s in self.special):
            return [text]
        return [part for part in self._special.split(text) if part]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of the text in order."""
        out: list[str] = []
        for part in self.parts(text):
            if part in self.special:
                out.append(part)
            elif _NOT_PLAIN.search(part) is None:
                out.extend(_SPLIT.findall(part.lower()))
            else:
                plain = self.library.normalizer.normalize_str(part)
                out.extend(plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain))
        return out

    def count(self, pretokens: list[str]) -> list[int]:
        """The number of pieces of each pre-token."""
        return [len(e) for e in self.library.encode_batch_fast(pretokens, add_special_tokens=False)]

    def _piece_ids(self, pretoken: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one pre-token."""
        found = self._pieces.get(pretoken)
        if found is None:
            if pretoken in self.special:
                ids = [self.library.token_to_id(pretoken)]
            else:
                plain = pretoken.isascii() and pretoken.isprintable()
                spelt = pretoken if plain else pretoken.encode().decode("latin-1").translate(_BYTE_CHARS)
                ids = [t.id for t in self._model.tokenize(spelt)]
            found = self._pieces.put(pretoken, np.array(ids, "<u4").tobytes())
        return found

    def ids(self, text: str) -> bytes:
        """The text's ids, four bytes each. Words between white space repeat, so they are
        looked up whole; pre-tokens never span white space."""
        piece = self._piece_ids
        out: list[bytes] = []
        for part in self.parts(text):
            if part in self.special or _NOT_PLAIN.search(part) is not None:
                out.extend(map(piece, self.split(part)))
                continue
            known = self._words
            words = part.lower().split()
            found = list(map(known.new.get, words))
            if None in found:
                for i, ids in enumerate(found):
                    if ids is None:
                        word = words[i]
                        ids = known.get(word)
                        if ids is None:
                            ids = known.put(word, b"".join(map(piece, _SPLIT.findall(word))))
                        found[i] = ids
            out.extend(found)
        return b"".join(out)


def _byte_chars() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable Latin-1 as itself, others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


def pretokenizer(path: str) -> PreTokenizer:
    """One instance per worker process and file: its caches outlive a task."""
    return held(("pretokens", path), lambda: PreTokenizer(path))


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)
