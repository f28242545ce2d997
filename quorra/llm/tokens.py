"""Exact and fast tokenization: pieces are cached, so the tokenizer only sees each distinct one.

The tokenizers split a text at white space before anything else, so a text's ids are those of its words, one after the
other. Where that could differ (white space outside ASCII, control separators, a special token's string, runs of three
white spaces) the whole text, or its units of white space and word, go through the tokenizer.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: White space that Unicode-aware patterns see and the units do not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", *map(chr, range(0x2000, 0x2010)), " ", " ", " ", " ", "⁠", "　", "﻿")
_UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_RARE = re.compile("[ \n]{3}|[ \n]{2}\\Z")
#: Pairs of white space without which there is no longer run of it.
_PAIRS = ("  ", "\n\n", "\n ", " \n")
#: Letters that one lower-case step maps to one letter and that no normal form changes, and a run of signs after them.
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ž]+)([!\"#$%&()*+,./:;<=>?@^_`{|}~-]*)\\Z")
#: Cached pieces of a worker; later ones are encoded each time they come.
CACHED = 600_000


def _letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


class Words(dict):
    """Word -> its ids as little-endian 16-bit numbers; where white space counts, that of the word after a space."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids must fit 16 bits")
        self.model = self.tokenizer.model
        self.spaced = self.tokenizer.normalizer is None  # white space counts; else it only separates
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.table = {k: c for k, c in enumerate(_letters())}
        self.units: dict[str, bytes] = {}  # runs of signs after letters, and units of texts with rare white space

    def __missing__(self, word: str) -> bytes:
        ids = self._encode(word)
        if len(self) < CACHED:
            self[word] = ids
        return ids

    def _model(self, raw: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(raw)]).tobytes()

    def _encode(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._model("\u0120" + word if self.spaced else word.lower())
        if self.spaced and word[:1] == "\n":  # the word after a line's end has no space before it
            found = _PLAIN.match(word, 1)
            if not found:
                return self.whole(word)
            letters, signs = found.groups()
            head = self._unit("\n") + self._model(letters.encode().decode("latin-1").translate(self.table))
            return head + self._unit(signs) if signs else head
        found = _PLAIN.match(word)
        if not found:
            return self.whole(" " + word if self.spaced else word)
        letters, signs = found.groups()
        if signs:
            return self[letters] + self._unit(signs)
        return self._model((" " + letters if self.spaced else letters.lower()).encode().decode("latin-1").translate(self.table))

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            ids = self.whole(unit)
            if len(self.units) < CACHED // 4:
                self.units[unit] = ids
        return ids

    def raw(self, text: str | None) -> bytes:
        """The ids of a whole text, 16 bits each; null and empty texts have none."""
        if not text:
            return b""
        if any(x in text for x in self.special) or (not text.isascii() or not text.isprintable()) and any(x in text for x in _ODD):
            return self.whole(text)
        if not self.spaced:
            return b"".join(map(self.__getitem__, text.split()))
        if "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text or any(x in text for x in _PAIRS) and _RARE.search(text):
            return b"".join(map(self._unit, _UNIT.findall(text)))
        # a new line is a unit of its own with the word that it touches, if any
        first, *rest = text.replace("\n", " \n").split(" ")
        # the first word has no space before it
        return (self._unit(first) if first else b"") + b"".join(map(self.__getitem__, rest))

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), dtype="<u2")


_loaded: dict[str, Words] = {}


def words(path: str) -> Words:
    """The worker's cache for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def public(name: str) -> str:
    """Path of a vocabulary file of the box; another place is a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path(name)
