"""Encoding of whole texts with a public tokenizer file, at the cost of its distinct words.

A text is cut where the tokenizer's own first split always cuts, and each distinct piece is encoded once per worker.
Both supported files split their input with a pattern whose matches never contain a white-space character behind a
character of another kind, and which looks ahead by one character at most, over white space only. So a cut between a
non-space and the white space behind it changes nothing, and a piece is ``white space* other+``. Characters outside
White_Space are never cut apart, so added tokens, combining marks and case folding see the same neighbours.

Most new pieces are a plain word with punctuation behind it. Those are two matches of the pattern (letters, then
others), need no normalising but lower case, and go straight to the tokenizer's model; every other piece takes the
tokenizer's whole path. A file whose split keeps white space is cut between the two as well. One whose split drops it gets
its pieces without white space.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

# The Unicode White_Space characters.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?|%&$#*"
# a plain word and the marks behind it are pieces of their own: far fewer distinct pieces than with the marks attached
PIECES = re.compile(f" ?[{LETTERS}]++(?=[{MARKS}]*+(?:[{WHITE_SPACE}]|\\Z))|[{MARKS}]++(?=[{WHITE_SPACE}]|\\Z)"
                    f"|[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+").findall
WORDS = re.compile(f"[^{WHITE_SPACE}]+").findall
WORD = re.compile(f"( ?)([{LETTERS}]+)([{MARKS}]*)").fullmatch


def byte_alphabet() -> dict[int, str]:
    """What the byte-level step makes of a space and of the Latin-1 letters: each byte of their UTF-8 form as one
    character. Printable Latin-1 bytes stand for themselves, the others follow from U+0100 on in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    char = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}
    return {c: "".join(char[b] for b in chr(c).encode()) for c in (0x20, *range(0xC0, 0x100))}


class WordEncoder(dict):
    """Ids (as bytes of unsigned 32-bit integers) by piece, filled on demand. ``limit`` bounds the pieces kept; the
    older half goes when it is reached."""

    def __init__(self, path: str, limit: int = 600_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lower = "Lowercase" in repr(self.tokenizer.normalizer)
        self.split = PIECES if self._whole(" ") or self._whole("\n") else WORDS
        self.bytes = byte_alphabet()
        self.limit = limit

    def _whole(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = WORD(piece)
        if found is None:
            ids = self._whole(piece)
        elif found[3]:
            ids = self[found[1] + found[2]] + (self._whole(found[3]) if len(found[3]) > 4 else self.mark(found[3]))
        else:
            word = piece.lower() if self.lower else piece
            ids = array("I", [t.id for t in self.model.tokenize(word.translate(self.bytes))]).tobytes()
        self[piece] = ids
        return ids

    def mark(self, text: str) -> bytes:
        ids = self.get(text)
        if ids is None:
            ids = self[text] = self._whole(text)
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text under ``encode(text, add_special_tokens=False)``, as unsigned 32-bit arrays."""
        get = self.__getitem__
        out = []
        for text in texts:
            out.append(np.frombuffer(b"".join(map(get, self.split(text))), "<u4"))
            if len(self) > self.limit:
                for old in list(self)[:len(self) // 2]:
                    del self[old]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
