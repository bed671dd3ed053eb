"""SentencePiece encoding and decoding with a prefix table.

In a merge-type model the encoding of a text's prefix ends in one certain token, and without that token it is the
encoding of the shorter prefix. So a table of each prefix's last token holds the whole encoding: going through the text
once, an automaton names the pieces that end at a place, and the one piece that the token before it is compatible with is
the entry. Two tokens are compatible if merging their joined text gives the two back, which is remembered per pair. The
ids are then read off backwards. The work is linear in the text, whatever its length.

A merge never crosses a place that no piece crosses. Where no piece has a space mark behind another character, texts are
cut in front of space marks, and each distinct segment of moderate length is encoded once per worker.

Defined for models without unused or user-defined pieces, with identity normalisation (checked when loading).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import documents, pieces

MARK = "▁"


class PieceEncoder:
    def __init__(self, path: str, limit: int = 500_000, longest: int = 64):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.vocab_size()
        self.bos, self.eos, self.unk = library.bos_id(), library.eos_id(), library.unk_id()
        if any(library.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces are not supported")
        for probe in ("  ａ ﬁ  ", "x"):
            if library.decode(library.encode(probe)) != probe or library.encode_as_pieces("x")[0][:1] != MARK:
                raise ValueError("only identity normalisation with a leading space mark is supported")
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.raw: list[bytes] = []
        for i in range(size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(i):
                self.raw.append(b"")
            elif i == self.unk:
                self.raw.append(" ⁇ ".encode())
            else:
                self.score[piece], self.ids[piece] = library.get_score(i), i
                self.raw.append(piece.replace(MARK, " ").encode())
        automaton = ahocorasick.Automaton()
        for piece in self.score:
            if len(piece) > 1:
                automaton.add_word(piece, (piece, len(piece)))
        automaton.make_automaton()
        self.automaton = automaton
        self.cut = self._cutter()
        self.follows: dict[str, dict[str, bool]] = {}  # by piece: what may stand in front of it, "" for nothing
        self.known: dict[str, bytes] = {}
        self.limit, self.longest = limit, longest

    def _cutter(self):
        """Cuts a text at places no piece crosses: in front of a space mark behind another character, on both sides of a
        line feed, and in front of a mark of punctuation behind a letter; of these, whichever the pieces allow."""
        if any(MARK in piece.lstrip(MARK) for piece in self.score):
            return lambda text: [text]
        behind: dict[str, set[str]] = {}
        for piece in self.score:
            for a, b in zip(piece, piece[1:]):
                behind.setdefault(b, set()).add(a)
        line = "" if any("\n" in p for p in self.score if len(p) > 1) else "\n"
        marks = "".join(re.escape(c) for c in ".,!?;:%&$#*|" if not any(a.isalpha() for a in behind.get(c, ())))
        letters = f"{MARK}*[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[{marks}])|" if marks else ""
        return re.compile(letters + f"{MARK}*[^{MARK}{line}]+|{MARK}+" + ("|\n" if line else "")).findall

    def merged(self, text: str) -> list[str]:
        """The model's own definition: join the neighbours of the best score, leftmost first, while any join is a
        piece. Only ever called on the text of two tokens."""
        parts = list(text)
        while len(parts) > 1:
            joins = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not joins:
                break
            i = min(joins)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether a text can end in ``piece`` behind the token ``before`` (empty: behind nothing)."""
        known = self.follows.get(piece)
        if known is None or len(known) > 100_000:
            known = self.follows[piece] = {}
        got = known.get(before)
        if got is None:
            got = known[before] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return got

    def tokens(self, text: str) -> list[str]:
        """The tokens of ``text`` (marks already in place), by the prefix table."""
        last: list[str] = []
        n = 0
        # matches come by where they end, of one end the longest first
        for end, (piece, size) in self.automaton.iter(text):
            if n > end:
                continue
            while n < end:
                last.append(text[n])
                n += 1
            j = end - size
            if self.fits(last[j] if j >= 0 else "", piece):
                last.append(piece)
                n += 1
        last.extend(text[n:])
        out, i = [], len(text) - 1
        while i >= 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def segment(self, text: str) -> bytes:
        """The ids of one segment as bytes; a character that is no piece becomes its UTF-8 bytes."""
        ids = array("I")
        for token in self.tokens(text):
            known = self.ids.get(token)
            if known is not None:
                ids.append(known)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in token.encode())
            else:
                ids.append(self.unk)
        return ids.tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Begin id, the ids of the whole text, end id."""
        known, out = self.known, [array("I", [self.bos]).tobytes()]
        if text:
            for part in self.cut(MARK + text.replace(" ", MARK)):
                ids = known.get(part)
                if ids is None:
                    ids = self.segment(part)
                    if len(part) <= self.longest:
                        known[part] = ids
                out.append(ids)
        if len(known) > self.limit:
            for old in list(known)[:len(known) // 2]:
                del known[old]
        out.append(array("I", [self.eos]).tobytes())
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: pieces and bytes joined, without the space in front that encoding adds."""
        ids = ids.tolist()
        joined = b"".join(map(self.raw.__getitem__, ids))
        first = next((i for i in ids if i not in (self.bos, self.eos)), self.eos)
        return (joined[1:] if joined[:1] == b" " and first != self.unk else joined).decode("utf-8", "replace")


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text; a null or empty text has the begin and end ids alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder(model_path)
        for batch in pieces(batches):
            ids = [model.encode(t).astype("int32") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": ids})

    return documents(docs, id_col, text_col).mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of ``encode_documents``' rows. A null list is an empty text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder(model_path)
        for batch in batches:
            text = [model.decode(np.asarray([] if x is None else x, "int64")) for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": text})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, in one pass without keeping the ids."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder(model_path)
        for batch in pieces(batches):
            rows = []
            for text in batch["text"]:
                ids = model.encode(text)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                             hashlib.sha256(model.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return documents(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
