"""Exact encoding and decoding with merge-type SentencePiece models, by backtracking.

A merge-type model joins the adjacent pair whose joint piece scores highest (the leftmost on ties)
until no joint piece is left. Which merges happen inside a stretch of text depends on the order of
score and place alone, and that order is the same in any longer text. Hence a row of pieces is the
encoding of a text exactly if every two neighbours are the encoding of their own joint text, and
there is one such row. It is searched from left to right: take the longest piece that starts here
(one Aho-Corasick pass finds them all), ask whether it may follow the piece before by merging the
two anew, else take its next shorter prefix; where none is left, mark the place as failed and take
back the piece before. No place fails twice, so the work is linear in the text.

Texts are cut where no piece can span: between two characters that no piece has side by side
because one is in no longer piece at all, or because a space mark follows something else. Encodings
of short stretches are remembered by each worker; that touches the cost only.

The model is read on the driver (its size is bounded by its vocabulary) and sent to the executors.
Texts are not shuffled.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a space inside pieces.
MARK = "▁"
#: Stretches and pairs of pieces remembered by each worker (twice as many for a while), and the longest such stretch.
REMEMBERED, REMEMBERED_CHARS = 700_000, 48
#: Bytes of byte ids that are not ASCII, while a text is put together.
ESCAPED = re.compile("[\ud800\udc80-\udcff]")
#: Stands for a control id, which ends a run of bytes.
CONTROL = "\ud800"

ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


@dataclass(frozen=True)
class PieceModel:
    """What encoding and decoding need of a model file.

    ``pieces``   text of every id that stands for text, ``None`` for control, unknown and byte ids.
    ``scores``   score of every id.
    ``bytes_of`` id to byte value, of byte ids.
    ``unknown``  the unknown id.
    ``prefix``   whether a space mark is put before each text.
    """

    pieces: list[str | None]
    scores: list[float]
    bytes_of: dict[int, int]
    unknown: int
    prefix: bool


def read_model(path: str) -> PieceModel:
    """Read a model file on the driver; models whose rules differ from those above are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal, rules, kind = model.normalizer_spec, model.trainer_spec, proto.ModelProto.SentencePiece
    if rules.model_type != proto.TrainerSpec.BPE or not rules.byte_fallback:
        raise ValueError("only merge-type models with byte pieces can be read")
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
        raise ValueError("models that rewrite texts before encoding are not supported")
    if rules.treat_whitespace_as_suffix or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
        raise ValueError("models with space suffixes, own or unused pieces are not supported")
    return PieceModel(
        pieces=[p.piece if p.type == kind.NORMAL else None for p in model.pieces],
        scores=[p.score for p in model.pieces],
        bytes_of={i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == kind.BYTE},
        unknown=next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN),
        prefix=normal.add_dummy_prefix,
    )


def merged(text: str, score: dict[str, float]) -> list[str]:
    """The pieces of a short text by plain merging; used for single pieces and for pairs of them."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            found = score.get(parts[k] + parts[k + 1])
            if found is not None and (best is None or found > best):
                best, at = found, k
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Remembered(dict):
    """Results of ``make`` by text: when full, what was not asked for since the last time it was full goes."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class Codec:
    """Encodes and decodes with one model; holds what can be worked out beforehand."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.id_of = {piece: i for i, piece in enumerate(model.pieces) if piece is not None}
        self.score = {piece: model.scores[i] for piece, i in self.id_of.items()}
        self.byte_ids = {value: i for i, value in model.bytes_of.items()}
        # a piece that merging does not give for its own text is in no encoding
        usable = {p for p in self.id_of if len(p) > 1 and merged(p, self.score) == [p]}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in usable), p[0]) for p in usable}
        self.automaton = ahocorasick.Automaton()
        for piece in usable:
            self.automaton.add_word(piece, (piece, len(piece) - 1))
        self.automaton.make_automaton()
        self.stretches = re.compile(self._stretch(usable), re.DOTALL)
        self.compatible: dict[tuple[str, str], bool] = {}
        self.known = Remembered(self._ids)
        # bytes above ASCII stand as lone surrogates, which no piece holds, until the text is whole
        self.text_of = [CONTROL if piece is None else piece for piece in model.pieces]
        for i, value in model.bytes_of.items():
            self.text_of[i] = chr(value if value < 0x80 else 0xDC00 + value)
        self.text_of[model.unknown] = " ⁇ "

    @staticmethod
    def _stretch(usable: set[str]) -> str:
        """Stretches of text that no merge leaves."""
        if not usable:
            return "."
        joined = "".join(map(re.escape, sorted(set("".join(usable)) - {MARK})))
        if any(MARK in p.lstrip(MARK) for p in usable):
            return f"[{MARK}{joined}]+|."
        return f"{MARK}+[{joined}]*|[{joined}]+|." if joined else f"{MARK}+|."

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left``: merging their joint text gives the two again."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= REMEMBERED:
                self.compatible.clear()
            known = self.compatible[left, right] = merged(left + right, self.score) == [left, right]
        return known

    def cut(self, text: str) -> list[str]:
        """Pieces of one stretch by longest matches and backtracking."""
        longest = list(text)
        if len(longest) == 1:
            return longest
        for end, (piece, before) in self.automaton.iter(text) if self.shorter else ():
            longest[end - before] = piece  # of pieces that start here, the one that ends last comes last
        fits, shorter, size = self.compatible.get, self.shorter, len(text)
        failed, out, at, last, piece = bytearray(size + 1), [], 0, "", longest[0]
        while True:
            end = at + len(piece)
            if not failed[end] and (not last or (fits((last, piece)) or self.fits(last, piece))):
                out.append(piece)
                if end == size:
                    return out
                at, last, piece = end, piece, longest[end]
            elif end - at > 1:
                piece = shorter[piece]
            else:
                failed[at] = 1
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""

    def _ids(self, stretch: str) -> bytes:
        """Ids of a stretch as 32-bit numbers; a character that the model lacks has the ids of its bytes."""
        pieces = self.cut(stretch)
        try:
            return array("i", map(self.id_of.__getitem__, pieces)).tobytes()
        except KeyError:
            return array("i", (i for piece in pieces for i in self._lacking(piece))).tobytes()

    def _lacking(self, piece: str) -> list[int]:
        if piece in self.id_of:
            return [self.id_of[piece]]
        return [self.byte_ids.get(b, self.model.unknown) for b in piece.encode("utf-8", "surrogatepass")]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, without begin or end ids; a missing text is empty."""
        marked = (MARK if self.model.prefix else "") + text.replace(" ", MARK) if text else ""
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.stretches.findall(marked))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids say nothing, byte ids are UTF-8 and each byte that is not becomes U+FFFD."""
        text = "".join(map(self.text_of.__getitem__, ids.tolist())).lstrip(CONTROL)
        text = (text.removeprefix(MARK) if self.model.prefix else text).replace(MARK, " ")
        if ESCAPED.search(text):
            text = "".join(t.encode("utf-8", "surrogateescape").decode("utf-8", "each-byte") for t in text.split(CONTROL))
        return text


_CODECS: dict[str, Codec] = {}


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``__encoded``: the ids of each whole text and the text they decode to.

    One row per input row, repeated ones too; a missing or empty text has no ids and decodes to the
    empty text. Very long texts are encoded whole, in memory linear in the text. Other columns are
    passed on whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_model(path))

    @F.pandas_udf(ENCODED)
    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if path not in _CODECS:
            _CODECS.clear()
            _CODECS[path] = Codec(sent.value)
        codec = _CODECS[path]
        for batch in texts:
            ids = [codec.encode(t) for t in batch]
            yield pd.DataFrame({"ids": ids, "decoded": [codec.decode(i) for i in ids]})

    return docs.withColumn("__encoded", encoded(F.col(text)))
