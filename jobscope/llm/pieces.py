"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled to three transducers: the normaliser (a leading space, spaces to the escape symbol), the
pieces, and byte fallback for characters without a piece.  Composed with an input they give a lattice of positions
and pieces; the result is its shortest path in the tropical semiring (weights add along a path, the least wins).

Unigram models weigh a piece with its negative score.  Merge (BPE) models choose by merge order, which no sum of
piece weights expresses; but a sequence is what the merges give exactly if every two neighbours in it are, so the
piece transducer there has a state per last piece, and a pair that the merges would not leave weighs infinity.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import map_text, once_per_process

SPACE = "▁"
#: Words and pairs that a task remembers.
REMEMBERED = 400_000
# Kinds of pieces and of models in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(field number, value) of one protocol-buffer message: int, 4 or 8 bytes, or bytes."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    drop_extra_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> "Model":
        model = cls([])
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                model.pieces.append((piece.get(1, b"").decode("utf-8"), score, piece.get(3, NORMAL)))
            elif field == 2:
                spec = dict(_fields(value))
                model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
                model.dummy_prefix, model.drop_extra_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if model.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are supported")
        return model


class Transducer:
    """A compiled model: text to ids and back."""

    def __init__(self, model: Model):
        self.model = model
        self.arcs = {p: i for i, (p, _, k) in enumerate(model.pieces) if p and k in (NORMAL, USER)}
        self.weight = {i: -model.pieces[i][1] for i in self.arcs.values()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model.pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN), 0)
        self.worst = max(self.weight.values(), default=0.0) + 10
        # Where no piece goes on after a letter with a space, words can be composed one by one.
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in self.arcs)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        if model.kind == BPE:
            self.arcs = {p: i for p, i in self.arcs.items() if len(p) == 1 or self._merged(p) == [p]}
        #: Ends of pieces: a lattice position looks back only as far as its text is one.
        self.tails = {p[i:] for p in self.arcs for i in range(len(p))} if model.kind == UNIGRAM else set()
        #: Length of the longest piece by its first three characters; others have two at most.
        self.reach: dict[str, int] = {}
        for p in self.arcs:
            self.reach[p[:3]] = max(len(p), self.reach.get(p[:3], 2))

    def _merged(self, text: str) -> list[str]:
        """What the merges leave of a short text: the best-scored neighbours join first, the leftmost on ties."""
        parts, scores = list(text), self.model.pieces
        arcs = self.arcs
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = arcs.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or scores[piece][1] > best):
                    best, at = scores[piece][1], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fallback(self, char: str) -> tuple[int, ...]:
        data = char.encode("utf-8")
        if self.model.byte_fallback and all(b in self.bytes for b in data):
            return tuple(self.bytes[b] for b in data)
        return (self.unknown,)

    def _path(self, text: str) -> tuple[int, ...]:
        """Ids on the shortest path through the lattice of ``text`` (normalised)."""
        ends = self._merge_arcs(text) if self.model.kind == BPE else self._unigram_arcs(text)
        out: list[int] = []
        for start, length, piece in ends:
            if piece >= 0:
                out.append(piece)
            else:
                out += self._fallback(text[start : start + length])
        return tuple(out)

    def _unigram_arcs(self, text: str) -> list[tuple[int, int, int]]:
        """(start, length, piece) of the arcs on the path of least weight; piece -1 is the fallback."""
        ends: list[tuple[int, int, int]] = []
        weights = [0.0]
        for end in range(1, len(text) + 1):
            best, least = (end - 1, 1, -1), weights[end - 1] + self.worst
            start = end - 1
            while start >= 0 and (tail := text[start:end]) in self.tails:
                if (piece := self.arcs.get(tail)) is not None:
                    weight = weights[start] + self.weight[piece]
                    # A character that is a piece has no fallback.
                    if weight < least or start == end - 1:
                        best, least = (start, end - start, piece), weight
                start -= 1
            ends.append(best)
            weights.append(least)
        out, at = [], len(text)
        while at:
            out.append(ends[at - 1])
            at = ends[at - 1][0]
        return out[::-1]

    def _merge_arcs(self, text: str) -> list[tuple[int, int, int]]:
        """The arcs of the one path of finite weight in a merge model.

        Long arcs are tried first.  Arcs so far are what the merges give for the text up to here, so a position from
        which nothing goes on is no boundary of the whole text and is not visited again.
        """
        get, reach, pairs, size = self.arcs.get, self.reach.get, self.pairs, len(text)
        out: list[tuple[int, int, int]] = []
        dead = bytearray(size + 1)
        at, last = 0, -1
        length = min(size, reach(text[:3], 2))
        while at < size:
            while length:
                piece = get(text[at : at + length])
                if piece is None:
                    if length > 1:
                        length -= 1
                        continue
                    piece = -1
                if not dead[at + length]:
                    if piece < 0 or last < 0:
                        break
                    key = last << 32 | piece
                    fits = pairs.get(key)
                    if fits is None:
                        fits = self._pair(key)
                    if fits:
                        break
                length -= 1
            if length:
                out.append((at, length, piece))
                at += length
                last = piece
                length = min(size - at, reach(text[at : at + 3], 2))
            else:
                dead[at] = 1
                at, length, _ = out.pop()
                last = out[-1][2] if out else -1
                length -= 1
        return out

    def _pair(self, key: int) -> bool:
        """Whether the merges leave two neighbours as they are; the weight of the pair is infinite if not."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        a, b = self.model.pieces[key >> 32][0], self.model.pieces[key & 0xFFFFFFFF][0]
        fits = self.pairs[key] = self._merged(a + b) == [a, b]
        return fits

    def _word(self, text: str) -> tuple[int, ...]:
        ids = self.words.get(text)
        if ids is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            ids = self.words[text] = self._path(text)
        return ids

    def normalise(self, text: str) -> str:
        if self.model.drop_extra_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.model.dummy_prefix else text

    def encode(self, text: str) -> list[int]:
        text = self.normalise(text)
        if self.by_word:
            parts = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text) if SPACE * 2 in text else None
            if parts is None:
                first, *rest = text.split(SPACE)
                parts = ([first] if first else []) + [SPACE + r for r in rest]
            ids: list[int] = []
            for word in map(self._word, parts):
                ids += word
        else:
            ids = list(self._path(text))
        return ids if self.model.byte_fallback else self._joined(ids)

    def _joined(self, ids: list[int]) -> list[int]:
        """Neighbouring unknowns are one."""
        return [i for n, i in enumerate(ids) if i != self.unknown or not n or ids[n - 1] != self.unknown]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; control pieces are left out, broken bytes become the replacement character."""
        table = self._table()
        text = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def _table(self) -> list[bytes]:
        if not hasattr(self, "_bytes_of"):
            back = {i: b for b, i in self.bytes.items()}
            kinds = self.model.pieces
            self._bytes_of = [bytes([back[i]]) if i in back else b"" if k == CONTROL else p.encode("utf-8") for i, (p, _, k) in enumerate(kinds)]
        return self._bytes_of


def compiled(model: bytes) -> Transducer:
    """The transducer of a model file, compiled once per Python worker; it keeps the words that it has seen."""
    return once_per_process(f"pieces-{zlib.crc32(model)}-{len(model)}", lambda: Transducer(Model.parse(model)))


def encode(docs: DataFrame, model: bytes, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``ids`` of each whole text; null and empty texts have none."""

    def start():
        transducer = compiled(model)
        return lambda texts: [[transducer.encode(t.decode("utf-8", "replace")) if t else [] for t in texts]]

    return map_text(docs, [T.StructField("ids", T.ArrayType(T.IntegerType()))], start, keep=keep)


def decode(rows: DataFrame, model: bytes, keep: list[str] | None = None) -> DataFrame:
    """``rows`` (or its columns ``keep``) with ``decoded``, the text of the column ``ids``; null ids give null."""

    def start():
        transducer = compiled(model)
        return lambda _, ids: [[None if i is None else transducer.decode(i) for i in ids]]

    return map_text(rows.withColumn("__none", F.lit(None).cast("string")), [T.StructField("decoded", T.StringType())], start, text="__none", keep=keep or rows.columns, extra=[F.col("ids")])


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_ids, n_bytes, ids_crc32, same): each text encoded, its byte pieces, a checksum of the unsigned
    little-endian 32-bit ids, and whether decoding gives the text back.  Null texts count as empty.

    Texts come back as they are unless they hold the escape symbol itself.
    """
    fields = [T.StructField(n, T.LongType()) for n in ("n_ids", "n_bytes", "ids_crc32")] + [T.StructField("same", T.BooleanType())]

    def start():
        transducer = compiled(model)
        is_byte = np.zeros(len(transducer.model.pieces), dtype=bool)
        is_byte[list(transducer.bytes.values())] = True

        def compute(texts):
            rows = []
            for data in texts:
                text = data.decode("utf-8", "replace") if data else ""
                ids = transducer.encode(text)
                packed = np.array(ids, dtype="<u4")
                rows.append((len(ids), int(is_byte[packed].sum()), zlib.crc32(packed.tobytes()), transducer.decode(ids) == text))
            return list(zip(*rows))

        return compute

    return map_text(docs, fields, start, keep=["doc_id"])
