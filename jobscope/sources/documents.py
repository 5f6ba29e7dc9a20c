"""Large JSON documents, read in parallel: the elements of one top-level array, cut out where they stand.

A document is read as records that end at a closing brace, which is never part of an escape, so files are split
like lines.  What a byte means depends on everything before it, but only through two numbers: whether it is inside
a string, and how deep it is nested.  Each block of a file first says whether its quotes are odd in number, which tells
in order what the first byte of each means; then what it does to the depth; one row per block is added up in order;
then every block knows how it begins and cuts out its elements by itself.  Only the elements that go over the edge
of a block are put together from two or more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.session import cut_lineage

#: Blocks begin at most this deep; the name of an array stands in this many bytes before it.
DEEPEST, NAME_BYTES = 1000, 4096

_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_QUOTE, _ARRAY = 34, 91
_OPEN, _CLOSE = np.isin(np.arange(256), (91, 123)), np.isin(np.arange(256), (93, 125))
_BETWEEN = b", \t\n\r"


class _Bytes:
    """Records with their closing braces, as bytes and what each byte is outside of strings."""

    def __init__(self, text: bytes):
        self.text = text
        plain = _ESCAPE.sub(b"__", text) if b"\\" in text else text
        self.data = np.frombuffer(plain, dtype=np.uint8)
        self.quotes = np.cumsum(self.data == _QUOTE)
        self.parity = int(self.quotes[-1]) & 1 if len(self.data) else 0
        self.open = _OPEN[self.data]
        self.close = _CLOSE[self.data]

    def inside(self, state: int) -> np.ndarray:
        """Which bytes stand in a string (its last quote does not) if the first one does or not."""
        return ((self.quotes + state) & 1).astype(bool)

    def depth(self, inside: np.ndarray, start: int) -> np.ndarray:
        """Depth behind each byte."""
        return start + np.cumsum((self.open & ~inside).astype(np.int64) - (self.close & ~inside))

    def name(self, at: int) -> bytes | None:
        """The member that the array opened at ``at`` is the value of; None for an object, or inside an array."""
        if self.data[at] != _ARRAY:
            return None
        before = self.text[max(0, at - NAME_BYTES) : at].rstrip()
        quoted = before[:-1].rstrip() if before.endswith(b":") else b""
        if not quoted.endswith(b'"'):
            return None
        begin = end = len(quoted) - 1
        while (begin := quoted.rfind(b'"', 0, begin)) >= 0:
            if (begin - len(quoted[:begin].rstrip(b"\\"))) % 2 == 0:
                return quoted[begin + 1 : end]
        return None


def _effects(member: bytes, states: dict[tuple[int, int], int]):
    """Per block: the change of depth, and for each depth (from the start) how many brackets open there and whether
    the last one opens the array ``member``."""

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for place, text in _blocks_of(batch):
                found = _Bytes(text)
                state, delta, count, named = total.get(place) or (states[place], 0, Counter(), {})
                inside = found.inside(state)
                depth = found.depth(inside, delta)
                at = np.flatnonzero(found.open & ~inside)
                level = depth[at] - 1
                near = (level <= 2) & (level >= -DEEPEST)
                at, level = at[near], level[near]
                levels, last, number = np.unique(level[::-1], return_index=True, return_counts=True)
                for x, i, n in zip(levels.tolist(), last.tolist(), number.tolist()):
                    count[x] += n
                    named[x] = found.name(int(at[::-1][i])) == member
                total[place] = (state ^ found.parity, int(depth[-1]) if len(depth) else delta, count, named)
        rows = []
        for (file, block), (_, delta, count, named) in total.items():
            levels = [{"level": x, "n": n, "member": named[x]} for x, n in count.items()]
            rows.append({"file": file, "block": block, "delta": delta, "levels": levels})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_EFFECTS)

    return effects


_EFFECTS = pa.schema(
    [("file", pa.int64()), ("block", pa.int64()), ("delta", pa.int64())]
    + [("levels", pa.list_(pa.struct([("level", pa.int64()), ("n", pa.int64()), ("member", pa.bool_())])))]
)
_EFFECT_DDL = "file bigint, block bigint, delta bigint, levels array<struct<level:bigint,n:bigint,member:boolean>>"


def _blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], bytes]]:
    """The records of each block of a batch, in order, with the braces they end at."""
    file, block = (batch.column(i).to_numpy() for i in (0, 1))
    if not len(file):
        return
    values = batch.column(2).cast(pa.binary()).to_pylist()
    edges = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(file)]):
        yield (int(file[a]), int(block[a])), b"}".join(values[a:b]) + b"}"


def _states(parities: list) -> dict[tuple[int, int], int]:
    """Whether each block begins in a string."""
    out, file, state = {}, None, 0
    for row in sorted(parities):
        state = state if row["file"] == file else 0
        file = row["file"]
        out[file, row["block"]] = state
        state ^= row["parity"]
    return out


def _beginnings(effects: list, states: dict[tuple[int, int], int]) -> dict[tuple[int, int], tuple[int, int, bool, tuple[int, int]]]:
    """How each block begins: state, depth, whether in the array ``member``, and the element begun last (block, number)."""
    out, file = {}, None
    for row in sorted(effects, key=lambda r: (r["file"], r["block"])):
        place = row["file"], row["block"]
        if place[0] != file:
            file, depth, wanted, last = place[0], 0, False, (-1, -1)
        if depth > DEEPEST:
            raise ValueError(f"a document is nested more than {DEEPEST} deep")
        out[place] = (states[place], depth, wanted and depth >= 2, last)
        for x in row["levels"]:
            if x["level"] + depth == 1:
                wanted = x["member"]
            elif x["level"] + depth == 2:
                last = (place[1], x["n"] - 1)
        depth += row["delta"]
    return out


def _cut(member: bytes, beginnings: dict):
    """Pieces (file, block, number, part, whole, raw): of elements, and with number -1 of what is around them.

    ``block`` and ``number`` name the element, ``part`` the block that the piece stands in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        state = depth = number = 0
        wanted, element, held, around = False, (-1, -1), [], []

        def left() -> list:
            rows = []
            if held:
                rows.append((now[0], *element, now[1], False, b"".join(held)))
            rest = b"".join(around)
            return rows + [(now[0], now[1], -1, now[1], False, rest)] if rest else rows

        for batch in batches:
            rows: list = []
            for place, text in _blocks_of(batch):
                if place != now:
                    rows += left() if now else []
                    now, held, around, number = place, [], [], 0
                    state, depth, wanted, element = beginnings[place]
                found = _Bytes(text)
                inside = found.inside(state)
                after = found.depth(inside, depth)
                opening, closing = found.open & ~inside, found.close & ~inside
                # The array is entered and left where depth 1 is, elements where depth 2 is.
                events = np.flatnonzero((opening & (after <= 3)) | (closing & (after <= 2)))
                begin, gap = 0, 0
                for at, d, opens in zip(events.tolist(), after[events].tolist(), opening[events].tolist()):
                    if opens and d == 2:
                        wanted = found.name(at) == member
                        around.append(text[gap : at + 1])
                        gap = at + 1
                    elif opens and d == 3:
                        element, number = (place[1], number), number + 1
                        if wanted:
                            _only_separators(text[gap:at])
                            begin = at
                    elif not opens and d == 2 and wanted:
                        rows.append((place[0], *element, place[1], element[0] == place[1], b"".join([*held, text[begin : at + 1]])))
                        held, gap = [], at + 1
                    elif not opens and d == 1 and wanted:
                        _only_separators(text[gap:at])
                        wanted, gap = False, at
                    elif d < 0:
                        # The brace after the last record of a file, which has none.
                        text = text[:at]
                        break
                end = int(after[-1]) if len(after) else depth
                if wanted and end >= 3:
                    held.append(text[begin:])
                elif wanted:
                    _only_separators(text[gap:])
                else:
                    around.append(text[gap:])
                state, depth = state ^ found.parity, end
            if rows:
                yield _piece_batch(rows)
        if now and (rows := left()):
            yield _piece_batch(rows)

    return cut


def _only_separators(text: bytes) -> None:
    if text.strip(_BETWEEN):
        raise ValueError("the array has elements that are no objects")


_PIECE = "file bigint, block bigint, number bigint, part bigint, whole boolean, raw binary"


def _piece_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
    names = ["file", "block", "number", "part", "whole", "raw"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_elements(spark: SparkSession, path: str, member: str) -> tuple[DataFrame, DataFrame]:
    """(rest, elements) of JSON documents, one per file: the JSON text of each object in the top-level array ``member``
    as (file, block, number, raw), in order of (block, number), and each document without them as (file, raw).

    ``file`` is a number.  Files are read three times, in blocks of the session's ``spark.sql.files.maxPartitionBytes``,
    the last time to cut the pieces, which are written to the shared folder; the driver sees two short rows per block.
    A compressed file is one block.  An element that is no object is an error.
    """
    scan = spark.read.option("lineSep", "}").text(path)
    records = scan.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    unescaped = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.octet_length(unescaped) - F.octet_length(F.replace(unescaped, F.lit('"')))
    parities = records.groupBy("file", "block").agg((F.sum(quotes) % 2).cast("int").alias("parity"))
    states, wanted = _states(parities.collect()), member.encode("utf-8")
    effects = records.mapInArrow(_effects(wanted, states), _EFFECT_DDL).collect()
    pieces = cut_lineage(records.mapInArrow(_cut(wanted, _beginnings(effects, states)), _PIECE), "pieces")
    whole = pieces.where("whole").select("file", "block", "number", F.col("raw").cast("string").alias("raw"))

    def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("part", "raw")))
        text = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["raw"]))
        return rows.groupBy(*keys).agg(text.cast("string").alias("raw"))

    split = joined(pieces.where("not whole and number >= 0"), ["file", "block", "number"])
    return joined(pieces.where("number < 0"), ["file"]), whole.unionByName(split)
