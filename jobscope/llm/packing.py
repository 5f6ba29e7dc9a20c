"""Packing of tokenised documents into fixed-length sequences by length patterns.

The histogram of piece lengths, at most one number per length, is all that the plan needs: patterns of one to
three lengths that fill a sequence are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what is left is packed best-fit by length.  The plan then says
for the n-th piece of each length where it goes, so that pieces are placed where they are.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import map_text, small, stored

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that a task numbers.
ROWS_PER_COUNTER = 200_000
#: Gradient steps of the fit, and the most columns that it takes.
FIT_STEPS = 400
MOST_PATTERNS = 200_000
#: Words whose ids a task remembers.
REMEMBERED = 200_000
# Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: visible bytes are themselves."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_bpe_encoder(definition: str):
    """text -> ids of the byte-level BPE in ``definition`` (JSON text), as the ``tokenizers`` library gives them.

    Merging is done by ``tiktoken`` on the same vocabulary, and words (the text from one single space to the next)
    are remembered: a space that is not next to another one always starts a new word there.  Texts with special
    tokens go through ``tokenizers`` itself.
    """
    import tiktoken

    data = json.loads(definition)
    symbols = _byte_of_symbol()
    special = {t["content"]: t["id"] for t in data.get("added_tokens", ())}
    ranks = {bytes(symbols[c] for c in token): i for token, i in data["model"]["vocab"].items() if token not in special}
    encode = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = []

    class Words(dict):
        def __missing__(self, word):
            if len(self) >= REMEMBERED:
                self.clear()
            ids = self[word] = encode(" " + word)
            return ids

    words = Words()

    def ids_of(text: str) -> list[int]:
        if any(s in text for s in special):
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_str(definition))
            return whole[0].encode(text, add_special_tokens=False).ids
        if "  " in text:
            return encode(text)
        first, *rest = text.split(" ")
        return encode(first) + list(chain.from_iterable(map(words.__getitem__, rest)))

    return ids_of


def pieces(docs: DataFrame, definition: str, capacity: int = CAPACITY, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and ``end``, cut only beyond ``capacity``.

    The first piece of a longer document takes what the others, all of full length, leave.  Null texts count as
    empty and are one piece with ``end`` alone.
    """
    part = [T.StructField("piece", T.IntegerType())]
    part += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    part += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    field = T.StructField("__pieces", T.ArrayType(T.StructType(part)))

    def start():
        encode = byte_bpe_encoder(definition)

        def compute(texts):
            rows = []
            for text in texts:
                ids = np.array([*encode(text.decode("utf-8", "replace") if text else ""), end], dtype="<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                out = []
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    piece = {"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())}
                    out.append(piece | ({"ids": ids[a:b]} if with_ids else {}))
                rows.append(out)
            return [rows]

        return compute

    return map_text(docs, [field], start, keep=["doc_id"]).select("doc_id", F.inline("__pieces"))


def _patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Up to three lengths per row (0: none) that fill a sequence, of lengths that occur."""
    have = np.flatnonzero(counts)
    pairs = [(a, capacity - a, 0) for a in have.tolist() if capacity > 2 * a - 1 and counts[capacity - a]]
    if counts[capacity]:
        pairs.append((capacity, 0, 0))
    short = have[(have > 0) & (have <= capacity // 3)]
    triples = []
    for a in short.tolist():
        b = have[(have >= a) & (have <= (capacity - a) // 2)]
        c = capacity - a - b
        b, c = b[counts[c] > 0], c[counts[c] > 0]
        triples.append(np.stack([np.full(len(b), a), b, c], axis=1))
    found = np.concatenate([np.array(pairs, dtype=np.int64).reshape(-1, 3), *triples])
    if len(found) > MOST_PATTERNS:
        rare = counts[found].astype(float)
        rare[found == 0] = np.inf
        found = found[np.sort(np.argsort(-rare.min(axis=1), kind="stable")[:MOST_PATTERNS])]
    return found


def fit(patterns: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2, column by column of the patterns, by projected gradients
    with momentum; every column is scaled by how many others share its lengths."""
    size = len(counts)
    used = patterns > 0
    share = np.bincount(patterns[used], minlength=size).astype(float)
    scale = 1 / np.maximum((share[patterns] * used).sum(axis=1), 1)

    def filled(x):
        return np.bincount(patterns[used], weights=np.repeat(x, used.sum(axis=1)), minlength=size)

    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        gap = filled(y) - counts
        gap[0] = 0
        new = np.maximum(y - scale * gap[patterns].sum(axis=1), 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def _best_fit(counts: np.ndarray, capacity: int) -> Counter:
    """Patterns (tuples of lengths) with repeat counts for all of ``counts``: longest first, into the fullest that fit."""
    open_: list[Counter] = [Counter() for _ in range(capacity + 1)]
    done: Counter = Counter()
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        space = length
        while left and space <= capacity:
            if not open_[space]:
                space += 1
                continue
            pattern, number = open_[space].popitem()
            fits = space // length
            full = min(number, left // fits)
            rest = left - full * fits if full < number else 0
            for lengths, times in ((fits, full), (rest if rest < fits else 0, 1)):
                if lengths and times:
                    target = open_[space - lengths * length] if space > lengths * length else done
                    target[pattern + (length,) * lengths] += times
                    number -= times
                    left -= lengths * times
            if number:
                open_[space][pattern] += number
        if left:
            fits = capacity // length
            for lengths, times in ((fits, left // fits), (left % fits, 1)):
                if lengths and times:
                    target = open_[capacity - lengths * length] if capacity > lengths * length else done
                    target[(length,) * lengths] += times
    for group in open_[1:]:
        done.update(group)
    return done


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Counter:
    """Patterns with repeat counts that place exactly ``counts[l]`` pieces of each length l."""
    counts = counts.astype(np.int64)
    left, chosen = counts.copy(), Counter()
    patterns = _patterns(counts, capacity)
    if len(patterns):
        x = np.floor(fit(patterns, counts.astype(float)) + 1e-9).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if not x[i]:
                break
            lengths = Counter(l for l in patterns[i].tolist() if l)
            times = min(int(x[i]), *(int(left[l]) // n for l, n in lengths.items()))
            if times > 0:
                for length, n in lengths.items():
                    left[length] -= n * times
                chosen[tuple(sorted(lengths.elements(), reverse=True))] += times
    chosen.update(_best_fit(left, capacity))
    return chosen


def _slots(chosen: Counter, capacity: int) -> tuple[np.ndarray, ...]:
    """(length, first rank, sequence of that rank, offset) of every pattern slot, sorted by length and rank."""
    rows, next_rank, base = [], [0] * (capacity + 1), 0
    for pattern, times in sorted(chosen.items()):
        offset = 0
        for length in pattern:
            rows.append((length, next_rank[length], base, offset))
            next_rank[length] += times
            offset += length
        base += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, dtype=np.int64) for _ in range(4))


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``found`` has doc_id, piece and a length from 1 to ``capacity``.

    Pieces of a length are numbered in groups of about ROWS_PER_COUNTER, however many there are.
    """
    spark = found.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in found.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    slots = _slots(plan(counts, capacity), capacity)
    groups = [(l, int(-(-counts[l] // ROWS_PER_COUNTER))) for l in range(1, capacity + 1) if counts[l]]
    groups = spark.createDataFrame(groups, "length long, groups int")
    dealt = found.join(F.broadcast(groups), "length")
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups"))).drop("groups")
    sizes = dealt.groupBy("length", "group").count()
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(small(stored(sizes, "sizes")), ["length", "group"])
    ranked = ranked.select(*[c for c in found.columns], (F.col("before") + F.col("rank")).alias("rank"))
    start = slots[0] << 50 | slots[1]

    def assign(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            at = np.searchsorted(start, length << 50 | rank, side="right") - 1
            sequence = pa.array(slots[2][at] + rank - slots[1][at])
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)] + [sequence, pa.array(slots[3][at])]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1] + ["sequence_id", "offset"])

    fields = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(assign, T.StructType(found.schema.fields + fields))


def pack(docs: DataFrame, definition: str, capacity: int = CAPACITY, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there; see ``pieces`` and ``place``.

    Sequences are numbered from 0 and filled without gaps.  Repeated rows are packed as often as they stand.
    Without documents there are no rows.
    """
    return place(stored(pieces(docs, definition, capacity, end, with_ids), "pieces"), capacity)
