"""Removal of long repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only as far as the length looked for, most significant digits first, and a suffix whose
digits so far are unique leaves the sort.  Suffixes that are still equal at full depth are exactly the repeated
windows.  The passes:

1. The first digit of a window is its smallest block (by hash, the first one on ties) and stands for all windows
   that have it as their smallest: they start in one run before the block.  Equal windows have the same smallest
   block at the same place, so a block that occurs once rules out its whole run.
2. The second digit is all that the run's windows cover.  Where it is repeated, so is every window of the run.
3. Runs that are left are cut into shorter ones at fixed distances from the block, down to single windows, and
   sorted the same way: by what all windows of the shorter run share, then by all that they cover.  One run of
   each kind stays to be compared with.

Digits travel as hashes: the first keeps windows in the sort, and both together, 128 bits, decide equality.

The units of a window are bytes, or words: then each word stands as a hash of eight bytes, and passages of so many
words are found whatever white space lies between them and however short the words are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import discard, map_text, small, stored

WINDOW = 400
#: Words of the shortest passage that goes wherever it repeats, in whatever number of bytes: over 50.
PASSAGE_WORDS = 51
#: Bytes hashed at once; longer texts are cut into overlapping pieces. Places must fit in 20 bits.
CHUNK = 1 << 18
#: Lengths of runs in the passes after the first.
RUN_LENGTHS = (25, 5, 1)
_PLACE = np.uint64((1 << 20) - 1)
_STEP = 0x9E3779B97F4A7C15
#: Bytes that stand for one unit of a text.
_SIZES = {"bytes": 1, "words": 8}
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 9) for b in range(256)], dtype=np.uint64)


def _in_units(text: bytes | None, unit: str) -> bytes | None:
    """The text itself, or the hashes of its words one after the other."""
    return b"".join([xxhash.xxh64_digest(w) for w in text.split()]) if text and unit == "words" else text


def _block_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` units from each place on, by doubling."""
    level, length, hashes, at = _BYTES[data] if data.dtype == np.uint8 else data, 1, None, 0
    while True:
        if width & length:
            n = len(data) - width + 1
            # Lower digits stand further right: their place is what the higher digits of the width take up.
            start = width - at - length
            part = level[start : start + n]
            power = np.uint64(pow(_STEP, at, 1 << 64))
            hashes = part.copy() if hashes is None else hashes + part * power
            at += length
        if length * 2 > width:
            break
        level = level[:-length] * np.uint64(pow(_STEP, length, 1 << 64)) + level[length:]
        length *= 2
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    return hashes


def _smallest(hashes: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest hash among the ``span`` places from each on; the first on ties."""
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    total, length = len(hashes) - span + 1, 1
    while length * 2 <= span:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    least = np.minimum(least[:total], least[span - length : span - length + total])
    return (least & _PLACE).astype(np.int64)


def _pieces(texts: list[bytes | None], window: int, size: int):
    """Lists of (text's number, offset in the text, piece), each within ``CHUNK`` units of ``size`` bytes or so."""
    held, total = [], 0
    for i, text in enumerate(texts):
        if not text or len(text) < window * size:
            continue
        for at in range(0, len(text) // size - window + 1, CHUNK):
            piece = text[at * size : (at + CHUNK + window - 1) * size]
            if held and total + len(piece) // size > CHUNK:
                yield held
                held, total = [], 0
            held.append((i, at, piece))
            total += len(piece) // size
    if held:
        yield held


def runs(texts: list[bytes | None], window: int = WINDOW, unit: str = "bytes"):
    """Arrays (text, block hash, run hash, place of the block, first and last start): windows with one smallest block."""
    width, size = window // 2, _SIZES[unit]
    found = []
    for held in _pieces([_in_units(t, unit) for t in texts], window, size):
        buffer = b"".join(p for _, _, p in held)
        lengths = np.array([len(p) // size for _, _, p in held])
        begin = np.cumsum(lengths) - lengths
        hashes = _block_hashes(np.frombuffer(buffer, dtype=np.uint8 if size == 1 else np.uint64), width)
        place = _smallest(hashes, window - width + 1)
        number = lengths - window + 1
        piece = np.repeat(np.arange(len(held)), number)
        start = np.arange(len(piece)) - np.repeat(np.cumsum(number) - number, number) + begin[piece]
        chosen = place[start]
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.append(first[1:], len(chosen)) - 1
        low, high = start[first], start[last]
        digest = xxhash.xxh3_64_intdigest
        edges = zip((low * size).tolist(), ((high + window) * size).tolist())
        whole = np.array([digest(buffer[a:b]) for a, b in edges], dtype=np.uint64)
        text = np.array([i for i, _, _ in held])[piece[first]]
        shift = np.array([at for _, at, _ in held])[piece[first]] - begin[piece[first]]
        found.append((text, hashes[chosen[first]].view(np.int64), whole.view(np.int64), chosen[first] + shift, low + shift, high + shift))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*found))


def _key(body: F.Column) -> list[F.Column]:
    """Two longs, 128 bits of hash, that only rows with the same doc_id (or none) and text share."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(seed), name, body) for seed in (1, 2)]


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts as bytes under a key that only equal texts of one doc_id share."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    doc, crc = _key(body)
    return docs.select(doc.alias("doc"), crc.alias("crc"), body.alias("body"))


_ROW = "doc long, crc long, block long, whole long, place long, low long, high long"
_NAMES = ["doc", "crc", "block", "whole", "place", "low", "high"]


def _run_rows(window: int, unit: str):
    def rows(batches):
        for batch in batches:
            text, *digits = runs(batch.column(2).to_pylist(), window, unit)
            if len(text):
                arrays = [batch.column(i).to_numpy()[text] for i in (0, 1)] + digits
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], names=_NAMES)

    return rows


def _shorter_rows(window: int, length: int, unit: str):
    """The runs asked for, cut into runs of ``length`` at fixed distances from their block."""
    size = _SIZES[unit]

    def rows(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for doc, crc, body, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                body = _in_units(body, unit)
                for run in wanted:
                    place, low, high, alone = run["place"], run["low"], run["high"], run["alone"]
                    for cell in range((low - place) // length, (high - place) // length + 1):
                        first = place + cell * length
                        last = first + length - 1
                        a, b = max(first, low), min(last, high)
                        block = digest(body[last * size : (first + window) * size], cell + (1 << 32))
                        out.append((doc, crc, block, digest(body[a * size : (b + window) * size], 1), place, a, b, alone))
                if len(out) > 50000:
                    yield _row_batch(out)
                    out = []
            if out:
                yield _row_batch(out)

    return rows


def _row_batch(rows):
    *numbers, alone = zip(*rows)
    arrays = [pa.array(np.array(c, dtype=np.uint64).view(np.int64) if i in (2, 3) else np.array(c, dtype=np.int64)) for i, c in enumerate(numbers)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(alone, pa.bool_())], names=_NAMES + ["alone"])


def _sort_pass(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Spans of runs that are repeated as a whole, and what must be looked at in shorter runs.

    ``alone`` marks runs not known to be repeated; the others are there to be compared with.
    """
    again = rows.groupBy("block").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).where("n > 1 and alone")
    again = stored(again.select("block"), "blocks")
    left = stored(rows.join(small(again), "block", "left_semi"), "candidates")
    discard(rows)
    one = F.struct("doc", "crc", "place", "low", "high")
    kinds = left.groupBy("block", "whole").agg(F.count("*").alias("n"), F.max("alone").alias("alone"), F.min(one).alias("one"))
    kinds = stored(kinds, "kinds")
    many = kinds.where("n > 1 and alone").select("block", "whole")
    sure = left.where("alone").join(many, ["block", "whole"], "left_semi")
    sure = stored(sure.select("doc", "crc", "low", (F.col("high") + window).alias("high")), "sure")
    single = F.col("alone") & (F.col("n") == 1)
    mixed = kinds.groupBy("block").agg(F.count("*").alias("kinds"), F.max(single).alias("open")).where("kinds > 1 and open")
    rest = kinds.join(mixed.select("block"), "block", "left_semi").select("one.*", single.alias("alone"))
    rest = rest.groupBy("doc", "crc").agg(F.collect_list(F.struct("place", "low", "high", "alone")).alias("wanted"))
    rest = stored(rest, "wanted")
    for table in (again, left, kinds):
        discard(table)
    return sure, rest


def _merge(batches):
    """Spans sorted by text and start: one row per text with its maximal runs."""
    held = None

    def closed(held):
        doc, crc, spans = held
        return pa.RecordBatch.from_pylist([{"doc": doc, "crc": crc, "spans": [x for s in spans for x in s]}], schema=_SPANS)

    for batch in batches:
        out = []
        for doc, crc, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held[:2] != (doc, crc):
                if held:
                    out.append(closed(held))
                held = (doc, crc, [[low, high]])
            elif low <= held[2][-1][1]:
                held[2][-1][1] = max(held[2][-1][1], high)
            else:
                held[2].append([low, high])
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if held:
        yield closed(held)


_SPANS = pa.schema([("doc", pa.int64()), ("crc", pa.int64()), ("spans", pa.list_(pa.int64()))])


def repeated_spans(docs: DataFrame, window: int = WINDOW, unit: str = "bytes") -> DataFrame:
    """(doc, crc, spans): for each text with repeats, the bytes or words that windows which start elsewhere too cover.

    ``spans`` lists starts and ends of maximal runs in turn.  ``doc`` and ``crc`` are the key of the text; rows that agree
    in doc_id and text share a row here, and their windows count as repeated.
    """
    keyed = _keyed(docs)
    long = keyed.where(F.octet_length("body") >= window)
    rows = stored(long.mapInArrow(_run_rows(window, unit), _ROW).withColumn("alone", F.lit(True)), "runs")
    spans, wanted = _sort_pass(rows, window)
    for length in [n for n in RUN_LENGTHS if 2 * n <= window - window // 2 + 1]:
        asked = long.join(small(wanted), ["doc", "crc"]).select("doc", "crc", "body", "wanted")
        rows = stored(asked.mapInArrow(_shorter_rows(window, length, unit), _ROW + ", alone boolean"), "runs")
        discard(wanted)
        more, wanted = _sort_pass(rows, window)
        spans = spans.union(more)
    spans = spans.repartition("doc", "crc").sortWithinPartitions("doc", "crc", "low")
    return spans.mapInArrow(_merge, "doc long, crc long, spans array<long>")


def _in_bytes(text: bytes, spans: list[int], words: list[int]) -> list[int]:
    """Spans of bytes together with spans of words, from the first word's start to the last one's end."""
    if not words:
        return spans
    places = [m.span() for m in _WORD.finditer(text)]
    both = list(zip(spans[::2], spans[1::2])) + [(places[a][0], places[b - 1][1]) for a, b in zip(words[::2], words[1::2])]
    out = []
    for low, high in sorted(both):
        if out and low <= out[-1]:
            out[-1] = max(out[-1], high)
        else:
            out += [low, high]
    return out


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    keep: list[str] | None = None,
    kept: str = "bytes",
    prefix: str = "",
    passage: int = 0,
    apart: str = "",
) -> DataFrame:
    """The columns ``keep`` (all by default) with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept``.

    Every byte covered by a ``window``-byte string that also starts anywhere else goes, in the same text or
    another; texts are judged as they came in, and matches never cross texts.  Null counts as empty; texts
    shorter than the window keep everything; equal texts of at least the window lose everything.  ``kept`` has
    the remaining bytes; with ``kept="text"`` it is a string without characters that were cut in half, and with
    ``kept=""`` it is left out.  New names start with ``prefix``; input columns with the same names are dropped.
    With ``passage``, words (``[^\\x20\\x09-\\x0D]+``) in a sequence of so many that stands anywhere else too go as well, in
    whatever number of bytes, and the white space between them; that before and after stays.  With ``apart``, the columns
    above are of strings alone, and a further one of that name has what is left without passages too, as ``kept`` has it.
    """
    spans = repeated_spans(docs, window).withColumn("words", F.lit(None).cast("array<long>"))
    if passage:
        words = repeated_spans(docs, passage, "words")
        spans = spans.union(words.select("doc", "crc", F.lit(None).cast("array<long>"), F.col("spans")))
        spans = spans.groupBy("doc", "crc").agg(F.max("spans").alias("spans"), F.max("words").alias("words"))
    spans = stored(spans, "spans").select(*[F.col(c).alias(f"__{c}") for c in ("doc", "crc", "spans", "words")])
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    doc, crc = _key(body)
    same = (doc == F.col("__doc")) & (crc == F.col("__crc"))
    joined = docs.join(small(spans), same, "left")
    fields = [T.StructField(prefix + n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    fields += [T.StructField(prefix + "kept_sha256", T.StringType())]
    remains = [prefix + "kept"] * bool(kept) + [prefix + apart] * bool(kept and apart)
    fields += [T.StructField(n, T.StringType() if kept == "text" else T.BinaryType()) for n in remains]

    def start():
        def left(text, span):
            edges = [0, *span, len(text)]
            return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))

        def compute(texts, spans, words):
            rows = []
            for text, span, passages in zip(texts, spans, words):
                text, span = text or b"", span or []
                both = _in_bytes(text, span, passages or [])
                span = span if apart else both
                rest = left(text, span)
                out = [rest, left(text, both) if apart else rest]
                if kept == "text":
                    out = [o.decode("utf-8", "ignore") for o in out]
                rows.append((len(text), len(text) - len(rest), len(span) // 2, hashlib.sha256(rest).hexdigest(), *out))
            return list(zip(*rows))

        return compute

    keep = docs.columns if keep is None else keep
    return map_text(joined, fields, start, keep=keep, extra=[F.col("__spans"), F.col("__words")])
