"""SimHash near-duplicates with anchor points from a covering code.

A 64-bit fingerprint is cut into two halves.  Fingerprints that differ in three bits or fewer differ in at most
one bit in one of the halves.  The anchors of a half are the codewords of the perfect Hamming code of length 31
(the half's last bit is not looked at): every half has exactly one anchor within the covering radius 1, its home.
A fingerprint is copied to its home and to every anchor within radius plus threshold, 1 + 1 = 2 (fifteen more).
If two halves differ in at most one bit, the second is within 2 of the first one's home, so both meet there, and
comparing homes with visitors per anchor finds every link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import col, map_text, small, stored
from jobscope.llm.components import components, forest
from jobscope.llm.meeting import Meetings, deal

SEED = 42
THRESHOLD = 3
#: Homes of one anchor that a task compares at once; more are dealt to several tasks.
HOMES_PER_BLOCK = 4096
#: Pairs held at once while an anchor is compared.
PAIRS_AT_ONCE = 1 << 21

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _shingle_hashes(text: bytes | None, width: int):
    """Arrays with the hashes of a text's shingles in order; a text of fewer words is one shingle."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    step, digest = 1 << 16, xxhash.xxh64_intdigest
    for at in range(0, len(starts), step):
        spans = zip(starts[at : at + step].tolist(), ends[at : at + step].tolist())
        yield np.array([digest(joined[s:e], SEED) for s, e in spans], dtype="<u8")


def fingerprint(text: bytes | None, width: int, halves: int = 1) -> tuple[int, ...]:
    """64 bits (or ``halves`` times as many) of one text: set in over half of its shingles' hashes; zero without words."""
    total, number = np.zeros(64 * halves, dtype=np.int64), 0
    for hashes in _shingle_hashes(text, width):
        number += len(hashes)
        for half in range(halves):
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[64 * half : 64 * half + 64] += bits.sum(axis=0, dtype=np.int32)
            # The next half looks at the hashes mixed once more.
            hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            hashes ^= hashes >> np.uint64(29)
    return tuple(np.packbits(total * 2 > number, bitorder="little").view("<u8").tolist())


def fingerprints(docs: DataFrame, width: int = 3, keep: list[str] | None = None, names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """The columns ``keep`` (all by default) and a signed long for each 64 bits of the text's fingerprint.

    Words are runs without white space, A-Z lower-cased; null and empty texts have fingerprint zero.
    """
    number = len(names)

    def start():
        def compute(texts):
            found = np.array([fingerprint(t, width, number) for t in texts], dtype=np.uint64).reshape(-1, number)
            return list(found.view(np.int64).T)

        return compute

    return map_text(docs, [T.StructField(n, T.LongType()) for n in names], start, keep=keep)


def _syndrome(x: np.ndarray, length: int) -> np.ndarray:
    s = np.zeros(x.shape, dtype=np.int64)
    for j in range(length.bit_length()):
        mask = sum(1 << i for i in range(length) if (i + 1) >> j & 1)
        s |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << j
    return s


def anchors(x: np.ndarray, length: int = 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchors of words of ``length`` bits (2^r - 1), and (row, anchor) of the others within distance 2."""
    flip = np.concatenate([[0], 1 << np.arange(length, dtype=np.int64)])
    s = _syndrome(x, length)
    home = x ^ flip[s]
    a = np.arange(1, length + 1)
    rows, more = [], []
    for value in range(1, length + 1):
        at = np.flatnonzero(s == value)
        pairs = a[a < (a ^ value)]
        pairs = pairs[(pairs ^ value) > 0]
        flips = flip[pairs] ^ flip[pairs ^ value]
        rows.append(np.repeat(at, len(flips)))
        more.append((x[at][:, None] ^ flips[None, :]).ravel())
    return home, np.concatenate(rows), np.concatenate(more)


def _to_anchors(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for half in (0, 1):
            x = (fp >> (32 * half)) & 0x7FFFFFFF
            home, rows, more = anchors(x)
            key = np.concatenate([home, more]) | (half << 31)
            copies = np.concatenate([fp, fp[rows]])
            visit = np.zeros(len(key), dtype=np.int32)
            visit[len(home) :] = 1
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(visit), pa.array(copies)], names=["key", "visit", "fp"])


def _home_keys(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy()
        keys = [anchors((fp >> (32 * half)) & 0x7FFFFFFF)[0] | (half << 31) for half in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=["key"])


def _linker(threshold: int):
    def link(batches):
        """Of the links of a batch, a forest with the same components."""
        meetings = Meetings(PAIRS_AT_ONCE)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, pairs = meetings.take(*[batch.column(i).to_numpy() for i in range(4)])
            fp = columns[3]
            left, right = [], []
            for mine, theirs in pairs:
                near = np.bitwise_count((fp[mine] ^ fp[theirs]).view(np.uint64)) <= threshold
                a, b = forest(fp[mine[near]], fp[theirs[near]])
                left.append(a)
                right.append(b)
            if left:
                a, b = forest(np.concatenate(left), np.concatenate(right))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return link


def links(fps: DataFrame, threshold: int = THRESHOLD, block: int = HOMES_PER_BLOCK) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs within ``threshold`` (at most 3) bits do.

    ``fps`` has distinct fingerprints in column ``fp``.  Of the pairs found in a batch only a forest is passed on.
    An anchor that is the home of more than ``block`` fingerprints is compared in blocks by several tasks.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("two halves cover at most 3 differing bits")
    dealt = deal(fps.mapInArrow(_to_anchors, "key long, visit int, fp long"), fps.mapInArrow(_home_keys, "key long"), block, "fp")
    return dealt.mapInArrow(_linker(threshold), "a long, b long")


def _classes(docs: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) per row, and (fp, least doc_id, root) per fingerprint, where root names its component."""
    rows = stored(fingerprints(docs, width, keep=["doc_id"]), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), threshold), "simhash").withColumnRenamed("node", "fp")
    return rows, classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``, the smallest doc_id reachable by links.

    Fingerprints link when they differ in at most ``threshold`` bits; equal fingerprints always belong together.
    Null and empty texts have fingerprint zero and link like any other.  A repeated row is repeated in the
    result; a null doc_id takes its component's id and never names a component unless it has no other id.
    Other columns are ignored.
    """
    rows, member = _classes(docs, width, threshold)
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _winners(member: DataFrame) -> DataFrame:
    """(__id, __fp): of each component the row that stays, the smallest id first, a null id only where there is no other."""
    best = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("fp").alias("fp"))).alias("b")
    return member.groupBy("root").agg(best).select(F.col("b.id").alias("__id"), F.col("b.fp").alias("__fp"))


def keep_one(docs: DataFrame, width: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """Of each component of ``near_duplicates`` the row with the smallest doc_id; all columns stay.

    Every row is a document: of rows that share a doc_id each belongs to the component of its own text, and of
    equal ones in a component one stays.  A row without a doc_id stays only where nothing in its component has one.
    Null and empty texts are one component.
    """
    rows, member = _classes(docs, width, threshold)
    chosen = stored(_winners(member), "kept")
    repeated = rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("__id"))
    repeated = stored(repeated, "repeated")
    sure = chosen.where("__id is not null").join(small(repeated), "__id", "left_anti").select("__id")
    kept = docs.join(sure, docs["doc_id"] == F.col("__id"), "left_semi")
    # Ids that stand for several rows do not tell which of them stays: their texts are looked at again.
    open_ids = docs.join(small(repeated), docs["doc_id"] == F.col("__id"), "left_semi")
    unclear = fingerprints(open_ids.union(docs.where("doc_id is null")), width, names=("__fp",))
    same = unclear["doc_id"].eqNullSafe(chosen["__id"]) & (unclear["__fp"] == chosen["__fp"])
    unclear = unclear.join(small(chosen), same, "left_semi").dropDuplicates(["doc_id", "__fp"])
    return kept.union(unclear.select(*map(col, docs.columns)))
