"""Exact top-k search by inner product over an impact-ordered index.

The index has, per shard, posting segments by impact, the size of a component's integer value: the strongest tenth of
all components comes first, then weaker ones, each segment with its postings by dimension.  A block of queries takes
the segments in that order and adds up scores.  What the segments to come can still add to a row is at most the
length of the row's part in them times the length of the query.  After each segment the rows that lead are scored in
full, so the k-th best of them is a lower bound; a row that cannot reach it with all that may come is out, by proof.
When few rows are left they are scored exactly; otherwise the next segment follows, down to the last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import stored

K = 5
SCALE = 256
SHARD_ROWS = 8192
QUERY_ROWS = 4096
#: Queries whose sums a task holds at once.
QUERIES_AT_ONCE = 64
#: Shares of a shard's components that are at least as strong as the last of each segment.
SEGMENTS = (0.1, 0.25, 0.45, 0.65, 0.85, 1.0)
#: Share of a block's sums that may still be among the best when they are left for exact scoring.
FEW = 1 / 16

_INDEX = pa.schema([("shard", pa.int64()), ("segment", pa.int32()), ("dimension", pa.int32()), ("rows", pa.list_(pa.int32())), ("values", pa.list_(pa.int64()))])
_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
#: Rows of the index that are no postings list what each row stands for.
_IDS, _NUMBERS = -1, -2


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): components as floor(scale * x), one row per row.

    Vectors take no part if they are null or hold null or non-finite components, or if they have no id.  Integers
    outside the range of long are held at its ends.
    """
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("vector"))


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _segments(table: pa.Table) -> pa.Table:
    """Posting lists of one shard by segment and dimension; components that are zero have no posting."""
    table = table.sort_by("number")
    vectors = table.column("vector").to_pylist()
    values = _matrix(vectors, max(map(len, vectors), default=0))
    # The smallest long has no positive counterpart; its strength is next to it.
    strength = np.abs(np.maximum(values, -(2**63) + 1))
    some = np.sort(strength[strength > 0])[::-1]
    last = np.array([some[min(len(some), max(1, int(len(some) * share))) - 1] for share in SEGMENTS]) if len(some) else np.zeros(0)
    shard = table.column("shard")[0].as_py()
    rows = [
        {"shard": shard, "segment": -1, "dimension": kind, "rows": [], "values": table.column(name).to_pylist()}
        for kind, name in ((_IDS, "vec_id"), (_NUMBERS, "number"))
    ]
    for d in range(values.shape[1]):
        segment = np.where(strength[:, d] > 0, len(last) - np.searchsorted(last[::-1], strength[:, d], side="right"), -1)
        for k in np.unique(segment[segment >= 0]).tolist():
            at = np.flatnonzero(segment == k)
            rows.append({"shard": shard, "segment": k, "dimension": d, "rows": at.astype(np.int32), "values": values[at, d]})
    return pa.Table.from_pylist(rows, schema=_INDEX)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The index of (number, vec_id, vector) and its number of shards; every row is in exactly one shard."""
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.select(F.pmod(F.xxhash64("number"), F.lit(shards)).alias("shard"), "number", "vec_id", "vector")
    fields = "shard long, segment int, dimension int, rows array<int>, values array<long>"
    return stored(dealt.groupBy("shard").applyInArrow(_segments, fields), "index"), shards


class _Shard:
    """One shard of the index, ready for queries of at most ``strongest`` in any component."""

    def __init__(self, index: pa.Table, strongest: int):
        lists = []
        for row in index.to_batches():
            names = ("segment", "dimension", "rows", "values")
            segment, dimension, rows, values = (row.column(n) for n in names)
            for i in range(row.num_rows):
                lists.append((segment[i].as_py(), dimension[i].as_py(), rows[i].values.to_numpy(), values[i].values.to_numpy()))
        kinds = {d: v for k, d, _, v in lists if k < 0}
        self.ids, self.numbers = kinds[_IDS], kinds[_NUMBERS]
        postings = [x for x in lists if x[0] >= 0]
        self.width = max((d for _, d, _, _ in postings), default=-1) + 1
        most = max([1, *(abs(int(x)) for _, _, _, v in postings for x in (v.min(), v.max()))])
        # Sums that doubles do not hold exactly are done in Python's integers, and then in full.
        self.kind = np.float64 if 4 * most * strongest * max(1, self.width) < 2**53 else object
        self.matrix = np.zeros((len(self.ids), self.width), dtype=self.kind)
        self.segments: list[list] = [[] for _ in range(max((k for k, *_ in postings), default=-1) + 1)]
        for k, d, rows, values in postings:
            values = values.astype(self.kind)
            self.segments[k].append((d, rows, values))
            self.matrix[rows, d] = values
        #: Length of what each row has in the segments that follow.
        self.left = []
        if self.kind is not object:
            square = (self.matrix**2).sum(axis=1)
            for lists in self.segments:
                for _, rows, values in lists:
                    square[rows] -= values**2
                self.left.append(np.sqrt(np.maximum(square, 0)))

    def search(self, numbers: np.ndarray, queries: np.ndarray, k: int):
        """Per query the rows and scores that hold its ``k`` best; a query's own row, by number, is left out."""
        at = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        own = np.flatnonzero(self.numbers[at] == numbers)
        queries = queries[:, : self.width].astype(self.kind)
        total = np.zeros((len(self.ids), len(queries)), dtype=self.kind)
        length = np.sqrt((queries**2).sum(axis=1)) if self.kind is not object else None
        open_ = np.ones(total.shape, dtype=bool)
        open_[at[own], own] = False
        bound = np.full(len(queries), -np.inf)
        for n, lists in enumerate(self.segments):
            for d, rows, values in lists:
                total[rows] += values[:, None] * queries[:, d]
            if self.kind is object or not n or n == len(self.segments) - 1 or len(self.ids) <= k + 1:
                continue
            lead = np.argpartition(total, -(k + 1), axis=0)[-(k + 1) :]
            score = np.einsum("kqd,qd->kq", self.matrix[lead], queries)
            score[self.numbers[lead] == numbers] = -np.inf
            bound = np.maximum(bound, np.sort(score, axis=0)[-k])
            # The bound on what follows is rounded up.
            open_ &= total + (self.left[n][:, None] * length * (1 + 1e-9) + 1) >= bound
            if open_.sum() <= FEW * open_.size:
                break
        for j in range(len(queries)):
            rows = np.flatnonzero(open_[:, j])
            yield rows, self.matrix[rows] @ queries[j] if self.width else np.zeros(len(rows))


def _search(k: int):
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        vectors = queries.column("vector").to_pylist()
        strongest = max([1, *(abs(x) for v in vectors for x in v)])
        shard = _Shard(index, strongest)
        numbers, query_ids = (queries.column(c).to_numpy() for c in ("number", "query_id"))
        matrix = _matrix(vectors, max([shard.width, *map(len, vectors)]))
        found = []
        for at in range(0, len(matrix), QUERIES_AT_ONCE):
            part = slice(at, at + QUERIES_AT_ONCE)
            for number, query_id, (rows, scores) in zip(numbers[part], query_ids[part], shard.search(numbers[part], matrix[part], k)):
                held = [max(-(2**63), min(2**63 - 1, int(s))) for s in scores.tolist()]
                if shard.kind is not object and len(rows) > k:
                    best = np.argpartition(scores, -k)[-k:]
                    tied = np.flatnonzero(scores >= scores[best].min())
                    rows, held = rows[tied], [held[i] for i in tied.tolist()]
                best = sorted(zip(held, shard.ids[rows].tolist()), key=lambda x: (-x[0], x[1]))[:k]
                found += [(number, query_id, i, s) for s, i in best]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=_FOUND) if found else _FOUND.empty_table()

    return search


def search(index: DataFrame, shards: int, queries: DataFrame, k: int = K, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows by inner product for each (number, query_id, vector).

    The row with the query's own number is left out; missing components count as zero; ties go to the smaller id; a
    query with fewer candidates gets them all.  Scores beyond the range of long are held at its ends, and then tie.
    Blocks of queries meet every shard.
    """
    blocks = max(1, -(-queries.count() // query_rows))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    keys = ["shard", "block"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    found = pairs.applyInArrow(_search(k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def numbered(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Quantised vectors with a number per row, by which a query knows its own; rows that share an id stay apart."""
    return stored(quantised(vectors, scale).withColumn("number", F.monotonically_increasing_id()), "quantised")


def top_k(vectors: DataFrame, is_query: F.Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """Search all quantised ``vectors`` for those of them that satisfy ``is_query``, a condition on vec_id.

    Rows that share a vec_id are rows of their own: each is a candidate for the other, and each that is a query has
    its own results.
    """
    rows = numbered(vectors, scale)
    index, shards = build_index(rows)
    return search(index, shards, rows.where(is_query).withColumnRenamed("vec_id", "query_id"), k)
