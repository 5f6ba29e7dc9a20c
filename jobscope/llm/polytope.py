"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated (three rounds of random signs and a fast Hadamard transform) and hashed to the nearest vertex
of the cross-polytope, the coordinate of largest magnitude with its sign.  Two rotations make a bucket of a table.
A vector lives in its own bucket of each table and visits the next likely ones (multiprobe); rows that meet are
candidates and are linked only if their exact cosine says so.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import small, stored
from jobscope.llm.components import components, forest
from jobscope.llm.meeting import Meetings, deal

COSINE = 0.98
TABLES = 4
ROTATIONS = 2
PROBES = 4
#: Vectors living in one bucket that a task compares at once.
HOMES_PER_BLOCK = 2048
PAIRS_AT_ONCE = 1 << 16
_ALTERNATIVES = 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, width, step = *x.shape, 1
    while step < width:
        parts = x.reshape(n, -1, 2, step)
        x = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def buckets(x: np.ndarray, tables: int = TABLES, rotations: int = ROTATIONS, probes: int = PROBES) -> np.ndarray:
    """[row, table, probe]: bucket numbers in the order of their likeliness, the row's own bucket first."""
    n, size = x.shape
    width = 1 << max(1, (size - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :size] = x
    rng = np.random.default_rng(width)
    choices = min(_ALTERNATIVES, width)
    combinations = np.array(list(product(range(choices), repeat=rotations)))
    out = np.zeros((n, tables, min(probes, len(combinations))), dtype=np.int64)
    for table in range(tables):
        cost = np.zeros((n, len(combinations)))
        code = np.zeros((n, len(combinations)), dtype=np.int64)
        for r in range(rotations):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size=width))
            best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :choices]
            value = np.take_along_axis(y, best, axis=1)
            vertex = best * 2 + (value < 0)
            loss = np.abs(value[:, :1]) - np.abs(value)
            cost += loss[:, combinations[:, r]]
            code = code * (2 * width) + vertex[:, combinations[:, r]]
        order = np.argsort(cost, axis=1, kind="stable")[:, : out.shape[2]]
        out[:, table] = np.take_along_axis(code, order, axis=1)
    return out


def _unit(batch_column) -> list[np.ndarray]:
    return [np.asarray(v, dtype=np.float64) for v in batch_column.to_pylist()]


def _to_buckets(probes_wanted: bool):
    def run(batches):
        """(key, visit, node, weight, group, vector) per bucket; vectors of one length are hashed together."""
        for batch in batches:
            node, weight, group = (batch.column(i).to_numpy() for i in range(3))
            vectors = batch.column(3)
            lengths = np.array([len(v) for v in vectors])
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                part = vectors.take(pa.array(rows))
                x = np.array(part.to_pylist(), dtype=np.float64)
                found = buckets(x / np.linalg.norm(x, axis=1, keepdims=True), probes=PROBES if probes_wanted else 1)
                n, tables, probes = found.shape
                table = np.arange(tables)[None, :, None]
                # 64 bits of group, length, table and bucket; other buckets with the same key only add candidates.
                key = (group[rows][:, None, None] * 1_000_003 + length) * 1_000_003
                key = ((key + table) * 1_000_003 + found) * np.int64(-7046029254386353131)
                if not probes_wanted:
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel())], names=["key"])
                    continue
                visit = np.broadcast_to((np.arange(probes) > 0).astype(np.int32), found.shape).ravel()
                which = np.repeat(np.arange(n), tables * probes)
                arrays = [pa.array(key.ravel()), pa.array(visit), pa.array(node[rows][which]), pa.array(weight[rows][which])]
                arrays += [pa.array(group[rows][which]), pa.array(np.broadcast_to(table, found.shape).astype(np.int32).ravel()), part.take(pa.array(which))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "visit", "node", "weight", "group", "tab", "vector"])

    return run


def _links(cosine: float):
    def run(batches):
        """Per node the vectors newly linked with it, and a forest of the links.

        A pair that meets in several buckets counts in one only: the first table in which it meets and, there,
        the bucket that the row with the smaller node lives in, or else the other one's.
        """
        meetings = Meetings(PAIRS_AT_ONCE)
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = [batch.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 5, 6)]
            vectors = np.empty(batch.num_rows, dtype=object)
            vectors[:] = _unit(batch.column(7))
            columns, pairs = meetings.take(*numbers, vectors)
            key, _, visit, node, weight, group, table, vector = columns
            number, a, b = {}, [], []
            lengths = np.fromiter(map(len, vector), dtype=np.int64, count=len(vector))
            matrix = np.zeros((len(vector), lengths.max()))
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                matrix[rows, :length] = np.stack(list(vector[rows]))
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
            known: dict[int, np.ndarray] = {}
            for mine, theirs in pairs:
                near = (group[mine] == group[theirs]) & (lengths[mine] == lengths[theirs]) & (node[mine] != node[theirs])
                mine, theirs = mine[near], theirs[near]
                near = np.einsum("ij,ij->i", matrix[mine], matrix[theirs]) >= cosine
                mine, theirs = mine[near], theirs[near]
                if not len(mine):
                    continue
                used = np.unique(np.concatenate([mine, theirs]))
                for length in np.unique(lengths[used]):
                    rows = np.array([r for r in used[lengths[used] == length] if r not in known], dtype=np.int64)
                    if len(rows):
                        known.update(zip(rows.tolist(), buckets(matrix[rows][:, :length])))
                code = np.stack([known[r] for r in used.tolist()])
                x, y = (code[np.searchsorted(used, r)] for r in (mine, theirs))
                lower = node[mine] < node[theirs]
                x, y = (np.where(lower[:, None, None], p, q) for p, q in ((x, y), (y, x)))
                at_x = (y == x[:, :, :1]).any(axis=2)
                at_y = (x == y[:, :, :1]).any(axis=2)
                table_met = np.argmax(at_x | at_y, axis=1)
                everyone = np.arange(len(mine))
                home = np.where(at_x[everyone, table_met], x[everyone, table_met, 0], y[everyone, table_met, 0])
                # Whichever of the two lives here has this key as its home bucket.
                living = np.where(visit[theirs] == 0, theirs, mine)
                here = np.where((living == mine) == lower, x[everyone, table[mine], 0], y[everyone, table[mine], 0])
                both = (visit[mine] == 0) & (visit[theirs] == 0)
                here = np.where(both, home, here)
                # Two that live in a crowded bucket also visit each other's block: the smaller one's counts.
                shared = x[everyone, table_met, 0] == y[everyone, table_met, 0]
                smaller = (living == mine) == lower
                counted = (table[mine] == table_met) & (here == home) & (both | ~shared | smaller)
                mine, theirs = mine[counted], theirs[counted]
                for r, other in ((mine, theirs), (theirs, mine)):
                    nodes, code = np.unique(node[r], return_inverse=True)
                    sums = np.bincount(code, weights=weight[other], minlength=len(nodes))
                    for k, v in zip(nodes.tolist(), sums.tolist()):
                        number[k] = number.get(k, 0) + int(v)
                p, q = forest(node[mine], node[theirs])
                a.append(p)
                b.append(q)
            if number:
                p, q = forest(np.concatenate(a), np.concatenate(b))
                arrays = [pa.array([*number, *p.tolist()], pa.int64()), pa.array([None] * len(number) + q.tolist(), pa.int64())]
                arrays.append(pa.array([*number.values(), *[0] * len(p)], pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "links"])

    return run


def usable(vector: str = "embedding") -> F.Column:
    """Whether a vector can link: not null or zero, and all components finite numbers."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = HOMES_PER_BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept.

    Vectors of one label and length link at a cosine of at least ``cosine`` (in double precision); equal vectors
    always do.  They are compared once, with the number of rows they stand for, so copies make no pairs.  Vectors
    that are null, zero or not finite, or whose label is null, link with nothing.  Repeated rows count as vectors
    of their own.  A null vec_id names no component unless there is no other id in it, and is kept only then.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")
    whole = usable("vector") & F.col("label").isNotNull()
    classes = rows.where(whole).groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    plain = classes.select("node", "weight", F.xxhash64("label").alias("group"), "vector")
    fields = "key long, visit int, node long, weight long, group long, tab int, vector array<double>"
    dealt = deal(plain.mapInArrow(_to_buckets(True), fields), plain.mapInArrow(_to_buckets(False), "key long"), block, "node")
    found = stored(dealt.mapInArrow(_links(cosine), "a long, b long, links long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null"), "polytope")
    named = classes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    named = stored(named.withColumn("linked", F.lit(True)), "named")
    joined = rows.withColumn("__usable", whole).join(small(named.withColumn("__usable", F.lit(True))), ["__usable", "label", "vector"], "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
