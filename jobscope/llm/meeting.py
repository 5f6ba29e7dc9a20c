"""Rows that meet at keys: some live there (visit 0), others come by (visit 1); crowded keys are split in blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import small, stored


def deal(copies: DataFrame, living: DataFrame, block: int, name: str) -> DataFrame:
    """``copies`` (key, visit, ``name``, ...) sorted by key, block and visit within partitions, with column ``block``.

    ``living`` has a row with ``key`` for each row that lives somewhere.  Where more than ``block`` rows live at a
    key, each belongs to one block and visits the others, and visitors come to every block.
    """
    crowded = living.groupBy("key").count().where(F.col("count") > block)
    crowded = stored(crowded.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "crowded")
    if crowded.isEmpty():
        dealt = copies.withColumn("block", F.lit(0))
    else:
        dealt = copies.join(small(crowded), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        own = F.pmod(F.xxhash64(name), F.col("blocks")) == F.col("block")
        dealt = dealt.withColumn("visit", F.when((F.col("visit") == 0) & own, 0).otherwise(1)).drop("blocks")
    dealt = dealt.select("key", "block", "visit", *[c for c in copies.columns if c not in ("key", "visit")])
    return dealt.repartition("key", "block").sortWithinPartitions("key", "block", "visit")


class Meetings:
    """Goes through dealt batches and gives, per batch, rows and the pairs of rows that meet.

    The living rows of a batch's last key are carried to the next batch.
    """

    def __init__(self, pairs_at_once: int):
        self.pairs_at_once = pairs_at_once
        self.carried: list[np.ndarray] | None = None

    def take(self, key: np.ndarray, block: np.ndarray, visit: np.ndarray, *rest: np.ndarray):
        """The batch's columns with carried rows in front, and an iterator of (mine, theirs) row numbers."""
        columns = [key, block, visit, *rest]
        old = 0
        if self.carried is not None:
            old = len(self.carried[0])
            columns = [np.concatenate(c) for c in zip(self.carried, columns)]
        key, block, visit = columns[:3]
        changes = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(np.concatenate([[True], changes]))
        group = np.concatenate([[0], np.cumsum(changes)])
        at = np.arange(len(key))
        homes = np.add.reduceat((visit == 0).astype(np.int64), first)
        start = first[group]
        # Carried rows have met each other before.
        partners = np.where(at < old, 0, np.minimum(homes[group], at - start))
        last = slice(first[-1], first[-1] + homes[-1])
        self.carried = [c[last] for c in columns]
        return columns, self._pairs(start, partners)

    def _pairs(self, start, partners):
        total = np.concatenate([[0], np.cumsum(partners)])
        row = 0
        while row < len(partners):
            stop = max(row + 1, int(np.searchsorted(total, total[row] + self.pairs_at_once, side="right")) - 1)
            n = partners[row:stop]
            if n.any():
                mine = np.repeat(np.arange(row, stop), n)
                yield mine, start[mine] + np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
            row = stop
