"""Small helpers that fix where in a plan an expression is evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.session import cut_lineage

BROADCAST_BYTES = 64 << 20
# Inputs below this size per core do not fill the cores with one task per file split.
SPREAD_BYTES = 8 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; it reads file sizes, not data."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimate is below ``limit``; otherwise the join is left to AQE.

    A streaming frame has no estimate and is returned as it is.
    """
    if df.isStreaming:
        return df
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def measured(df: DataFrame) -> DataFrame:
    """A reduction of a large input, written out so that its true size is known before it is joined.

    The estimate of an aggregate is that of its input, which would rule out a broadcast and shuffle the
    other, larger side.  Inputs that are small anyway, and streams, are returned as they are.
    """
    if df.isStreaming or estimated_bytes(df) <= BROADCAST_BYTES:
        return df
    return cut_lineage(df, "measured")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input to all cores before costly per-row work.

    Inputs that are large enough to have a task per core anyway are not shuffled.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * SPREAD_BYTES else df


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    The optimizer moves a filter below the projection that computes its input and copies the expression
    for every mention, so a parsed document would be parsed again for each member looked at.  Filters are
    not moved below a generator; one that yields a single row keeps the value as it is.
    """
    struct = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(struct)))
