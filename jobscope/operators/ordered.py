"""Ordered per-key computations that stay parallel when one key holds a large part of the rows.

A window over a key sends all rows of that key to one task.  The helpers here look for keys with more rows than
a task should hold (an aggregate over the keys, skipped for small inputs) and cut those keys at quantiles of
their own times.  Their rows are windowed per (key, slice); what crosses a slice border - the neighbouring row,
the rows counted so far, the last value seen - is taken from one summary row per slice.  All other keys, and
every input without heavy keys, use the plain window.  Null keys are keys like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.operators.shape import broadcast_if_small, estimated_bytes
from jobscope.session import cut_lineage

SMALL_INPUT_BYTES = 1 << 30
#: A key with more rows is cut in slices of about this many.
ROWS_PER_SLICE = 1_000_000
#: Slices that one key is cut in at most; beyond it slices grow.
MOST_SLICES = 10_000
_NONE = np.iinfo(np.int64).min


def _micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _same(keys: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for i, key in enumerate(keys):
        condition &= F.col(key).eqNullSafe(F.col(f"{prefix}{i}"))
    return condition


def _renamed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({key: f"{prefix}{i}" for i, key in enumerate(keys)})


def heavy_slices(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    rows_per_slice: int = ROWS_PER_SLICE,
    small_bytes: int = SMALL_INPUT_BYTES,
) -> DataFrame | None:
    """(keys, _cuts) of keys with more than ``rows_per_slice`` rows: the times that cut them into slices.

    None where no key is heavy.  Rows are counted by a partial aggregate; only heavy keys' times are looked at
    again.  There are at most rows / ``rows_per_slice`` heavy keys; the table is written out and broadcast only
    if it is small.
    """
    if estimated_bytes(df) < small_bytes:
        return None
    heavy = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > rows_per_slice), "heavy")
    most = heavy.agg(F.max("_rows")).first()[0]
    if most is None:
        return None
    slices = min(MOST_SLICES, max(2, -(-most // rows_per_slice)))
    times = df.select(*keys, _micros(ts).alias("_us"))
    times = times.join(broadcast_if_small(_renamed(heavy, keys, "_h")), _same(keys, "_h"))
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = times.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_us", shares, 10 * slices)).alias("_cuts"))
    return cut_lineage(cuts, "slices")


def _sliced(df: DataFrame, keys: Sequence[str], ts: str, heavy: DataFrame) -> DataFrame:
    """Add ``_slice``: the number of a heavy key's cuts at or before the row; null for other keys."""
    joined = df.join(broadcast_if_small(_renamed(heavy, keys, "_h")), _same(keys, "_h"), "left")
    before = F.size(F.filter("_cuts", lambda c: c <= F.coalesce(_micros(ts), F.lit(_NONE))))
    return joined.withColumn("_slice", F.when(F.col("_cuts").isNotNull(), before)).select(*df.columns, "_slice")


def _across(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the summary of their key's slice."""
    slices = _renamed(summary, [*keys, "_slice"], "_s")
    joined = rows.join(slices, _same([*keys, "_slice"], "_s"), "left")
    return joined.drop(*[f"_s{i}" for i in range(len(keys) + 1)])


def _heavy(df: DataFrame, keys: Sequence[str], ts: str, heavy: DataFrame | Sequence | None) -> DataFrame | None:
    """What a caller passes as ``heavy``: None to look for heavy keys, [] for none, or their slices."""
    if heavy is None:
        return heavy_slices(df, keys, ts)
    return heavy if isinstance(heavy, DataFrame) else None


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    next_of: dict[str, str] | None = None,
    previous_of: dict[str, str] | None = None,
    heavy: DataFrame | Sequence | None = None,
) -> DataFrame:
    """Add columns of the next and the previous row of the same key.

    ``order`` starts with a timestamp and ends with a unique column; ``next_of`` and ``previous_of`` map
    new column names to the column to fetch.
    """
    next_of, previous_of = next_of or {}, previous_of or {}
    heavy = _heavy(df, keys, order[0], heavy)
    if heavy is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns(
            {o: F.lead(c).over(w) for o, c in next_of.items()} | {o: F.lag(c).over(w) for o, c in previous_of.items()}
        )
    df = _sliced(df, keys, order[0], heavy)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    inner = df.withColumns(
        {o: F.lead(c).over(w) for o, c in next_of.items()}
        | {o: F.lag(c).over(w) for o, c in previous_of.items()}
        | {"_ends": F.lead(F.lit(1)).over(w).isNull(), "_starts": F.lag(F.lit(1)).over(w).isNull()}
    )
    fetched = sorted(set(next_of.values()) | set(previous_of.values()))
    position, values = F.struct(*order), F.struct(*fetched)
    across = Window.partitionBy(*keys).orderBy("_slice")
    edges = (
        df.filter(F.col("_slice").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.min_by(values, position).alias("_head"), F.max_by(values, position).alias("_tail"))
        .select(*keys, "_slice", F.lead("_head").over(across).alias("_after"), F.lag("_tail").over(across).alias("_before"))
    )
    joined = _across(inner, edges, keys)
    joined = joined.withColumns(
        {o: F.when(F.col("_ends"), F.col("_after")[c]).otherwise(F.col(o)) for o, c in next_of.items()}
        | {o: F.when(F.col("_starts"), F.col("_before")[c]).otherwise(F.col(o)) for o, c in previous_of.items()}
    )
    return joined.drop("_slice", "_ends", "_starts", "_after", "_before")


def with_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    heavy: DataFrame | Sequence | None = None,
) -> DataFrame:
    """Add the 1-based position of each row within its key; ``order[0]`` is a timestamp."""
    heavy = _heavy(df, keys, order[0], heavy)
    if heavy is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    df = _sliced(df, keys, order[0], heavy)
    inner = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.filter(F.col("_slice").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_slice", F.sum("_n").over(earlier).alias("_offset"))
    )
    joined = _across(inner, offsets, keys)
    return joined.withColumn(out, (F.col(out) + F.coalesce("_offset", F.lit(0))).cast("bigint")).drop("_slice", "_offset")


def with_last_seen(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    heavy: DataFrame | Sequence | None = None,
) -> DataFrame:
    """Add the latest non-null ``value`` at or before each row of the same key."""
    heavy = _heavy(df, keys, order[0], heavy)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    if heavy is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*so_far)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    df = _sliced(df, keys, order[0], heavy)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(*so_far)
    inner = df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        df.filter(F.col("_slice").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
        .select(*keys, "_slice", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    )
    joined = _across(inner, carried, keys)
    return joined.withColumn(out, F.coalesce(F.col(out), F.col("_carried"))).drop("_slice", "_carried")


def unique_within(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    within_seconds: int,
    last_kept: DataFrame | None = None,
    heavy: DataFrame | Sequence | None = None,
) -> DataFrame:
    """Rows kept when a key may occur only once per window.

    A row is kept when it comes at least ``within_seconds`` after the last *kept* row of its key; among
    rows of one instant the smallest ``tie`` counts.  Rows without a time are left out; a null key is a key.
    Returns (key, ts, tie).  ``last_kept`` (key, ts), at most one row per key, carries on from an earlier call.

    The rule is a chain: each kept row decides the next.  Sorted partitions are streamed with one carried
    value per key.  A heavy key is cut into time slices; for each slice the end of the chain is tabulated
    for every possible start, the tables are followed in order, and then all slices run in parallel.
    """
    window = int(within_seconds * 1_000_000)
    df = df.where(F.col(ts).isNotNull())
    heavy = _heavy(df, [key], ts, heavy)
    instants = df.groupBy(F.col(key).alias("k"), F.col(ts).alias("t")).agg(F.min(tie).alias("tie")).withColumn("us", _micros("t"))
    # Python gets the key as text that is never null, and no number that could be.
    text = F.coalesce(F.concat(F.lit("="), F.col("k").cast("string")), F.lit(""))
    instants = instants.withColumns({"g": text, "cut": F.lit(-1)})
    if last_kept is None:
        instants = instants.withColumn("entry", F.lit(_NONE))
    else:
        last = last_kept.where(F.col(ts).isNotNull()).select(F.col(key).alias("_last"), (_micros(ts) + window).alias("entry"))
        instants = instants.join(last, F.col("k").eqNullSafe(F.col("_last")), "left").drop("_last")
        instants = instants.withColumn("entry", F.coalesce("entry", F.lit(_NONE)))
    if heavy is not None:
        instants = _sliced(instants, ["k"], "t", heavy.withColumnRenamed(key, "k"))
        instants = instants.withColumn("cut", F.coalesce("_slice", F.lit(-1))).drop("_slice")
        steps = (
            instants.filter("cut >= 0")
            .select("g", "cut", "us", "entry")
            .groupBy("g", "cut")
            .applyInPandas(_chain_ends(window), "g string, cut int, upto bigint, chain_end bigint, start bigint")
        )
        entries = _in_order(steps, ["g"], ["cut", "upto"]).mapInPandas(_follow_slices(window), "g string, cut int, _entry bigint")
        instants = instants.join(entries, ["g", "cut"], "left").withColumn("entry", F.coalesce("_entry", "entry"))
    instants = _in_order(instants.select("g", "cut", "us", "entry", "k", "t", "tie"), ["g", "cut"], ["us"])
    kept = instants.mapInArrow(_keep_chain(window), instants.select("k", "t", "tie").schema)
    return kept.select(F.col("k").alias(key), F.col("t").alias(ts), F.col("tie").alias(tie))


def _in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a key together and in order, for a function that streams over them.

    A repartition is dropped when the rows are already distributed that way, and adaptive execution may
    then split or re-read the partitions.  A window states the need where it cannot be dropped.
    """
    return df.withColumn("_position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def _chain_ends(window: int):
    none = _NONE

    def table(group: pd.DataFrame) -> pd.DataFrame:
        us = np.sort(group["us"].to_numpy())
        start = int(group["entry"].iloc[0])
        following = np.searchsorted(us, us + window)
        end = np.where(following < len(us), following, np.arange(len(us)))
        while True:
            further = end[end]
            if np.array_equal(further, end):
                break
            end = further
        # The row kept last before the slice is older than its first row, so no chain starts later than this.
        starts = min(int(np.searchsorted(us, us[0] + window)) + 1, len(us))
        if start != none:
            starts = len(us)
        chain_end, upto = us[end[:starts]], us[:starts]
        last = np.append(chain_end[1:] != chain_end[:-1], True)
        return pd.DataFrame({"g": group["g"].iloc[0], "cut": group["cut"].iloc[0], "upto": upto[last], "chain_end": chain_end[last], "start": start})

    return table


def _follow_slices(window: int):
    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = cut = allowed = None
        done = False
        for batch in batches:
            rows = []
            for k, c, upto, chain_end, start in zip(batch["g"], batch["cut"], batch["upto"], batch["chain_end"], batch["start"]):
                if k != key:
                    key, cut, allowed = k, None, start
                if c != cut:
                    cut, done = c, False
                    rows.append((k, c, allowed))
                if not done and upto >= allowed:
                    allowed, done = chain_end + window, True
            yield pd.DataFrame(rows, columns=["g", "cut", "_entry"])

    return follow


def _keep_chain(window: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, allowed = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, cuts, us, entries = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (cuts[1:] != cuts[:-1])) + 1
            bounds = np.concatenate(([0], change, [len(us)]))
            kept = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if group != (keys[lo], cuts[lo]):
                    group, allowed = (keys[lo], cuts[lo]), entries[lo]
                i = lo + int(np.searchsorted(us[lo:hi], allowed))
                while i < hi:
                    kept.append(i)
                    allowed = us[i] + window
                    i += 1 + int(np.searchsorted(us[i + 1 : hi], allowed))
            yield batch.select(["k", "t", "tie"]).take(pa.array(kept, pa.int64()))

    return keep
