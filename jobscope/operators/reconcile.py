"""Migration checks: mapping, reconciliation, import results, run counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.operators.shape import broadcast_if_small, measured
from jobscope.schemas import NDJSON_BATCH
from jobscope.session import cut_lineage


def apply_mapping(jobs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename types and queues by a mapping table; names without a mapping stay.

    ``mapping`` has (source_type, target_type, source_queue, target_queue).  It is folded to one entry per
    name, so a repeated mapping cannot multiply jobs.
    """
    types = mapping.groupBy(F.col("source_type").alias("type")).agg(F.min("target_type").alias("_type"))
    queues = mapping.groupBy(F.col("source_queue").alias("queue")).agg(F.min("target_queue").alias("_queue"))
    types, queues = broadcast_if_small(measured(types)), broadcast_if_small(measured(queues))
    mapped = jobs.join(types, "type", "left").join(queues, "queue", "left")
    renamed = {"type": F.coalesce("_type", "type"), "queue": F.coalesce("_queue", "queue")}
    return mapped.select(*[renamed[c].alias(c) if c in renamed else F.col(c) for c in jobs.columns])


def _digest(columns: Sequence[str]) -> Column:
    """60 bits of an MD5 over the given columns, as a number that can be summed exactly."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    return F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("decimal(20,0)")


def reconcile(source: DataFrame, target: DataFrame, key: str = "job_id", compare: Sequence[str] = ("type", "queue", "args_json")) -> DataFrame:
    """Per id: matched, changed, missing (not in the target) or extra (only there).

    Both sides are reduced to (copies, digest sum) per id first, so repeated ids are compared as a set of
    rows and do not multiply in the join.
    """
    both = _reduced(source, key, compare, "source").join(_reduced(target, key, compare, "target"), key, "full")
    same = (F.col("source_rows") == F.col("target_rows")) & (F.col("source_digest") == F.col("target_digest"))
    status = (
        F.when(F.col("target_rows").isNull(), "missing")
        .when(F.col("source_rows").isNull(), "extra")
        .when(same, "matched")
        .otherwise("changed")
    )
    return both.select(key, status.alias("status"))


def _reduced(df: DataFrame, key: str, compare: Sequence[str], side: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(f"{side}_rows"), F.sum(_digest(compare)).alias(f"{side}_digest"))


def _range(key: str, level: int) -> Column:
    """The range of ids at a level of the tree: the first bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - level)


def differing_ranges(source: DataFrame, target: DataFrame, key: str, compare: Sequence[str], level: int) -> DataFrame:
    """(range): ranges of ids in which the tables differ, by an order-free digest of each range's rows.

    A task adds up its own rows, so one row per range and task is shuffled.
    """
    def digests(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(_range(key, level).alias("range")).agg(F.count("*").alias(f"{side}_rows"), F.sum(_digest([key, *compare])).alias(f"{side}_digest"))

    both = digests(source, "source").join(digests(target, "target"), "range", "full")
    same = F.col("source_rows").eqNullSafe(F.col("target_rows")) & F.col("source_digest").eqNullSafe(F.col("target_digest"))
    return both.where(~same).select("range")


def reconcile_ranges(source: DataFrame, target: DataFrame, key: str = "job_id", compare: Sequence[str] = ("type", "queue", "args_json"), levels: Sequence[int] = (12, 20)) -> DataFrame:
    """The ids that :func:`reconcile` does not call matched, for tables that hardly differ.

    A tree of digests over ranges of ids leaves out what is equal: the coarse ranges are compared first, then the
    finer ones inside those that differ, and only rows of the finest differing ranges are shuffled by id and
    joined.  Tables that differ everywhere cost a few passes more than :func:`reconcile`.
    """
    for level in levels:
        ranges = cut_lineage(differing_ranges(source, target, key, compare, level), "ranges")
        source, target = (df.join(broadcast_if_small(ranges), _range(key, level) == ranges["range"], "left_semi") for df in (source, target))
    return reconcile(source, target, key, compare).where("status <> 'matched'")


def import_result(lines: DataFrame, parsable: Column, batch_size: int = NDJSON_BATCH) -> DataFrame:
    """Total, success, failed and number of batches; batches are counted by arithmetic."""
    return lines.agg(F.count("*").alias("total"), F.count_if(parsable).alias("success")).select(
        "total",
        "success",
        (F.col("total") - F.col("success")).alias("failed"),
        F.ceil(F.col("success") / batch_size).cast("bigint").alias("batches"),
    )


def migration_stats(log: DataFrame) -> DataFrame:
    """Counters and phase per migration run; the phase follows from what happened last."""
    event = F.col("event")
    last = F.max_by("event", F.struct("ts", "seq", "event"))
    counted = log.groupBy("run_id").agg(
        F.count_if(event == "exported").alias("exported"),
        F.count_if(event == "imported").alias("imported"),
        F.count_if(event == "verified").alias("verified"),
        F.count_if(event == "error").alias("errors"),
        last.alias("last"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("last_at"),
    )
    phase = (
        F.when(F.col("exported") + F.col("imported") + F.col("verified") == 0, "failed")
        .when(F.col("last") == "exported", "exporting")
        .when(F.col("last") == "verified", F.when(F.col("verified") >= F.col("imported"), "complete").otherwise("verifying"))
        .otherwise("importing")
    )
    return counted.withColumn("phase", phase).drop("last")
