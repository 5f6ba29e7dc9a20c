"""State changes as new snapshots: purge, bulk transitions, replay, priority, enqueue defaults.

Plain parquet has no MERGE, so each operator returns the changed rows or the new snapshot and leaves
the write to the caller.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions import duration
from jobscope.functions.timing import parse_duration
from jobscope.operators.shape import broadcast_if_small
from jobscope.operators.search import jobs_by_id
from jobscope.operators.shape import once
from jobscope.schemas import TERMINAL_STATES


class Purge(NamedTuple):
    kept: DataFrame
    deleted: DataFrame

    def deleted_count(self) -> DataFrame:
        return self.deleted.agg(F.count("*").alias("deleted"))


def purge(
    jobs: DataFrame,
    as_of: dt.datetime,
    states: Sequence[str] = ("completed",),
    queue: str | None = None,
    older_than: str | None = None,
) -> Purge:
    """Split jobs into kept and deleted.

    A job is deleted when its state is listed, its queue matches and it finished (or, failing that, was
    created) before ``as_of - older_than``.  Null comparisons keep the row.
    """
    doomed = F.col("state").isin(list(states))
    if queue:
        doomed &= F.col("queue") == queue
    if older_than:
        doomed &= F.coalesce("completed_at", "created_at") < F.lit(as_of - parse_duration(older_than)).cast("timestamp_ntz")
    doomed = F.coalesce(doomed, F.lit(False))
    return Purge(jobs.filter(~doomed), jobs.filter(doomed))


# States an action may start from, and the state it leads to (None: the row goes away).
TRANSITIONS = {
    "cancel": (["available", "active", "retryable", "scheduled"], "cancelled"),
    "retry": (["discarded", "retryable", "cancelled"], "available"),
    "delete": (TERMINAL_STATES, None),
}


class Bulk(NamedTuple):
    """Outcome per requested job, one row with the done and failed counts, and the new snapshot."""

    outcomes: DataFrame
    counts: DataFrame
    snapshot: DataFrame


def bulk_transition(
    jobs: DataFrame,
    action: str,
    ids: DataFrame | None = None,
    state: str | None = None,
    queue: str | None = None,
    older_than: str | None = None,
    as_of: dt.datetime | None = None,
) -> Bulk:
    """Cancel, retry or delete many jobs, by id list or by filter; one of the two must be given.

    An id that does not exist, or a job in a state the action does not allow, counts as failed.
    """
    legal_states, new_state = TRANSITIONS[action]
    legal = F.col("state").isin(legal_states)
    if ids is not None:
        wanted = ids.select("job_id").distinct()
        # The request list is the smaller side in practice, but it is broadcast only if its size is known.
        current = jobs.select("job_id", "state")
        outcomes = wanted.join(current, "job_id", "left").select(
            "job_id", F.col("state").alias("old_state"), F.coalesce(legal, F.lit(False)).alias("done")
        )
        changed = broadcast_if_small(wanted.withColumn("_hit", F.lit(True)))
        flagged = jobs.join(changed, "job_id", "left").withColumn("_hit", F.coalesce(F.col("_hit") & legal, F.lit(False)))
    elif state or queue:
        hit = F.lit(True)
        if state:
            hit &= F.col("state") == state
        if queue:
            hit &= F.col("queue") == queue
        if older_than:
            if as_of is None:
                raise ValueError("older_than needs as_of")
            hit &= F.coalesce("completed_at", "created_at") < F.lit(as_of - parse_duration(older_than)).cast("timestamp_ntz")
        hit = F.coalesce(hit, F.lit(False))
        outcomes = jobs.filter(hit).select("job_id", F.col("state").alias("old_state"), F.coalesce(legal, F.lit(False)).alias("done"))
        flagged = jobs.withColumn("_hit", F.coalesce(hit & legal, F.lit(False)))
    else:
        raise ValueError("give ids, or a state or queue filter")
    if new_state is None:
        snapshot = flagged.filter(~F.col("_hit")).drop("_hit")
    else:
        snapshot = flagged.withColumn("state", F.when(F.col("_hit"), new_state).otherwise(F.col("state"))).drop("_hit")
    counts = outcomes.agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("failed"))
    return Bulk(outcomes, counts, snapshot)


def replay(jobs: DataFrame, ids: DataFrame, queue: str | None = None, priority: int | None = None, new_id: Column | None = None) -> DataFrame:
    """New job rows from old ones; queue and priority may be overridden, metadata is kept.

    ``new_id`` defaults to a random id; pass an expression to get repeatable rows.
    """
    old = jobs_by_id(jobs, ids)
    return old.select(
        (F.expr("uuid()") if new_id is None else new_id).alias("job_id"),
        F.col("job_id").alias("replayed_from"),
        "type",
        F.coalesce(F.lit(queue), F.col("queue")).alias("queue"),
        F.coalesce(F.lit(priority).cast("int"), F.col("priority")).alias("priority"),
        "args_json",
        *([F.col("meta")] if "meta" in jobs.columns else []),
        F.lit("available").alias("state"),
    )


def apply_priority(jobs: DataFrame, updates: DataFrame, low: int = 0, high: int = 255) -> tuple[DataFrame, DataFrame]:
    """New snapshot with the valid updates (job_id, new_priority) applied, and the rejected updates.

    Of several valid updates for one job the greatest priority wins, so the result does not depend on order.
    """
    valid = F.col("new_priority").between(low, high)
    latest = updates.filter(valid).groupBy("job_id").agg(F.max("new_priority").alias("new_priority"))
    patched = jobs.join(broadcast_if_small(latest), "job_id", "left").withColumn(
        "priority", F.coalesce(F.col("new_priority").cast("int"), F.col("priority"))
    )
    return patched.drop("new_priority"), updates.filter(~F.coalesce(valid, F.lit(False)))


def normalise_enqueue(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply enqueue defaults to request rows; returns (jobs, rejects with a reason).

    ``args`` defaults to an empty array and must be JSON; priority and max_attempts count only if positive;
    a uniqueness window needs a key.
    """
    args = F.coalesce("args", F.lit("[]"))
    checked = once(requests, _args=F.try_parse_json(args)).withColumn(
        "reason",
        F.when(F.coalesce(F.col("type"), F.lit("")) == "", "type is required").when(F.col("_args").isNull(), "invalid args JSON"),
    )
    passthrough = [c for c in requests.columns if c not in ("type", "queue", "args", "priority", "max_attempts", "unique_key", "unique_within")]
    key = F.nullif(F.col("unique_key"), F.lit(""))
    jobs = checked.filter(F.col("reason").isNull()).select(
        *passthrough,
        "type",
        F.to_json("_args").alias("args"),
        F.coalesce(F.nullif(F.col("queue"), F.lit("")), F.lit("default")).alias("queue"),
        F.when(F.col("priority") > 0, F.col("priority")).alias("priority"),
        F.when(F.col("max_attempts") > 0, F.col("max_attempts")).alias("max_attempts"),
        key.alias("unique_key"),
        F.when(key.isNotNull(), (F.unix_seconds(F.timestamp_seconds(F.lit(0)) + duration("unique_within")))).alias("unique_seconds"),
    )
    return jobs, checked.filter(F.col("reason").isNotNull()).select(*passthrough, "reason")
