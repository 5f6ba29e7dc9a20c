"""Retry history, timelines, traces, cron history, latest state, control-log fold, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.functions import backoff_seconds, dash_if_null
from jobscope.operators.ordered import with_last_seen, with_neighbours
from jobscope.operators.shape import broadcast_if_small, measured
from jobscope.schemas import CRON_HISTORY_LIMIT


def _text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def retry_history(attempts: DataFrame, heavy=None) -> DataFrame:
    """Attempts of each job in order; the next retry is the start of the following attempt.

    Times a user reads are text, a dash where there is none.
    """
    ordered = with_neighbours(attempts, ["job_id"], ["started_at", "attempt"], next_of={"next_at": "started_at"}, heavy=heavy)
    return ordered.select(
        "job_id",
        "attempt",
        "state",
        dash_if_null("error").alias("error"),
        "started_at",
        dash_if_null(_text("failed_at")).alias("failed_at"),
        dash_if_null(_text("next_at")).alias("next_retry_at"),
    )


def retry_plan(jobs: DataFrame, policies: DataFrame, initial_default: int = 1) -> DataFrame:
    """Jobs with their type's policy and the wait before the next attempt; no policy means exponential."""
    joined = jobs.select("job_id", "type", "attempt", "max_attempts").join(broadcast_if_small(measured(policies)), "type", "left")
    strategy = F.coalesce("strategy", F.lit("exponential"))
    initial = F.coalesce("initial_seconds", F.lit(initial_default))
    limit = F.coalesce("policy_max_attempts", "max_attempts")
    return joined.select(
        "job_id",
        "type",
        "attempt",
        strategy.alias("strategy"),
        limit.alias("max_attempts"),
        F.when(F.col("attempt") < limit, backoff_seconds(strategy, F.col("attempt"), initial)).alias("next_delay_seconds"),
    )


def backoff_table(policies: DataFrame) -> DataFrame:
    """Wait after each attempt for every policy."""
    return policies.select(
        "type", "strategy", "initial_seconds", F.explode(F.sequence(F.lit(1), F.col("policy_max_attempts"))).alias("attempt")
    ).select("type", "attempt", backoff_seconds(F.col("strategy"), F.col("attempt"), F.col("initial_seconds")).alias("delay_seconds"))


def timeline(events: DataFrame, heavy=None) -> DataFrame:
    """State events of each job with the previous event and a mark on the last one."""
    ordered = with_neighbours(
        events,
        ["job_id"],
        ["ts", "event_id"],
        next_of={"_next": "event_id"},
        previous_of={"previous": "type"},
        heavy=heavy,
    )
    return ordered.select("job_id", "event_id", "ts", "type", "previous", F.col("_next").isNull().alias("is_last"))


def trace(events: DataFrame, heavy=None) -> DataFrame:
    """Phases of each job: how long until the next event, and whether the phase ended in a failure."""
    ordered = with_neighbours(events, ["job_id"], ["ts", "event_id"], next_of={"next_ts": "ts", "next_type": "type"}, heavy=heavy)
    micros = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return ordered.select(
        "job_id",
        "event_id",
        F.col("type").alias("phase"),
        F.round(micros / 1000.0, 3).alias("duration_ms"),
        F.coalesce("next_type", F.lit("open")).alias("state"),
        F.when(F.col("next_type") == "job.failed", "failed").alias("error"),
    )


def cron_history(runs: DataFrame, limit: int = CRON_HISTORY_LIMIT) -> DataFrame:
    """The latest runs of each cron.

    The rank filter is pushed below the shuffle (each task sends at most ``limit`` rows per cron).
    """
    newest = Window.partitionBy("name").orderBy(F.desc("scheduled_at"), F.desc("job_id"))
    return runs.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each job; an aggregate, so map tasks send one row per job."""
    last = F.max_by(F.struct("type", "queue", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("job_id").agg(last.alias("last")).select("job_id", "last.type", "last.queue", F.col("last.ts").alias("since"))


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; an aggregate instead of a ranking."""
    others = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return df.groupBy(*key).agg(first.alias("_first")).select(*key, *[F.col("_first")[c].alias(c) for c in others])


# The setting each control action writes, and the value it writes (None: taken from the entry);
# a worker resumes from being quiet, a queue from being paused.
CONTROL_ACTIONS = {
    "pause": ("paused", "true"),
    "resume": ("paused", "false"),
    "override": ("override", None),
    "clear": ("override", ""),
    "config": ("config", None),
    "quiet": ("directive", "quiet"),
    "concurrency": ("concurrency", None),
    "max_size": ("max_size", None),
    "retention": ("retention", None),
}
WORKER_RESUME = ("directive", "none")


def control_state(log: DataFrame) -> DataFrame:
    """Current settings per entity and field; the latest entry of a field wins, a cleared field is null.

    Entries with an unknown action are left out; :func:`control_rejects` has them.
    """
    table = F.create_map(*[F.lit(x) for a, (field, _) in CONTROL_ACTIONS.items() for x in (a, field)])
    fixed = F.create_map(*[x for a, (_, v) in CONTROL_ACTIONS.items() for x in (F.lit(a), F.lit(v).cast("string"))])
    resumed = (F.col("action") == "resume") & (F.col("entity_kind") == "worker")
    field = F.when(resumed, WORKER_RESUME[0]).otherwise(table[F.col("action")])
    set_to = F.when(resumed, WORKER_RESUME[1]).otherwise(F.coalesce(fixed[F.col("action")], F.col("amount").cast("string")))
    entries = log.withColumns({"field": field, "set_to": set_to})
    latest = F.max_by(F.struct("set_to", "ts"), F.struct("ts", "seq"))
    return (
        entries.filter(F.col("field").isNotNull())
        .groupBy("entity_kind", "entity", "field")
        .agg(latest.alias("last"))
        .select("entity_kind", "entity", "field", F.nullif(F.col("last.set_to"), F.lit("")).alias("value"), F.col("last.ts").alias("changed_at"))
    )


def control_rejects(log: DataFrame) -> DataFrame:
    """Control entries whose action is missing or unknown, with the reason."""
    unknown = ~F.coalesce(F.col("action").isin(list(CONTROL_ACTIONS)), F.lit(False))
    return log.where(unknown).withColumn("reason", F.concat(F.lit("unknown action: "), F.coalesce("action", F.lit(""))))


def paused_queues(queues: DataFrame, control: DataFrame) -> DataFrame:
    """(queue, paused) from the queue list and the folded control log."""
    flags = control.filter((F.col("entity_kind") == "queue") & (F.col("field") == "paused")).select(
        F.col("entity").alias("queue"), (F.col("value") == "true").alias("paused")
    )
    return queues.join(broadcast_if_small(measured(flags)), "queue", "left").withColumn("paused", F.coalesce("paused", F.lit(False)))


def start_to_finish(events: DataFrame, within_seconds: int = 3600, heavy=None) -> DataFrame:
    """Latency of each finish event from the job's latest start, if that is not older than the limit.

    Each finish meets one start; starts and finishes are not joined pair by pair.
    """
    relevant = events.filter(F.col("type").isin("job.started", "job.completed", "job.failed"))
    marked = relevant.withColumn("_start", F.when(F.col("type") == "job.started", F.col("ts")))
    seen = with_last_seen(marked, ["job_id"], ["ts", "event_id"], "_start", "started_at", heavy=heavy)
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return seen.filter((F.col("type") != "job.started") & (micros <= within_seconds * 1_000_000)).select(
        "job_id", "event_id", "started_at", F.col("ts").alias("finished_at"), F.col("type").alias("outcome"), F.round(micros / 1000.0, 3).alias("latency_ms")
    )
