"""Streaming queries, run over the event table until all of it is processed."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope import bindings
from jobscope.entries.registry import query
from jobscope.entries.relations import subscriptions_with_lists
from jobscope.operators import stats
from jobscope.session import work_dir
from jobscope.streaming import live
from jobscope.streaming.tables import drain


# How far event time has come when all events are read: results wait until it has passed them.
_WATERMARK = "watermark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '1' HOUR AS ts FROM job_events)"


def _stream(t, table: str) -> DataFrame:
    """A stored table as a file stream; the path pattern fits a file as well as a folder of files."""
    schema = t.base(table).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir.rstrip('/')}/{table}.parque[t]")


def job_events(t) -> DataFrame:
    _stream(t, "events").createOrReplaceTempView("events")
    return t.spark.sql(bindings.VIEWS["job_events"])


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(
    "stream_filter",
    "SELECT event_id, ts, job_id, type, queue FROM job_events WHERE type IN ('job.completed', 'job.failed') AND queue = 'email'",
    "job_events",
)
def stream_filter(t):
    events = job_events(t).select("event_id", "ts", "job_id", "type", "queue")
    running, table = live.start_filter(events, ["job.completed", "job.failed"], "email")
    drain(running)
    return table.read().drop("epoch")


@query(
    "stream_history",
    """SELECT date_trunc('hour', ts) AS timestamp, count(*) FILTER (WHERE type = 'job.enqueued') AS enqueued, count(*) FILTER (WHERE type = 'job.completed') AS completed,
      count(*) FILTER (WHERE type = 'job.failed') AS failed, CAST(round(CAST(CAST(sum(CAST(latency_ms AS DECIMAL(20, 6))) FILTER (WHERE type = 'job.completed') AS DOUBLE) / nullif(count(latency_ms) FILTER (WHERE type = 'job.completed'), 0) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS avg_latency_ms FROM job_events GROUP BY 1""",
    "job_events",
)
def stream_history(t):
    running, table = live.start_history(job_events(t), "1h")
    drain(running)
    return table.latest(["timestamp"])


_ROLLUP = """SELECT '{0}' AS period, {1} AS timestamp, count(*) FILTER (WHERE type = 'job.enqueued') AS enqueued, count(*) FILTER (WHERE type = 'job.completed') AS completed,
      count(*) FILTER (WHERE type = 'job.failed') AS failed, CAST(round(CAST(CAST(sum(CAST(latency_ms AS DECIMAL(20, 6))) FILTER (WHERE type = 'job.completed') AS DOUBLE) / nullif(count(latency_ms) FILTER (WHERE type = 'job.completed'), 0) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS avg_latency_ms
    FROM {2} GROUP BY 2"""
_PERIODS = {"5m": "time_bucket(INTERVAL '5 minutes', ts)", "1h": "date_trunc('hour', ts)", "1d": "CAST(date_trunc('day', ts) AS TIMESTAMP)"}


def _all_periods(table: str) -> str:
    return " UNION ALL ".join(_ROLLUP.format(name, start, table) for name, start in _PERIODS.items())


@query(
    "stream_rollup",
    f"""WITH {_WATERMARK}, closed AS (SELECT e.* FROM job_events e, watermark w WHERE date_trunc('day', e.ts) + INTERVAL '1' DAY <= w.ts)
    {_all_periods("closed")}""",
    "job_events",
)
def stream_rollup(t):
    running, table = live.start_rollup(job_events(t))
    drain(running)
    return table.read().drop("epoch")


@query("stats_history_all", _all_periods("job_events"), "job_events")
def stats_history_all(t):
    return stats.stats_history_all(t.job_events)


@query(
    "stream_dashboard",
    """SELECT queue, type, count(*) AS jobs FROM (SELECT * FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY queue, type""",
    "job_events",
)
def stream_dashboard(t):
    changing, changes = live.start_changes(job_events(t), forget_after=dt.timedelta(days=60))
    drain(changing)
    running, table = live.start_dashboard(t.spark, changes)
    drain(running)
    return live.dashboard_counts(table)


@query(
    "stream_unique",
    """WITH RECURSIVE kept(job_id, ts) AS (SELECT job_id, min(ts) FROM job_events GROUP BY job_id
      UNION ALL SELECT k.job_id, min(e.ts) FROM kept k JOIN job_events e ON e.job_id = k.job_id AND e.ts >= k.ts + INTERVAL '6' HOUR GROUP BY k.job_id, k.ts)
    SELECT k.job_id, k.ts, min(e.event_id) AS event_id FROM kept k JOIN job_events e ON e.job_id = k.job_id AND e.ts = k.ts
    GROUP BY k.job_id, k.ts""",
    "job_events",
)
def stream_unique(t):
    """All events read, then the end marked, so that the last hour is written too."""
    ends, path, checkpoint = live.open_ends(t.spark), work_dir(t.spark, "unique"), work_dir(t.spark, "stream")
    for ended in (False, True):
        if ended:
            live.mark_end(t.spark, ends)
        running, table = live.start_unique(job_events(t), "job_id", 6 * 3600, path=path, ends=ends, checkpoint=checkpoint)
        drain(running)
    return table.read().drop("epoch")


@query(
    "stream_sub_match",
    """SELECT s.id, s.url, x.type, count(e.event_id) AS events, min(e.ts) AS first_at, max(e.ts) AS last_at
    FROM subscriptions s, unnest(string_split(s.events_csv, ',')) x(type), (SELECT * FROM job_events) e WHERE s.active AND x.type <> '' AND e.type = x.type GROUP BY 1, 2, 3""",
    "subscriptions job_events",
)
def stream_sub_match(t):
    running, table = live.start_subscription_match(job_events(t))
    drain(running)
    return live.subscription_matches(subscriptions_with_lists(t), table)


@query(
    "dual_run",
    """SELECT event_id, concat('job-', CAST(event_id AS VARCHAR)) AS job_id,
      CASE WHEN CAST(concat('0x', left(md5(concat('job-', CAST(event_id AS VARCHAR))), 8)) AS BIGINT) % 100 < 30 THEN 'target' ELSE 'legacy' END AS route FROM events""",
)
def dual_run(t):
    incoming = _stream(t, "events").select("event_id", F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"))
    running, routed, _ = live.start_dual_run(incoming, 30)
    drain(running)
    return routed.read().drop("epoch")


@query(
    "dual_run_counters",
    """SELECT count(*) FILTER (WHERE b < 30) AS target, count(*) FILTER (WHERE b >= 30) AS legacy
    FROM (SELECT CAST(concat('0x', left(md5(concat('job-', CAST(event_id AS VARCHAR))), 8)) AS BIGINT) % 100 AS b FROM events)""",
)
def dual_run_counters(t):
    incoming = _stream(t, "events").select(F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"))
    running, _, counters = live.start_dual_run(incoming, lambda: 30)
    drain(running)
    return counters.read().agg(F.sum("target").alias("target"), F.sum("legacy").alias("legacy"))


@query(
    "stream_stale",
    """WITH e AS (SELECT concat('worker-', CAST(user_id AS VARCHAR)) AS worker_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL '30' MINUTE, true) AS fresh FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY worker_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT worker_id, max(ts) + INTERVAL '30' MINUTE AS stale_at, max(ts) AS last_heartbeat, count(*) AS heartbeats FROM s GROUP BY worker_id, g
    HAVING max(ts) + INTERVAL '30' MINUTE <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL '1' HOUR""",
)
def stream_stale(t):
    beats = _stream(t, "events").select(F.concat(F.lit("worker-"), F.col("user_id").cast("string")).alias("worker_id"), "ts")
    running, table = live.start_stale(beats, "30 minutes")
    drain(running)
    return _ntz(table.read().drop("epoch"), "stale_at", "last_heartbeat")


@query(
    "stream_latency",
    """WITH e AS (SELECT job_id, event_id, ts, type, last_value(CASE WHEN type = 'job.started' THEN ts END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM job_events)
    SELECT job_id, event_id, s AS started_at, e.ts AS finished_at, type AS outcome, round(date_diff('microsecond', s, e.ts) / 1000.0, 3) AS latency_ms
    FROM e, watermark w WHERE type IN ('job.completed', 'job.failed') AND e.ts <= s + INTERVAL '1' HOUR AND e.ts <= w.ts - INTERVAL '1' HOUR""".replace("WITH e AS", f"WITH {_WATERMARK}, e AS", 1),
    "job_events",
)
def stream_latency(t):
    running, table = live.start_latency(job_events(t))
    drain(running)
    return table.read().drop("epoch")
