"""Retry histories, timelines, cron history, folds and deduplication."""

from pyspark.sql import functions as F

from jobscope.entries.registry import query
from jobscope.operators import history
from jobscope.operators.ordered import unique_within


@query(
    "retry_history",
    """SELECT job_id, attempt, state, coalesce(error, '-') AS error, started_at, coalesce(strftime(failed_at, '%Y-%m-%d %H:%M:%S'), '-') AS failed_at,
      coalesce(strftime(lead(started_at) OVER (PARTITION BY job_id ORDER BY attempt), '%Y-%m-%d %H:%M:%S'), '-') AS next_retry_at FROM attempts""",
    "attempts",
)
def retry_history(t):
    return history.retry_history(t.attempts)


@query(
    "retry_plan",
    """SELECT j.job_id, j.type, j.attempt, coalesce(p.strategy, 'exponential') AS strategy, coalesce(p.policy_max_attempts, j.max_attempts) AS max_attempts,
      CASE WHEN j.attempt < coalesce(p.policy_max_attempts, j.max_attempts) THEN CAST(CASE p.strategy WHEN 'fixed' THEN initial_seconds
        WHEN 'linear' THEN initial_seconds * j.attempt WHEN 'polynomial' THEN pow(j.attempt, 4) + 15
        ELSE coalesce(initial_seconds, 1) * pow(2, j.attempt - 1) END AS DOUBLE) END AS next_delay_seconds
    FROM jobs j LEFT JOIN retry_policies p ON p.type = j.type""",
    "jobs retry_policies",
)
def retry_plan(t):
    return history.retry_plan(t.jobs, t.retry_policies)


@query(
    "backoff_table",
    """SELECT type, CAST(a AS INTEGER) AS attempt, CAST(CASE strategy WHEN 'fixed' THEN initial_seconds WHEN 'linear' THEN initial_seconds * a
      WHEN 'polynomial' THEN pow(a, 4) + 15 ELSE initial_seconds * pow(2, a - 1) END AS DOUBLE) AS delay_seconds
    FROM retry_policies, range(1, 100) r(a) WHERE a <= policy_max_attempts""",
    "retry_policies",
)
def backoff_table(t):
    return history.backoff_table(t.retry_policies)


@query(
    "timeline",
    """SELECT job_id, event_id, ts, type, lag(type) OVER w AS previous, lead(event_id) OVER w IS NULL AS is_last
    FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)""",
    "job_events",
)
def timeline(t):
    return history.timeline(t.job_events)


@query(
    "trace",
    """SELECT job_id, event_id, type AS phase, round(date_diff('microsecond', ts, lead(ts) OVER w) / 1000.0, 3) AS duration_ms,
      coalesce(lead(type) OVER w, 'open') AS state, CASE WHEN lead(type) OVER w = 'job.failed' THEN 'failed' END AS error
    FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)""",
    "job_events",
)
def trace(t):
    return history.trace(t.job_events)


@query(
    "cron_history",
    """SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY scheduled_at DESC, job_id DESC) AS INTEGER) AS rank FROM cron_runs QUALIFY rank <= 10""",
    "cron_runs",
)
def cron_history(t):
    return history.cron_history(t.cron_runs)


@query(
    "latest_state",
    """SELECT job_id, type, queue, ts AS since FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1""",
    "job_events",
)
def latest_state(t):
    return history.latest_state(t.job_events)


@query(
    "unique_within",
    """WITH RECURSIVE kept(job_id, ts) AS (SELECT job_id, min(ts) FROM job_events GROUP BY job_id
      UNION ALL SELECT k.job_id, min(e.ts) FROM kept k JOIN job_events e ON e.job_id = k.job_id AND e.ts >= k.ts + INTERVAL '6' HOUR GROUP BY k.job_id, k.ts)
    SELECT k.job_id, k.ts, min(e.event_id) AS event_id FROM kept k JOIN job_events e ON e.job_id = k.job_id AND e.ts = k.ts GROUP BY k.job_id, k.ts""",
    "job_events",
)
def unique(t):
    return unique_within(t.job_events, "job_id", "ts", "event_id", 6 * 3600)


@query(
    "first_seen",
    """SELECT name, path, queue FROM (SELECT p_size, concat('q', CAST(p_size AS VARCHAR)) AS name, concat('f', CAST(p_partkey AS VARCHAR)) AS path, p_brand AS queue, p_partkey FROM part)
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY p_partkey) = 1""",
)
def first_seen(t):
    part = t.base("part").select(
        F.concat(F.lit("q"), F.col("p_size").cast("string")).alias("name"),
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"),
        F.col("p_brand").alias("queue"),
        "p_partkey",
    )
    return history.first_seen(part, ["name"], ["p_partkey"]).drop("p_partkey")


@query(
    "control_state",
    """WITH f AS (SELECT entity_kind, entity, CASE WHEN action = 'quiet' OR (action = 'resume' AND entity_kind = 'worker') THEN 'directive' WHEN action IN ('pause', 'resume') THEN 'paused'
          WHEN action IN ('override', 'clear') THEN 'override' ELSE action END AS field,
        CASE action WHEN 'pause' THEN 'true' WHEN 'quiet' THEN 'quiet' WHEN 'resume' THEN CASE WHEN entity_kind = 'worker' THEN 'none' ELSE 'false' END
          WHEN 'clear' THEN NULL ELSE CAST(amount AS VARCHAR) END AS value, ts, seq FROM control_log WHERE action <> 'reboot')
    SELECT entity_kind, entity, field, value, ts AS changed_at FROM f
    QUALIFY row_number() OVER (PARTITION BY entity_kind, entity, field ORDER BY ts DESC, seq DESC) = 1""",
    "control_log",
)
def control_state(t):
    return history.control_state(t.control_log)


@query(
    "control_rejects",
    "SELECT entity_kind, concat('unknown action: ', action) AS reason, count(*) AS n FROM control_log WHERE action = 'reboot' GROUP BY ALL",
    "control_log",
)
def control_rejects(t):
    return history.control_rejects(t.control_log).groupBy("entity_kind", "reason").agg(F.count("*").alias("n"))


@query(
    "start_to_finish",
    """WITH e AS (SELECT job_id, event_id, ts, type, last_value(CASE WHEN type = 'job.started' THEN ts END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM job_events)
    SELECT job_id, event_id, s AS started_at, ts AS finished_at, type AS outcome, round(date_diff('microsecond', s, ts) / 1000.0, 3) AS latency_ms
    FROM e WHERE type IN ('job.completed', 'job.failed') AND ts <= s + INTERVAL '1' HOUR""",
    "job_events",
)
def start_to_finish(t):
    return history.start_to_finish(t.job_events)
