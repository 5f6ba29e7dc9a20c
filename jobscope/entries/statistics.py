"""Queue, system, worker, audit and health queries."""

import datetime as dt

from pyspark.sql import functions as F

from jobscope.entries.registry import AS_OF, query
from jobscope.operators import audit, history, stats
from jobscope.sources.sinks import metrics_exposition

_PAUSED = """paused_flags AS (SELECT entity AS queue, arg_max(action, (ts, seq)) = 'pause' AS paused FROM control_log
  WHERE entity_kind = 'queue' AND action IN ('pause', 'resume') GROUP BY entity),
 queue_list AS (SELECT q.queue, coalesce(p.paused, false) AS paused FROM
  (SELECT DISTINCT queue FROM jobs UNION SELECT DISTINCT entity FROM control_log WHERE entity_kind = 'queue') q LEFT JOIN paused_flags p ON p.queue = q.queue)"""


def queue_list(t):
    """Queues of jobs and of the control log, with the paused flag."""
    named = t.control_log.filter("entity_kind = 'queue'").select(F.col("entity").alias("queue"))
    queues = t.jobs.select("queue").unionByName(named).distinct()
    return history.paused_queues(queues, history.control_state(t.control_log))


_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE state = '{s}') AS {n}"
    for s, n in [("available", "available"), ("active", "active"), ("completed", "completed"), ("retryable", "retryable"), ("scheduled", "scheduled"), ("discarded", "dead")]
)


@query("queue_stats", f"SELECT queue, {_COUNTS} FROM jobs GROUP BY queue", "jobs")
def queue_stats(t):
    return stats.queue_stats(t.jobs)


@query(
    "queue_view",
    f"""WITH {_PAUSED} SELECT j.queue, count(*) FILTER (WHERE state IN ('available', 'scheduled', 'retryable')) AS depth,
      count(*) FILTER (WHERE state = 'active') AS running, any_value(q.paused) AS paused
    FROM jobs j JOIN queue_list q ON q.queue = j.queue GROUP BY j.queue""",
    "jobs control_log",
)
def queue_view(t):
    return stats.queue_view(t.jobs, queue_list(t))


@query(
    "dashboard",
    f"""WITH {_PAUSED}, c AS (SELECT queue, {_COUNTS} FROM jobs GROUP BY queue)
    SELECT q.queue, q.paused, coalesce(available, 0) AS available, coalesce(active, 0) AS active, coalesce(scheduled, 0) AS scheduled,
      coalesce(retryable, 0) AS retryable, coalesce(dead, 0) AS dead FROM queue_list q LEFT JOIN c ON c.queue = q.queue""",
    "jobs control_log",
)
def dashboard(t):
    return stats.dashboard(queue_list(t), t.jobs)


@query(
    "export_stats",
    """SELECT 'total' AS "grouping", CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM jobs
    UNION ALL SELECT 'by_state', state, count(*) FROM jobs GROUP BY state
    UNION ALL SELECT 'by_queue', queue, count(*) FROM jobs GROUP BY queue""",
    "jobs",
)
def export_stats(t):
    return stats.export_stats(t.jobs)


@query(
    "dead_letter_stats",
    """WITH d AS (SELECT * FROM jobs WHERE state = 'discarded')
    SELECT 'total' AS "grouping", CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM d
    UNION ALL SELECT 'by_queue', queue, count(*) FROM d GROUP BY queue UNION ALL SELECT 'by_type', type, count(*) FROM d GROUP BY type""",
    "jobs",
)
def dead_letter_stats(t):
    return stats.dead_letter_stats(t.jobs)


_WORKER_STATE = """CASE WHEN last_heartbeat < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '5' MINUTE THEN 'stale' WHEN directive = 'quiet' THEN 'quiet' ELSE 'running' END"""


@query(
    "worker_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE s = 'running') AS running, count(*) FILTER (WHERE s = 'quiet') AS quiet,
      count(*) FILTER (WHERE s = 'stale') AS stale FROM (SELECT {_WORKER_STATE} AS s FROM workers)""",
    "workers",
)
def worker_summary(t):
    return stats.worker_summary(t.workers, AS_OF)


@query(
    "worker_list",
    f"""SELECT w.id, {_WORKER_STATE} AS state, directive, coalesce(a.n, 0) AS active_jobs, last_heartbeat, hostname, pid
    FROM workers w LEFT JOIN (SELECT worker_id, count(*) AS n FROM attempts WHERE state = 'failed' GROUP BY worker_id) a ON a.worker_id = w.id""",
    "workers attempts",
)
def worker_list(t):
    busy = t.attempts.filter("state = 'failed'").groupBy(F.col("worker_id").alias("id")).agg(F.count("*").alias("active_jobs"))
    return stats.worker_list(t.workers, busy, AS_OF)


_FLOW = """count(*) FILTER (WHERE type = 'job.enqueued') AS enqueued, count(*) FILTER (WHERE type = 'job.completed') AS completed,
  count(*) FILTER (WHERE type = 'job.failed') AS failed, CAST(round(CAST(CAST(sum(CAST(latency_ms AS DECIMAL(20, 6))) FILTER (WHERE type = 'job.completed') AS DOUBLE) / nullif(count(latency_ms) FILTER (WHERE type = 'job.completed'), 0) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS avg_latency_ms"""

_STATE_ROWS = " UNION ALL ".join(
    f"SELECT 'jobs' AS section, '{s}' AS metric, CAST(count(*) FILTER (WHERE state = '{s}') AS DOUBLE) AS value FROM jobs"
    for s in ["available", "active", "completed", "retryable", "scheduled", "discarded", "cancelled"]
)


@query(
    "stats_overview",
    f"""WITH {_PAUSED}, ws AS (SELECT {_WORKER_STATE} AS s FROM workers),
      m AS (SELECT {_FLOW} FROM job_events WHERE ts > TIMESTAMP '2024-01-15 11:59:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00')
    {_STATE_ROWS}
    UNION ALL SELECT 'queues', 'total', CAST(count(*) AS DOUBLE) FROM queue_list
    UNION ALL SELECT 'queues', 'active', CAST(count(*) FILTER (WHERE NOT paused) AS DOUBLE) FROM queue_list
    UNION ALL SELECT 'queues', 'paused', CAST(count(*) FILTER (WHERE paused) AS DOUBLE) FROM queue_list
    UNION ALL SELECT 'workers', 'total', CAST(count(*) AS DOUBLE) FROM ws
    UNION ALL SELECT 'workers', 'running', CAST(count(*) FILTER (WHERE s = 'running') AS DOUBLE) FROM ws
    UNION ALL SELECT 'workers', 'quiet', CAST(count(*) FILTER (WHERE s = 'quiet') AS DOUBLE) FROM ws
    UNION ALL SELECT 'workers', 'stale', CAST(count(*) FILTER (WHERE s = 'stale') AS DOUBLE) FROM ws
    UNION ALL SELECT 'throughput', 'enqueued_per_min', CAST(enqueued AS DOUBLE) FROM m
    UNION ALL SELECT 'throughput', 'completed_per_min', CAST(completed AS DOUBLE) FROM m
    UNION ALL SELECT 'throughput', 'failed_per_min', CAST(failed AS DOUBLE) FROM m
    UNION ALL SELECT 'throughput', 'avg_latency_ms', coalesce(avg_latency_ms, 0.0) FROM m""".replace("TIMESTAMP '2024-01-31 00:00:00'", "TIMESTAMP '2024-01-15 12:00:00'"),
    "jobs control_log workers job_events",
)
def stats_overview(t):
    noon = AS_OF.replace(day=15, hour=12)
    return stats.stats_overview(t.jobs, t.workers, t.job_events, queue_list(t), noon)


def _history(period: str, width: str, extra: str = ""):
    return f"""SELECT time_bucket(INTERVAL '{width}', ts, TIMESTAMP '2000-01-01') AS timestamp, {_FLOW} FROM job_events {extra} GROUP BY 1"""


@query("stats_history_5m", _history("5m", "5 minutes"), "job_events")
def history_5m(t):
    return stats.stats_history(t.job_events, "5m")


@query("stats_history_1h", _history("1h", "1 hour", "WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND queue = 'email'"), "job_events")
def history_1h(t):
    return stats.stats_history(t.job_events, "1h", since="7d", queue="email", as_of=AS_OF)


@query("stats_history_1d", _history("1d", "1 day"), "job_events")
def history_1d(t):
    return stats.stats_history(t.job_events, "1d")


_METRICS = f"""WITH {_PAUSED}, e AS (SELECT count(*) FILTER (WHERE type = 'job.enqueued') AS q, count(*) FILTER (WHERE type = 'job.completed') AS c,
      count(*) FILTER (WHERE type = 'job.failed') AS f, CAST(round(CAST(CAST(sum(CAST(latency_ms AS DECIMAL(20, 6))) FILTER (WHERE type = 'job.completed') AS DOUBLE) / nullif(count(latency_ms) FILTER (WHERE type = 'job.completed'), 0) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS l,
      CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS up FROM job_events),
    m AS (SELECT 'jobs_enqueued_total' AS metric, CAST(q AS DOUBLE) AS value FROM e UNION ALL SELECT 'jobs_completed_total', c FROM e
    UNION ALL SELECT 'jobs_failed_total', f FROM e UNION ALL SELECT 'avg_latency_ms', l FROM e UNION ALL SELECT 'uptime_seconds', up FROM e
    UNION ALL SELECT 'throughput_per_second', round(c / up, 6) FROM e
    UNION ALL SELECT 'jobs_active', count(*) FROM jobs WHERE state = 'active'
    UNION ALL SELECT 'queues_active', count(*) FROM queue_list WHERE NOT paused
    UNION ALL SELECT 'workers_active', count(*) FROM workers WHERE {_WORKER_STATE} = 'running')"""


@query("metrics", f"{_METRICS} SELECT metric, value FROM m", "jobs job_events workers control_log")
def metrics(t):
    return stats.metrics(t.jobs, t.job_events, t.workers, queue_list(t), AS_OF)


@query(
    "metrics_text",
    f"""{_METRICS} SELECT concat('jobqueue_', metric, ' ', CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE rtrim(CAST(CAST(value AS DECIMAL(38, 6)) AS VARCHAR), '0') END) AS value FROM m""",
    "jobs job_events workers control_log",
)
def metrics_text(t):
    return metrics_exposition(metrics(t), "jobqueue_")


@query(
    "bottleneck",
    """WITH d AS (SELECT queue, count(*) FILTER (WHERE state IN ('available', 'scheduled', 'retryable')) AS depth,
        CAST(round(CAST(CAST(sum(CAST(date_diff('microsecond', started_at, completed_at) AS DECIMAL(20, 3)) / 1000) AS DOUBLE) / nullif(count(completed_at), 0) AS DECIMAL(30, 10)), 4) AS DOUBLE) AS avg_duration_ms FROM jobs GROUP BY queue),
      e AS (SELECT queue, round(count(*) FILTER (WHERE type = 'job.failed') / nullif(count(*) FILTER (WHERE type IN ('job.failed', 'job.completed')), 0), 6) AS error_rate
        FROM job_events GROUP BY queue)
    SELECT d.queue, depth, avg_duration_ms, error_rate FROM d LEFT JOIN e ON d.queue = e.queue ORDER BY avg_duration_ms DESC, d.queue LIMIT 10""",
    "jobs job_events",
)
def bottleneck(t):
    return stats.bottleneck(t.jobs, t.job_events)


@query(
    "rate_limits",
    """SELECT l.key, l.concurrency, coalesce(a.n, 0) AS active, greatest(0, l.concurrency - coalesce(a.n, 0)) AS available, CAST(NULL AS INT) AS override
    FROM rate_limits l LEFT JOIN (SELECT queue, count(*) AS n FROM jobs WHERE state = 'active' GROUP BY queue) a ON a.queue = l.key""",
    "rate_limits jobs",
)
def rate_limits(t):
    return stats.rate_limits(t.rate_limits, t.jobs)


@query(
    "rate_limits_override",
    """WITH o AS (SELECT entity AS key, arg_max(CASE WHEN action = 'override' THEN amount ELSE -1 END, (ts, seq)) AS ov FROM control_log
        WHERE action IN ('override', 'clear') AND entity_kind = 'queue' GROUP BY entity),
      l AS (SELECT DISTINCT concat('e', CAST(user_id AS VARCHAR)) AS key, 2 AS concurrency FROM job_events),
      a AS (SELECT concat('e', CAST(substr(unique_key, 6) AS VARCHAR)) AS key, count(*) AS n FROM jobs WHERE state = 'active' GROUP BY 1)
    SELECT l.key, CASE WHEN coalesce(ov, -1) >= 0 THEN ov ELSE concurrency END AS concurrency, coalesce(n, 0) AS active,
      greatest(0, CASE WHEN coalesce(ov, -1) >= 0 THEN ov ELSE concurrency END - coalesce(n, 0)) AS available, CASE WHEN ov >= 0 THEN ov END AS override
    FROM l LEFT JOIN o ON o.key = l.key LEFT JOIN a ON a.key = l.key""",
    "control_log job_events jobs",
)
def rate_limits_override(t):
    limits = t.job_events.select(F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("key")).distinct().withColumn("concurrency", F.lit(2))
    overrides = history.control_state(t.control_log).filter("entity_kind = 'queue' AND field = 'override'")
    overrides = overrides.select(F.col("entity").alias("key"), F.col("value").cast("int").alias("override"))
    jobs = t.jobs.withColumn("queue", F.concat(F.lit("e"), F.substr("unique_key", F.lit(6))))
    return stats.rate_limits(limits, jobs, overrides)


@query(
    "health",
    """WITH c AS (SELECT queue, count(*) FILTER (WHERE type = 'job.failed') AS f, count(*) FILTER (WHERE type IN ('job.failed', 'job.completed')) AS d,
        quantile_cont(latency_ms, 0.95) AS p95 FROM job_events GROUP BY queue),
      h AS (SELECT queue, date_trunc('hour', ts) AS hr, count(*) FILTER (WHERE type = 'job.failed') AS n FROM job_events GROUP BY 1, 2),
      u AS (SELECT queue, avg(n) AS m, stddev_pop(n) AS s FROM h GROUP BY queue),
      r AS (SELECT (SELECT count(*) FROM c WHERE f / nullif(d, 0) > 0.05 OR p95 > 100) AS v, (SELECT count(*) FROM h JOIN u ON u.queue = h.queue WHERE n > m + 3 * s) AS a)
    SELECT greatest(0, 100 - 10 * v - 5 * a) AS score, CASE WHEN greatest(0, 100 - 10 * v - 5 * a) >= 80 THEN 'healthy'
      WHEN greatest(0, 100 - 10 * v - 5 * a) >= 50 THEN 'degraded' ELSE 'critical' END AS status, v AS slo_violations, a AS anomaly_count FROM r""",
    "job_events",
)
def health(t):
    return stats.health(t.job_events)


@query(
    "latency_p95",
    "SELECT queue, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM job_events GROUP BY queue",
    "job_events",
)
def latency_p95(t):
    return stats.exact_percentile(t.job_events, "queue", "latency_ms", 0.95, "p95").withColumn("p95", F.round("p95", 6))


@query(
    "latency_sketch",
    """WITH u AS (SELECT queue, latency_ms FROM job_events WHERE latency_ms IS NOT NULL AND ts >= TIMESTAMP '2024-01-08 00:00:00')
    SELECT queue, count(*) AS latencies, CAST(0.95 AS DOUBLE) AS share FROM u GROUP BY queue""",
    "job_events",
)
def latency_sketch(t):
    """The exact share of latencies up to each estimate is held against 0.95 and the stated error."""
    since = dt.datetime(2024, 1, 8)
    found = stats.latency_quantiles(stats.latency_sketches(t.job_events), 0.95, since=since)
    later = t.job_events.where(F.col("latency_ms").isNotNull() & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")))
    share = later.join(F.broadcast(found), "queue").groupBy("queue", "latencies").agg(F.avg((F.col("latency_ms") <= F.col("estimate")).cast("int")).alias("share"))
    near = F.when(F.abs(F.col("share") - 0.95) <= stats.RANK_ERROR, F.lit(0.95)).otherwise(F.col("share"))
    return share.select("queue", "latencies", F.round(near, 2).alias("share"))


@query(
    "audit_categories",
    """SELECT server, category, count(*) FILTER (WHERE severity = 'pass') AS passed, count(*) FILTER (WHERE severity = 'warning') AS warnings,
      count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) AS total FROM audit_checks GROUP BY server, category""",
    "audit_checks",
)
def audit_categories(t):
    return audit.audit_categories(t.audit_checks)


@query(
    "audit_report",
    """WITH s AS (SELECT server, CAST(sum(CASE severity WHEN 'pass' THEN 5 WHEN 'warning' THEN 3 WHEN 'info' THEN 4 WHEN 'skip' THEN 4 ELSE 0 END) AS BIGINT) AS score,
      count(*) * 5 AS max_score FROM audit_checks GROUP BY server)
    SELECT server, score, max_score, CASE WHEN score * 100 // max_score >= 90 THEN 'A' WHEN score * 100 // max_score >= 80 THEN 'B'
      WHEN score * 100 // max_score >= 70 THEN 'C' WHEN score * 100 // max_score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""",
    "audit_checks",
)
def audit_report(t):
    return audit.audit_report(t.audit_checks)


@query(
    "doctor_rollup",
    """WITH s AS (SELECT server, count(*) FILTER (WHERE severity = 'pass') AS passed, count(*) FILTER (WHERE severity = 'warning') AS warned,
      count(*) FILTER (WHERE severity = 'critical') AS failed FROM audit_checks GROUP BY server)
    SELECT *, CASE WHEN failed > 0 THEN 'FAIL' WHEN warned > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM s""",
    "audit_checks",
)
def doctor_rollup(t):
    return audit.doctor_rollup(t.audit_checks)


@query(
    "cron_detail",
    """SELECT name, count(*) AS run_count, max(scheduled_at) AS last_run_at, arg_max(job_id, (scheduled_at, job_id)) AS last_job_id,
      arg_max(state, (scheduled_at, job_id)) AS last_state FROM cron_runs GROUP BY name""",
    "cron_runs",
)
def cron_detail(t):
    return stats.cron_detail(t.cron_runs)


@query(
    "sub_stats",
    """SELECT s.id, s.url, s.active, coalesce(d.ok, 0) AS success_count, coalesce(d.bad, 0) AS failure_count, d.last AS last_delivery_at
    FROM subscriptions s LEFT JOIN (SELECT subscription_id, count(*) FILTER (WHERE success) AS ok, count(*) FILTER (WHERE NOT success) AS bad, max(delivered_at) AS last
      FROM deliveries GROUP BY subscription_id) d ON d.subscription_id = s.id""",
    "subscriptions deliveries",
)
def sub_stats(t):
    return stats.subscription_stats(t.subscriptions, t.deliveries)
