"""Search, status, purge, bulk and enqueue queries."""

from pyspark.sql import functions as F

from jobscope.entries.registry import AS_OF, query
from jobscope.operators import lifecycle, search
from jobscope.operators.workflows import workflow_list, workflow_states


@query(
    "search_jobs",
    """SELECT job_id, type, queue, state, priority, attempt, created_at,
      (SELECT count(*) FROM jobs WHERE state = 'available' AND queue = 'billing') AS total
    FROM jobs WHERE state = 'available' AND queue = 'billing' ORDER BY created_at DESC, job_id LIMIT 25""",
    "jobs",
)
def search_jobs(t):
    return search.search_jobs(t.jobs, state="available", queue="billing").with_total()


@query(
    "recent_failures",
    """SELECT left(job_id, 12) AS id, type, queue, CASE WHEN length(error) > 60 THEN left(error, 57) || '...' ELSE error END AS error
    FROM jobs WHERE state = 'discarded' ORDER BY created_at DESC, job_id LIMIT 20""",
    "jobs",
)
def recent_failures(t):
    return search.recent_failures(t.jobs)


@query(
    "dead_letter",
    """SELECT job_id, type, queue, attempt AS attempts, completed_at AS discarded_at, (SELECT count(*) FROM jobs WHERE state = 'discarded') AS total
    FROM jobs WHERE state = 'discarded' ORDER BY completed_at DESC, job_id LIMIT 25""",
    "jobs",
)
def dead_letter(t):
    return search.dead_letter(t.jobs).with_total()


def _outcome(result):
    kept = result.kept.select("job_id", F.lit("kept").alias("outcome"))
    return kept.unionByName(result.deleted.select("job_id", F.lit("deleted").alias("outcome")))


@query(
    "purge_dead",
    """SELECT job_id, CASE WHEN state = 'discarded' AND coalesce(completed_at, created_at) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '9000' DAY
      THEN 'deleted' ELSE 'kept' END AS outcome FROM jobs""",
    "jobs",
)
def purge_dead(t):
    return _outcome(lifecycle.purge(t.jobs, AS_OF, states=["discarded"], older_than="9000d"))


@query(
    "purge_states",
    """SELECT job_id, CASE WHEN state IN ('completed', 'cancelled') AND queue = 'email' THEN 'deleted' ELSE 'kept' END AS outcome FROM jobs""",
    "jobs",
)
def purge_states(t):
    return _outcome(lifecycle.purge(t.jobs, AS_OF, states=["completed", "cancelled"], queue="email"))


@query(
    "bulk_cancel",
    """SELECT i.job_id, j.state AS old_state, coalesce(j.state IN ('available', 'active', 'retryable', 'scheduled'), false) AS done
    FROM (SELECT DISTINCT job_id FROM job_events UNION SELECT DISTINCT id FROM workers) i LEFT JOIN jobs j ON i.job_id = j.job_id""",
    "jobs job_events workers",
)
def bulk_cancel(t):
    ids = t.job_events.select("job_id").unionByName(t.workers.select(F.col("id").alias("job_id")))
    return lifecycle.bulk_transition(t.jobs, "cancel", ids=ids).outcomes


@query(
    "bulk_retry",
    """SELECT job_id, CASE WHEN state = 'discarded' AND queue = 'email' THEN 'available' ELSE state END AS state FROM jobs""",
    "jobs",
)
def bulk_retry(t):
    return lifecycle.bulk_transition(t.jobs, "retry", state="discarded", queue="email").snapshot.select("job_id", "state")


@query(
    "bulk_retry_ids",
    """SELECT j.job_id, CASE WHEN a.job_id IS NOT NULL AND state IN ('discarded', 'retryable', 'cancelled') THEN 'available' ELSE state END AS state
    FROM jobs j LEFT JOIN (SELECT DISTINCT job_id FROM attempts WHERE state = 'failed') a ON a.job_id = j.job_id""",
    "jobs attempts",
)
def bulk_retry_ids(t):
    ids = t.attempts.filter("state = 'failed'").select("job_id")
    return lifecycle.bulk_transition(t.jobs, "retry", ids=ids).snapshot.select("job_id", "state")


@query(
    "bulk_delete",
    """SELECT count(*) FILTER (WHERE state = 'completed') AS done, count(*) FILTER (WHERE state <> 'completed') AS failed
    FROM jobs WHERE state = 'completed' AND coalesce(completed_at, created_at) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '9200' DAY""",
    "jobs",
)
def bulk_delete(t):
    return lifecycle.bulk_transition(t.jobs, "delete", state="completed", older_than="9200d", as_of=AS_OF).counts


@query(
    "bulk_delete_ids",
    """WITH ids AS (SELECT DISTINCT job_id FROM attempts WHERE state = 'failed' UNION SELECT concat('ghost-', CAST(n_nationkey AS VARCHAR)) FROM nation)
    SELECT count(*) FILTER (WHERE coalesce(state IN ('completed', 'discarded', 'cancelled'), false)) AS done,
      count(*) FILTER (WHERE NOT coalesce(state IN ('completed', 'discarded', 'cancelled'), false)) AS failed FROM ids LEFT JOIN jobs USING (job_id)""",
    "jobs attempts",
)
def bulk_delete_ids(t):
    """Jobs at work and ids that do not exist cannot be deleted."""
    ids = t.attempts.filter("state = 'failed'").select("job_id").union(t.base("nation").select(F.concat(F.lit("ghost-"), F.col("n_nationkey").cast("string"))))
    return lifecycle.bulk_transition(t.jobs, "delete", ids=ids).counts


@query(
    "importable",
    """SELECT count(*) FILTER (WHERE state IN ('available', 'scheduled', 'retryable')) AS importable,
      count(*) FILTER (WHERE state NOT IN ('available', 'scheduled', 'retryable')) AS skipped FROM jobs""",
    "jobs",
)
def importable(t):
    return search.importable(t.jobs)[1]


@query(
    "export_select",
    """SELECT job_id, state, queue FROM jobs WHERE state NOT IN ('completed', 'cancelled') AND queue IN ('email', 'billing')
      AND created_at >= TIMESTAMP '1997-01-01 00:00:00'""",
    "jobs",
)
def export_select(t):
    since = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    chosen = search.select_for_export(t.jobs, queues=["email", "billing"], since=since, include_dead_letter=True)
    return chosen.select("job_id", "state", "queue")


@query("cron_list", "SELECT name, expression, enabled, job_type FROM cron_jobs WHERE enabled", "cron_jobs")
def cron_list(t):
    return search.cron_list(t.cron_jobs, enabled=True)


_STATES = """SELECT s.workflow_id, count(*) AS step_count,
      CASE WHEN count(*) FILTER (WHERE j.state IN ('discarded', 'cancelled')) > 0 THEN 'failed'
        WHEN count(*) FILTER (WHERE j.state = 'completed') = count(*) THEN 'completed' ELSE 'running' END AS state
    FROM workflow_steps s LEFT JOIN jobs j ON s.job_id = j.job_id GROUP BY s.workflow_id"""


@query("workflow_states", _STATES, "workflow_steps jobs")
def all_workflow_states(t):
    return workflow_states(t.workflow_steps, t.jobs)


@query(
    "workflow_list",
    f"""WITH st AS ({_STATES}) SELECT workflow_id, step_count, state, (SELECT count(*) FROM st WHERE state = 'failed') AS total
    FROM st WHERE state = 'failed' ORDER BY workflow_id LIMIT 25""",
    "workflow_steps jobs",
)
def list_workflows(t):
    return workflow_list(workflow_states(t.workflow_steps, t.jobs), state="failed").with_total()


@query(
    "job_status",
    """SELECT j.job_id, j.type, j.state, j.queue, j.attempt, j.priority, j.created_at, j.completed_at, j.error, j.args_json, j.started_at,
      CASE WHEN p.progress IS NOT NULL THEN printf('%d%%', CAST(round_even(p.progress * 100, 0) AS INT)) END AS progress
    FROM jobs j JOIN job_progress p ON j.job_id = p.job_id""",
    "jobs job_progress",
)
def job_status(t):
    progress = t.job_progress.select("job_id", "progress")
    return search.job_status(t.jobs.join(progress, "job_id", "left"), progress, detail=True)


@query(
    "job_result",
    """SELECT j.job_id, j.state, p.result, j.error, j.completed_at FROM jobs j JOIN job_progress p ON j.job_id = p.job_id""",
    "jobs job_progress",
)
def job_result(t):
    results = t.job_progress.select("job_id", "result")
    return search.job_result(t.jobs.join(results, "job_id", "left"), results)


@query(
    "replay",
    """SELECT concat('replay-', job_id) AS job_id, job_id AS replayed_from, type, 'low' AS queue, priority, args_json, 'available' AS state
    FROM jobs WHERE job_id IN (SELECT job_id FROM job_events)""",
    "jobs job_events",
)
def replay(t):
    return lifecycle.replay(t.jobs, t.job_events, queue="low", new_id=F.concat(F.lit("replay-"), F.col("job_id")))


@query(
    "apply_priority",
    """SELECT j.job_id, coalesce(u.p, j.priority) AS priority FROM jobs j LEFT JOIN
      (SELECT job_id, max(CAST(floor(latency_ms) AS INT)) AS p FROM job_events WHERE CAST(floor(latency_ms) AS INT) BETWEEN 0 AND 255 GROUP BY job_id) u
      ON j.job_id = u.job_id""",
    "jobs job_events",
)
def apply_priority(t):
    updates = t.job_events.select("job_id", F.floor("latency_ms").cast("int").alias("new_priority"))
    return lifecycle.apply_priority(t.jobs, updates)[0].select("job_id", "priority")


@query(
    "normalise_enqueue",
    """SELECT seq, type, coalesce(args, '[]') AS args, coalesce(queue, 'default') AS queue, CASE WHEN priority > 0 THEN priority END AS priority,
      CASE WHEN max_attempts > 0 THEN max_attempts END AS max_attempts, unique_key,
      CASE WHEN unique_key IS NOT NULL AND unique_within = '5m' THEN CAST(300 AS BIGINT) END AS unique_seconds
    FROM enqueue_requests WHERE type IS NOT NULL AND coalesce(args, '') <> '{bad'""",
    "enqueue_requests",
)
def normalise_enqueue(t):
    return lifecycle.normalise_enqueue(t.enqueue_requests)[0]


@query(
    "enqueue_rejects",
    """SELECT seq, CASE WHEN type IS NULL THEN 'type is required' ELSE 'invalid args JSON' END AS reason
    FROM enqueue_requests WHERE type IS NULL OR coalesce(args, '') = '{bad'""",
    "enqueue_requests",
)
def enqueue_rejects(t):
    return lifecycle.normalise_enqueue(t.enqueue_requests)[1]
