"""Contracts, workflows, subscriptions, mapping and reconciliation."""

from pyspark.sql import functions as F

from jobscope.entries.registry import query
from jobscope.operators import contracts, reconcile, stats, workflows
from jobscope.plans.validate import with_job_errors

# Service by service on purpose: the check does not use argument lists.
_PAIRS = """args AS (SELECT service, role, job_type, arg_name, arg_max(arg_type, ord) AS arg_type, arg_max(required, ord) AS required
    FROM all_contracts WHERE arg_name IS NOT NULL GROUP BY ALL),
  con AS (SELECT DISTINCT service, role, job_type FROM all_contracts),
  pairs AS (SELECT p.service AS ps, c.service AS cs, p.job_type FROM con p JOIN con c ON p.job_type = c.job_type AND p.role = 'producer' AND c.role = 'consumer'),
  errs AS (SELECT x.ps, x.cs, x.job_type, ca.arg_name, CASE WHEN pa.arg_name IS NULL THEN 'missing' ELSE 'type' END AS problem, pa.arg_type AS producer_type, ca.arg_type AS consumer_type
    FROM pairs x JOIN args ca ON ca.role = 'consumer' AND ca.service = x.cs AND ca.job_type = x.job_type
    LEFT JOIN args pa ON pa.role = 'producer' AND pa.service = x.ps AND pa.job_type = x.job_type AND pa.arg_name = ca.arg_name
    WHERE (pa.arg_name IS NULL AND ca.required) OR (pa.arg_name IS NOT NULL AND pa.arg_type <> ca.arg_type)),
  bad AS (SELECT DISTINCT ps, cs, job_type FROM errs),
  verdict AS (SELECT x.*, b.ps IS NULL AS passed FROM pairs x LEFT JOIN bad b ON b.ps = x.ps AND b.cs = x.cs AND b.job_type = x.job_type)"""


@query(
    "contract_cross",
    f"WITH {_PAIRS} SELECT job_type, cs AS consumer, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed FROM verdict GROUP BY job_type, cs",
    "all_contracts",
)
def contract_cross(t):
    return contracts.consumer_verdicts(t.all_contracts)


@query(
    "contract_arg_errors",
    f"WITH {_PAIRS} SELECT job_type, arg_name, problem, producer_type, consumer_type, count(*) AS pairs FROM errs GROUP BY ALL",
    "all_contracts",
)
def contract_arg_errors(t):
    return contracts.argument_errors(t.all_contracts)


def _with_orphans(t):
    """Contracts with some job types that only one side declares."""
    own = F.when(F.col("ord") % 7 == 0, F.concat("job_type", F.lit("."), "role")).otherwise(F.col("job_type"))
    return t.all_contracts.withColumn("job_type", own)


_ORPHANED = """contract_args2 AS (SELECT * REPLACE (CASE WHEN ord % 7 = 0 THEN concat(job_type, '.', role) ELSE job_type END AS job_type) FROM all_contracts)"""
_ORPHANS = """orphans AS (SELECT DISTINCT a.service, a.role, a.job_type, true AS passed, concat('no ', CASE a.role WHEN 'producer' THEN 'consumer' ELSE 'producer' END, ' contract found for this job type') AS warning
    FROM contract_args2 a WHERE NOT EXISTS (SELECT 1 FROM contract_args2 b WHERE b.job_type = a.job_type AND b.role <> a.role))"""


@query("contract_orphans", f"WITH {_ORPHANED}, {_ORPHANS} SELECT * FROM orphans", "all_contracts")
def contract_orphans(t):
    return contracts.orphans(_with_orphans(t))


@query(
    "contract_summary",
    f"""WITH {_ORPHANED}, {_ORPHANS}, {_PAIRS.replace('FROM all_contracts', 'FROM contract_args2')}
    SELECT (SELECT count(*) FROM verdict WHERE passed) + (SELECT count(*) FROM orphans) AS passed, (SELECT count(*) FROM verdict WHERE NOT passed) AS failed""",
    "all_contracts",
)
def contract_summary(t):
    return contracts.suite_summary(_with_orphans(t))


@query(
    "payload_check",
    """SELECT job_id, type, CAST(0 AS BIGINT) AS position, 'order' AS arg_name, 'int' AS arg_type, 'string' AS found FROM jobs WHERE type = 'email.send'
    UNION ALL SELECT job_id, type, 1, 'customer', 'string', 'int' FROM jobs WHERE type = 'report.generate'
    UNION ALL SELECT job_id, type, 2, 'extra', 'bool', 'missing' FROM jobs WHERE type = 'image.resize'""",
    "jobs",
)
def payload_check(t):
    """Each job type expects (order, customer); three types expect something the jobs do not carry."""
    def expected(position, name, arg_type, required):
        columns = {"position": F.lit(position).cast("bigint"), "arg_name": F.lit(name), "arg_type": arg_type, "required": required}
        return F.struct(*[c.alias(n) for n, c in columns.items()])

    types = t.jobs.select(F.col("type").alias("job_type")).distinct()
    expects = F.array(
        expected(0, "order", F.when(F.col("job_type") == "email.send", "int").otherwise("string"), F.lit(True)),
        expected(1, "customer", F.when(F.col("job_type") == "report.generate", "string").otherwise("number"), F.lit(True)),
        expected(2, "extra", F.lit("boolean"), F.col("job_type") == "image.resize"),
    )
    return contracts.check_payloads(t.jobs, types.select("job_type", F.inline(expects)))


@query(
    "workflow_steps",
    """SELECT s.workflow_id, s.step_id, s.depends_on, s.job_id, j.type, j.state, j.started_at, j.completed_at FROM workflow_steps s LEFT JOIN jobs j ON s.job_id = j.job_id""",
    "workflow_steps jobs",
)
def workflow_steps(t):
    return workflows.steps_with_jobs(t.workflow_steps, t.jobs)


_DEPTH = """WITH RECURSIVE d(workflow_id, step_id, depth, root) AS (SELECT workflow_id, step_id, CAST(0 AS BIGINT), step_id FROM workflow_steps WHERE depends_on IS NULL
      UNION ALL SELECT s.workflow_id, s.step_id, d.depth + 1, d.root FROM d JOIN workflow_steps s ON s.workflow_id = d.workflow_id AND s.depends_on = d.step_id)"""


@query("dag_closure", f"{_DEPTH} SELECT workflow_id, step_id, depth, root, false AS cyclic FROM d", "workflow_steps")
def dag_closure(t):
    return workflows.dependency_depth(t.workflow_steps)


# Steps that depend on the one before, often on an earlier one too, and in some workflows on a later one.
_EDGES = """SELECT workflow_id, step_id, unnest([depends_on, concat('step-', CAST(n - 1 - j % 4 AS VARCHAR)), CASE WHEN n = 2 AND w % 50 = 0 THEN 'step-4' END]) AS depends_on FROM numbered"""


@query(
    "dag_levels",
    f"""WITH RECURSIVE numbered AS (SELECT *, CAST(substr(step_id, 6) AS BIGINT) AS n, CAST(substr(job_id, 5) AS BIGINT) AS j, CAST(substr(workflow_id, 4) AS BIGINT) AS w FROM workflow_steps),
      edges AS ({_EDGES}), sizes AS (SELECT workflow_id, count(*) AS steps FROM workflow_steps GROUP BY 1),
      paths AS (SELECT workflow_id, step_id, 0 AS depth FROM workflow_steps
        UNION SELECT e.workflow_id, e.step_id, p.depth + 1 FROM paths p JOIN edges e ON e.workflow_id = p.workflow_id AND e.depends_on = p.step_id JOIN sizes z ON z.workflow_id = p.workflow_id
          WHERE p.depth < z.steps)
    SELECT p.workflow_id, p.step_id, CAST(CASE WHEN max(p.depth) < any_value(z.steps) THEN max(p.depth) END AS INTEGER) AS level
    FROM paths p JOIN sizes z ON z.workflow_id = p.workflow_id GROUP BY ALL""",
    "workflow_steps",
)
def dag_levels(t):
    part = lambda c, at: F.substring(c, at, 20).cast("bigint")
    n, j, w = part("step_id", 6), part("job_id", 5), part("workflow_id", 4)
    earlier = F.concat(F.lit("step-"), (n - 1 - j % 4).cast("string"))
    later = F.when((n == 2) & (w % 50 == 0), "step-4")
    return workflows.dependency_levels(t.workflow_steps.select("workflow_id", "step_id", F.explode(F.array("depends_on", earlier, later)).alias("depends_on")))


@query(
    "sub_match",
    """SELECT s.id, s.url, x.type, count(e.event_id) AS events, min(e.ts) AS first_at, max(e.ts) AS last_at
    FROM subscriptions s, unnest(string_split(s.events_csv, ',')) x(type), (SELECT * FROM job_events) e WHERE s.active AND x.type <> '' AND e.type = x.type GROUP BY 1, 2, 3""",
    "subscriptions job_events",
)
def sub_match(t):
    return stats.match_subscriptions(subscriptions_with_lists(t), t.job_events)


def subscriptions_with_lists(t):
    from jobscope.functions import split_list

    return t.subscriptions.withColumn("events", split_list("events_csv"))


@query(
    "reconcile",
    """SELECT coalesce(s.job_id, x.job_id) AS job_id, CASE WHEN x.job_id IS NULL THEN 'missing' WHEN s.job_id IS NULL THEN 'extra'
      WHEN s.type = x.type AND s.queue = x.queue AND s.args_json = x.args_json THEN 'matched' ELSE 'changed' END AS status
    FROM jobs s FULL JOIN target_jobs x ON s.job_id = x.job_id""",
    "jobs target_jobs",
)
def reconcile_jobs(t):
    return reconcile.reconcile(t.jobs, t.target_jobs)


# The target without a few jobs, with a few changed ones and one more.
_NEARLY = "SELECT CASE job_id WHEN 'job-1' THEN 'job-x' ELSE job_id END AS job_id, CASE WHEN job_id IN ('job-2', 'job-35') THEN 'other' ELSE type END AS type, queue, args_json FROM jobs WHERE job_id <> 'job-3'"


@query(
    "reconcile_ranges",
    f"""WITH nearly AS ({_NEARLY})
    SELECT coalesce(s.job_id, x.job_id) AS job_id, CASE WHEN x.job_id IS NULL THEN 'missing' WHEN s.job_id IS NULL THEN 'extra' ELSE 'changed' END AS status
    FROM jobs s FULL JOIN nearly x ON s.job_id = x.job_id WHERE s.job_id IS NULL OR x.job_id IS NULL OR s.type <> x.type""",
    "jobs",
)
def reconcile_ranges(t):
    t.jobs.createOrReplaceTempView("jobs")
    return reconcile.reconcile_ranges(t.jobs, t.spark.sql(_NEARLY))


@query(
    "apply_mapping",
    """SELECT job_id, CASE type WHEN 'email.send' THEN 'mail.deliver' WHEN 'report.generate' THEN 'report.build' ELSE type END AS type,
      CASE queue WHEN 'email' THEN 'mail' WHEN 'reports' THEN 'analytics' ELSE queue END AS queue FROM jobs""",
    "jobs",
)
def apply_mapping(t):
    return reconcile.apply_mapping(t.jobs.select("job_id", "type", "queue"), t.type_mapping)


@query(
    "import_result",
    """SELECT count(*) AS total, count(*) FILTER (WHERE raw <> '{bad') AS success, count(*) FILTER (WHERE raw = '{bad') AS failed,
      CAST(ceil(count(*) FILTER (WHERE raw <> '{bad') / 100) AS BIGINT) AS batches FROM ndjson_lines WHERE raw <> ''""",
    "ndjson_lines",
)
def import_result(t):
    lines = with_job_errors(t.ndjson_lines)
    unreadable = F.exists("errors", lambda e: (e == "invalid JSON") | e.startswith("bad type"))
    return reconcile.import_result(lines, ~unreadable)


@query(
    "migration_stats",
    """WITH r AS (SELECT run_id, count(*) FILTER (WHERE event = 'exported') AS exported, count(*) FILTER (WHERE event = 'imported') AS imported,
      count(*) FILTER (WHERE event = 'verified') AS verified, count(*) FILTER (WHERE event = 'error') AS errors, min(ts) AS started_at, max(ts) AS last_at,
      arg_max(event, (ts, seq, event)) AS last FROM migration_log GROUP BY run_id)
    SELECT run_id, exported, imported, verified, errors, started_at, last_at, CASE WHEN exported + imported + verified = 0 THEN 'failed' WHEN last = 'exported' THEN 'exporting'
      WHEN last = 'verified' THEN CASE WHEN verified >= imported THEN 'complete' ELSE 'verifying' END ELSE 'importing' END AS phase FROM r""",
    "migration_log",
)
def migration_stats(t):
    return reconcile.migration_stats(t.migration_log)
