"""The job-queue entities as views over the shared parquet tables.

``VIEWS`` holds one SELECT per entity.  The text runs on Spark and, prefixed as common table expressions,
on any ANSI engine, so a query and its check read the same rows.  ``attempts`` and ``workflow_steps``
need a position within a key; Spark builds those two with the skew-safe helpers instead of the SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.operators.ordered import with_row_number

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
AS_OF = "2024-01-31 00:00:00"

_QUEUE = "CASE {0} % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'billing' WHEN 2 THEN 'email' ELSE 'reports' END"
_STARTED = "o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400 + o_custkey % 600)"
_RN = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"

VIEWS: dict[str, str] = {
    "jobs": f"""
SELECT concat('job-', CAST(o_orderkey AS STRING)) AS job_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'payment.charge' WHEN '2-HIGH' THEN 'email.send'
    WHEN '3-MEDIUM' THEN 'report.generate' WHEN '4-NOT SPECIFIED' THEN 'image.resize' ELSE 'cleanup.run' END AS type,
  {_QUEUE.format('o_custkey')} AS queue,
  CASE WHEN o_orderstatus = 'P' THEN 'active'
    WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 10 < 7 THEN 'completed' WHEN o_orderkey % 10 < 9 THEN 'discarded' ELSE 'cancelled' END
    ELSE CASE WHEN o_orderkey % 10 < 6 THEN 'available' WHEN o_orderkey % 10 < 8 THEN 'scheduled' ELSE 'retryable' END END AS state,
  CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
  CAST(o_orderkey % 4 + 1 AS INT) AS attempt, 4 AS max_attempts,
  o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400) AS created_at,
  CASE WHEN o_orderstatus <> 'O' THEN {_STARTED} END AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN {_STARTED} + INTERVAL '1' SECOND * (o_orderkey % 300 + 1) END AS completed_at,
  CASE WHEN (o_orderstatus = 'F' AND o_orderkey % 10 IN (7, 8)) OR (o_orderstatus = 'O' AND o_orderkey % 10 >= 8)
    THEN CASE o_orderkey % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connection refused by upstream while sending the payload to the remote worker' ELSE 'validation failed' END END AS error,
  concat('cust-', CAST(o_custkey AS STRING)) AS unique_key,
  concat('["order-', CAST(o_orderkey AS STRING), '",', CAST(o_custkey AS STRING), ']') AS args_json
FROM orders""",
    "job_events": f"""
SELECT event_id, ts, concat('job-', CAST(user_id AS STRING)) AS job_id, user_id,
  CASE event_type WHEN 'signup' THEN 'job.enqueued' WHEN 'view' THEN 'job.started' WHEN 'click' THEN 'job.progress'
    WHEN 'purchase' THEN 'job.completed' ELSE 'job.failed' END AS type,
  {_QUEUE.format('user_id')} AS queue, value AS latency_ms, props
FROM events""",
    "attempts": """
SELECT concat('job-', CAST(l_orderkey AS STRING)) AS job_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS attempt,
  CASE l_returnflag WHEN 'N' THEN 'completed' ELSE 'failed' END AS state,
  l_shipdate AS started_at,
  CASE WHEN l_returnflag <> 'N' THEN l_shipdate + INTERVAL '1' SECOND * CAST(l_quantity AS INT) END AS failed_at,
  CASE l_returnflag WHEN 'R' THEN 'timeout' WHEN 'A' THEN 'validation failed' END AS error,
  concat('worker-', CAST(l_suppkey AS STRING)) AS worker_id
FROM lineitem""",
    "workers": f"""
SELECT concat('worker-', CAST(s_suppkey AS STRING)) AS id,
  CASE WHEN s_nationkey % 5 = 0 THEN 'quiet' ELSE 'none' END AS directive,
  concat('host-', CAST(s_nationkey AS STRING)) AS hostname,
  CAST(1000 + s_suppkey AS INT) AS pid,
  TIMESTAMP_NTZ '{AS_OF}' - INTERVAL '1' MINUTE * (s_suppkey * 7 % 120) AS last_heartbeat
FROM supplier""",
    "contract_args": """
SELECT p_brand AS service, CASE WHEN p_partkey % 2 = 0 THEN 'producer' ELSE 'consumer' END AS role, p_type AS job_type,
  concat('arg', CAST(p_size % 5 AS STRING)) AS arg_name,
  CASE p_size % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'int' ELSE 'float' END AS arg_type,
  p_partkey % 3 <> 0 AS required, p_partkey AS ord
FROM part""",
    # Some contracts declare no arguments: one row with a null name.
    "all_contracts": """
SELECT p_brand AS service, CASE WHEN p_partkey % 2 = 0 THEN 'producer' ELSE 'consumer' END AS role, p_type AS job_type,
  concat('arg', CAST(p_size % 5 AS STRING)) AS arg_name,
  CASE p_size % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'int' ELSE 'float' END AS arg_type,
  p_partkey % 3 <> 0 AS required, p_partkey AS ord
FROM part
UNION ALL
SELECT concat(p_brand, '-bare') AS service, CASE WHEN p_partkey % 2 = 0 THEN 'producer' ELSE 'consumer' END AS role, p_type AS job_type,
  CAST(NULL AS STRING) AS arg_name, CAST(NULL AS STRING) AS arg_type, CAST(NULL AS BOOLEAN) AS required, p_partkey AS ord
FROM part WHERE p_partkey % 5 = 0""",
    "raw_sidekiq": """
SELECT o_orderkey AS seq, concat('queue:q', CAST(o_custkey % 4 AS STRING)) AS redis_key,
  CASE WHEN o_orderkey % 17 = 0 THEN '{bad' ELSE
  concat('{"class":"', CASE o_orderkey % 4 WHEN 0 THEN 'EmailWorker' WHEN 1 THEN 'Mailers::WelcomeEmail' WHEN 2 THEN 'HTTPServer' ELSE 'HardWorker' END,
   '","args":[', CAST(o_custkey AS STRING), '],', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('"queue":"q', CAST(o_custkey % 4 AS STRING), '",') END,
   '"retry":true,"jid":"j', CAST(o_orderkey AS STRING), '"', CASE WHEN o_orderkey % 5 = 0 THEN concat(',"at":', CAST(1700000000 + o_orderkey AS STRING)) ELSE '' END, '}') END AS payload
FROM orders""",
    "raw_bullmq": """
SELECT o_orderkey AS seq, concat('q', CAST(o_custkey % 4 AS STRING)) AS queue, CAST(o_orderkey AS STRING) AS id,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CASE o_orderkey % 3 WHEN 0 THEN 'email.send' WHEN 1 THEN 'report.generate' ELSE 'image.resize' END END AS name,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN concat('[', CAST(o_custkey AS STRING), ']') ELSE concat('{"cust":', CAST(o_custkey AS STRING), '}') END AS data,
  concat('{"delay":', CAST(o_orderkey % 4 * 1000 AS STRING), ',"priority":', CAST(o_orderkey % 5 AS STRING), '}') AS opts
FROM orders""",
    "raw_celery": """
SELECT o_orderkey AS seq, CASE WHEN o_custkey % 3 = 0 THEN 'celery' ELSE 'reports' END AS queue,
  concat('{"body":"', CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('!', CAST(o_custkey AS STRING))
    ELSE base64(CAST(concat('[["a",', CAST(o_custkey AS STRING), '],{"k":', CAST(o_orderkey AS STRING), '},{}]') AS BINARY)) END,
   '","headers":{', CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('"task":"app.tasks.t', CAST(o_orderkey % 5 AS STRING), '",') END, '"id":"t', CAST(o_orderkey AS STRING), '"}}') AS payload
FROM orders""",
    "raw_faktory": """
SELECT o_orderkey AS seq, concat('q', CAST(o_custkey % 4 AS STRING)) AS list_queue,
  concat('{"jid":"f', CAST(o_orderkey AS STRING), '","jobtype":"Type', CAST(o_orderkey % 5 AS STRING), '","args":[', CAST(o_custkey AS STRING), ']',
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(',"queue":"q', CAST(o_custkey % 4 AS STRING), '"') END, ',"priority":', CAST(o_orderkey % 4 AS STRING),
  CASE WHEN o_orderkey % 5 = 0 THEN ',"at":"2025-01-15T10:30:00Z"' ELSE '' END, CASE WHEN o_orderkey % 6 = 0 THEN ',"custom":{"tenant":"t1"}' ELSE '' END, '}') AS payload
FROM orders""",
    "raw_river": """
SELECT o_orderkey AS seq, concat('river:queue:q', CAST(o_custkey % 4 AS STRING)) AS redis_key,
  concat('{"id":', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat(',"kind":"kind_', CAST(o_orderkey % 5 AS STRING), '"') END,
  ',"args":{"cust":', CAST(o_custkey AS STRING), '}', CASE WHEN o_orderkey % 2 = 0 THEN ',"queue":"own"' ELSE '' END, ',"state":"available","priority":', CAST(o_orderkey % 5 AS STRING), '}') AS payload
FROM orders""",
    "ndjson_lines": """
SELECT o_orderkey AS line, CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN '{bad' WHEN 2 THEN '{"queue":"q1","args":[1]}' WHEN 3 THEN '{"type":"a.b","args":[1]}'
  WHEN 4 THEN '{"type":"a.b","queue":"q1"}' WHEN 5 THEN '{"type":"a.b","queue":"q1","args":{"x":1}}' WHEN 6 THEN '{"type":"a.b","queue":"q1","args":[1],"priority":-1}'
  WHEN 7 THEN '{}' WHEN 8 THEN '{"type":"a.b","queue":"q1","args":null}'
  ELSE concat('{"type":"a.b","queue":"q', CAST(o_custkey % 4 AS STRING), '","args":[', CAST(o_custkey AS STRING), '],"priority":', CAST(o_orderkey % 3 AS STRING), '}') END AS raw
FROM orders""",
    "cron_runs": """
SELECT concat('cron-', CAST(o_custkey % 20 AS STRING)) AS name, concat('job-', CAST(o_orderkey AS STRING)) AS job_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'active' ELSE 'failed' END AS state, o_orderdate AS scheduled_at,
  o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 30) AS started_at,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 30 + 60) END AS completed_at
FROM orders""",
    "cron_jobs": """
SELECT concat('cron-', CAST(c_custkey AS STRING)) AS name, concat(CAST(c_custkey % 60 AS STRING), ' * * * *') AS expression,
  c_acctbal > 0 AS enabled, CASE c_nationkey % 3 WHEN 0 THEN 'report.generate' WHEN 1 THEN 'cleanup.run' ELSE 'email.send' END AS job_type
FROM customer""",
    "workflow_steps": f"""
SELECT concat('wf-', CAST(o_custkey AS STRING)) AS workflow_id,
  concat('step-', CAST({_RN} AS STRING)) AS step_id,
  concat('job-', CAST(o_orderkey AS STRING)) AS job_id,
  CASE WHEN {_RN} > 1
    THEN concat('step-', CAST({_RN} - 1 - CASE WHEN o_orderkey % 3 = 0 AND {_RN} > 2 THEN 1 ELSE 0 END AS STRING)) END AS depends_on
FROM orders""",
    "subscriptions": """
SELECT concat('sub-', CAST(c_custkey AS STRING)) AS id, concat('https://h', CAST(c_custkey AS STRING), '.example/hook') AS url,
  CASE c_nationkey % 3 WHEN 0 THEN 'job.completed,job.failed' WHEN 1 THEN 'job.failed' ELSE 'job.enqueued,,job.started' END AS events_csv, c_acctbal > 0 AS active
FROM customer""",
    "deliveries": """
SELECT concat('sub-', CAST(user_id AS STRING)) AS subscription_id, ts AS delivered_at, event_type <> 'error' AS success
FROM events""",
    "rate_limits": f"""
SELECT DISTINCT {_QUEUE.format('user_id')} AS key, CAST(1000 * (user_id % 4 + 1) AS INT) AS concurrency
FROM events""",
    "control_log": """
SELECT event_id AS seq, ts, CASE WHEN user_id % 2 = 0 THEN 'queue' ELSE 'worker' END AS entity_kind, concat('e', CAST(user_id AS STRING)) AS entity,
  CASE event_type WHEN 'click' THEN CASE WHEN user_id % 2 = 0 THEN 'pause' ELSE 'quiet' END WHEN 'view' THEN 'resume' WHEN 'signup' THEN 'override' WHEN 'error' THEN 'clear'
    ELSE CASE user_id % 6 WHEN 0 THEN 'concurrency' WHEN 2 THEN 'max_size' WHEN 4 THEN 'retention' WHEN 3 THEN 'reboot' ELSE 'config' END END AS action,
  CAST(floor(value) AS INT) AS amount
FROM events""",
    "audit_checks": """
SELECT concat('server-', CAST(l_suppkey AS STRING)) AS server, l_orderkey * 10 + l_linenumber AS check_id,
  CASE l_linenumber % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'compliance' WHEN 2 THEN 'operations' WHEN 3 THEN 'observability' ELSE 'reliability' END AS category,
  CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' WHEN 3 THEN 'skip' ELSE 'pass' END AS severity
FROM lineitem""",
    "source_files": """
SELECT concat('repo', CAST(p_partkey % 10 AS STRING), '/f', CAST(p_partkey AS STRING)) AS path,
  CASE p_partkey % 4
   WHEN 0 THEN concat('class Job', CAST(p_partkey AS STRING), 'Worker', chr(10), '  include Sidekiq::Worker', chr(10), repeat('  # a note above the options', 12), chr(10), '  sidekiq_options queue: :', CASE WHEN p_size % 2 = 0 THEN 'mailer' ELSE 'low' END, ', retry: 5', chr(10), 'end', chr(10), 'class Next', CAST(p_partkey AS STRING), 'Worker', chr(10), '  include Sidekiq::Worker', chr(10), 'end')
   WHEN 1 THEN concat('const w = new Worker("q', CAST(p_size AS STRING), '", fn);', chr(10), 'await q.add("job', CAST(p_size AS STRING), '", {})')
   WHEN 2 THEN concat('@shared_task', chr(10), 'def next_', CAST(p_partkey AS STRING), '(x):', chr(10), '    pass', chr(10), '@shared_task(queue="q', CAST(p_size AS STRING), '")', chr(10), 'def task_', CAST(p_partkey AS STRING), '(x):', chr(10), '    pass')
   ELSE concat('with DAG("dag', CAST(p_partkey AS STRING), '") as dag:', chr(10), '  a = BashOperator(', chr(10), '    task_id="extract_data",', chr(10), '  )', chr(10), '  b = PythonOperator(', chr(10), '    task_id="load_data",', chr(10), '  )', chr(10), '  c = BashOperator(', chr(10), '    task_id="check",', chr(10), '  )', chr(10), '  a >> b >> c') END AS content
FROM part""",
    "workflow_code": """
SELECT concat('wf/f', CAST(p_partkey AS STRING), '.go') AS path,
  concat('package wf', chr(10), 'func Order', CAST(p_partkey AS STRING), 'Flow(ctx workflow.Context) error {', chr(10),
    '  workflow.ExecuteActivity(ctx, ValidateOrder)', chr(10),
    CASE WHEN p_size % 3 = 0 THEN concat('  workflow.Go(ctx, func(c workflow.Context) {', chr(10), '  })', chr(10)) ELSE '' END,
    CASE WHEN p_size % 4 = 0 THEN concat('  workflow.ExecuteChildWorkflow(ctx, ShipSize', CAST(p_size AS STRING), ')', chr(10)) ELSE '' END,
    '}', chr(10),
    'func Audit', CAST(p_partkey AS STRING), '(ctx workflow.Context) error {', chr(10),
    CASE WHEN p_size % 2 = 0 THEN concat('  workflow.ExecuteActivity(ctx, WriteAudit)', chr(10)) ELSE '' END, '}') AS content
FROM part""",
    "celery_configs": """
SELECT concat('cfg/', CAST(p_partkey AS STRING), '.json') AS path,
  concat('{"task_routes":{"app.t', CAST(p_size AS STRING), '":{"queue":"', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('q', CAST(p_size % 4 AS STRING)) END,
    '"},"app.base":{"queue":"low"}},"task_annotations":{"app.t', CAST(p_size AS STRING), '":{"max_retries":', CAST(p_size % 4 AS STRING),
    CASE WHEN p_partkey % 5 = 0 THEN ',"rate_limit":"10/m"' ELSE '' END, '}},"beat_schedule":{"nightly":{"task":"app.t', CAST(p_size % 25 AS STRING),
    '","schedule":{"crontab":"', CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '0 2 * * *' END, '"}}}}') AS content
FROM part
UNION ALL SELECT concat('cfg/bad', CAST(p_partkey AS STRING), '.json'),
  CASE p_partkey % 3 WHEN 0 THEN '{bad' WHEN 1 THEN '{"task_routes":[]}' ELSE '{"task_routes":{"a":{}},"task_annotations":{"a":{"max_retries":"x"}}}' END
FROM part WHERE p_partkey % 10 = 0""",
    "bullmq_configs": """
SELECT concat('cfg/', CAST(p_partkey AS STRING), '.json') AS path,
  concat('{"queues":[{"name":"q', CAST(p_size AS STRING), '","jobs":[{"name":"job.', CAST(p_partkey AS STRING), '","opts":{"attempts":', CAST(p_size % 4 AS STRING),
    CASE p_partkey % 4 WHEN 0 THEN ',"backoff":{"type":"fixed","delay":30000}' WHEN 1 THEN ',"backoff":{"type":"exponential","delay":1000}' WHEN 2 THEN ',"backoff":{"type":"jitter","delay":5}' ELSE '' END,
    CASE WHEN p_partkey % 5 = 0 THEN ',"delay":5000' ELSE '' END, '}},{"name":"plain","opts":{}}]},{"name":"empty","jobs":[]}]}') AS content
FROM part
UNION ALL SELECT concat('cfg/bad', CAST(p_partkey AS STRING), '.json'),
  CASE p_partkey % 3 WHEN 0 THEN '{bad' WHEN 1 THEN '[]' ELSE '{"queues":[{"name":"q","jobs":[{"name":"a","opts":{"attempts":"3"}}]}]}' END
FROM part WHERE p_partkey % 10 = 0""",
    "sidekiq_configs": """
SELECT concat('cfg/', CAST(p_partkey AS STRING), '.yml') AS path,
  concat('---', chr(10), ':concurrency: 10', chr(10), ':queues:', chr(10), '  - default', chr(10), 'workers:', chr(10),
    '  - class: Mailers::Size', CAST(p_size AS STRING), 'Worker', chr(10), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('    queue: q', CAST(p_size % 4 AS STRING), chr(10)) END,
    CASE p_partkey % 4 WHEN 0 THEN concat('    retry: ', CAST(p_size AS STRING), chr(10)) WHEN 1 THEN concat('    retry: true', chr(10)) WHEN 2 THEN concat('    retry: false', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 5 = 0 THEN concat('    cron: "0 */2 * * *"', chr(10)) ELSE '' END,
    '  - class: HardWorker', chr(10), '    queue: low', chr(10)) AS content
FROM part
UNION ALL SELECT concat('cfg/bad', CAST(p_partkey AS STRING), '.yml'),
  CASE p_partkey % 3 WHEN 0 THEN concat('- a', chr(10), '- b') WHEN 1 THEN concat('workers:', chr(10), '  - plain', chr(10)) ELSE 'x: [' END
FROM part WHERE p_partkey % 10 = 0""",
    "converted_configs": """
SELECT concat('cfg/', CAST(p_partkey AS STRING), '.json') AS path,
  concat('{"source":"bullmq","jobs":[{"type":"', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'a.b' END, '","queue":"q1","options":{"queue":"q1","retry":{"max_attempts":',
    CAST(p_size - 10 AS STRING), '}}},{"type":"c.d"', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ',"queue":"q2"' END, '}]}') AS content
FROM part""",
    "manifests": """
SELECT concat('m/', CAST(p_partkey AS STRING), '.json') AS path,
  CASE WHEN p_partkey % 11 = 0 THEN '{"version":"1.0","package":"p","job_types":[]}' ELSE
  concat('{"version":"1.0","package":"p","job_types":[{"type":"', CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'email.send' END, '","queue":"mail","args":[{"name":"',
    CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'to' END, '","required":true}]},{"type":"', CASE WHEN p_partkey % 3 = 0 THEN 'email.send' ELSE 'report.generate' END,
    '","args":[{"name":"id","type":"int","required":true}]}]}') END AS content
FROM part""",
    "contract_rows": """
SELECT p_partkey AS seq, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS service,
  CASE p_partkey % 4 WHEN 0 THEN 'producer' WHEN 1 THEN 'consumer' WHEN 2 THEN 'observer' ELSE 'producer' END AS role,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_type END AS job_type
FROM part""",
    "repo_files": """
SELECT concat('repo', CAST(p_partkey AS STRING)) AS root,
  CASE p_partkey % 8 WHEN 0 THEN 'sidekiq.yml' WHEN 1 THEN 'config/sidekiq.yml' WHEN 2 THEN 'Gemfile' WHEN 3 THEN 'package.json'
    WHEN 4 THEN 'celeryconfig.py' WHEN 5 THEN 'celery.json' WHEN 6 THEN 'requirements.txt' ELSE 'README.md' END AS path,
  CASE WHEN p_size % 3 = 0 THEN 'gem "rails"' ELSE concat('gem "sidekiq"', chr(10), '"bullmq": "^4"', chr(10), 'celery==5.3') END AS content
FROM part
UNION ALL
SELECT concat('repo', CAST(p_partkey AS STRING)) AS root, CASE WHEN p_size % 2 = 0 THEN 'Gemfile' ELSE 'requirements.txt' END AS path,
  CASE WHEN p_size % 5 = 0 THEN 'nothing' ELSE 'sidekiq celery' END AS content
FROM part""",
    "type_mapping": """
SELECT DISTINCT CASE l_returnflag WHEN 'R' THEN 'email.send' WHEN 'A' THEN 'report.generate' ELSE 'unused.type' END AS source_type,
  CASE l_returnflag WHEN 'R' THEN 'mail.deliver' WHEN 'A' THEN 'report.build' ELSE 'x' END AS target_type,
  CASE l_returnflag WHEN 'R' THEN 'email' WHEN 'A' THEN 'reports' ELSE 'x' END AS source_queue,
  CASE l_returnflag WHEN 'R' THEN 'mail' WHEN 'A' THEN 'analytics' ELSE 'x' END AS target_queue
FROM lineitem""",
    "target_jobs": """
SELECT job_id, type, CASE WHEN priority = 3 AND state = 'completed' THEN 'moved' ELSE queue END AS queue, args_json FROM jobs WHERE state <> 'cancelled'
UNION ALL
SELECT concat('extra-', CAST(c_custkey AS STRING)) AS job_id, 'email.send' AS type, 'email' AS queue, '[]' AS args_json FROM customer""",
    "retry_policies": """
SELECT DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'payment.charge' WHEN '2-HIGH' THEN 'email.send' WHEN '3-MEDIUM' THEN 'report.generate' WHEN '4-NOT SPECIFIED' THEN 'image.resize' ELSE 'none' END AS type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'fixed' WHEN '2-HIGH' THEN 'exponential' WHEN '3-MEDIUM' THEN 'linear' ELSE 'polynomial' END AS strategy,
  CAST(substr(o_orderpriority, 1, 1) AS INT) + 2 AS policy_max_attempts, 10 AS initial_seconds
FROM orders""",
    "event_lines": """
SELECT event_id AS line, CASE CAST(floor(value) AS INT) % 5 WHEN 0 THEN ': keep-alive' WHEN 1 THEN 'data: not json'
  WHEN 2 THEN '' ELSE concat('data:  {"type":"', event_type, '","event":"job.', event_type, '","job_id":"job-', CAST(user_id AS STRING), '","queue":"q', CAST(user_id % 4 AS STRING), '"}  ') END AS raw
FROM events""",
    "enqueue_requests": """
SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'email.send' END AS type,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('q', CAST(o_custkey % 4 AS STRING)) END AS queue,
  CASE o_orderkey % 5 WHEN 0 THEN '{bad' WHEN 1 THEN NULL ELSE concat('[', CAST(o_custkey AS STRING), ']') END AS args,
  CAST(o_orderkey % 4 - 1 AS INT) AS priority, CAST(o_orderkey % 3 AS INT) AS max_attempts,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('k', CAST(o_custkey AS STRING)) END AS unique_key,
  CASE WHEN o_orderkey % 6 = 0 THEN '5m' END AS unique_within
FROM orders""",
    "migration_log": """
SELECT concat('run-', CAST(l_suppkey AS STRING)) AS run_id, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq,
  CASE l_returnflag WHEN 'A' THEN 'exported' WHEN 'N' THEN 'imported' ELSE CASE WHEN l_linestatus = 'O' THEN 'verified' ELSE 'error' END END AS event
FROM lineitem""",
    "sidekiq_keys": """
SELECT CASE seq % 10 WHEN 0 THEN 'schedule' WHEN 5 THEN 'retry' ELSE redis_key END AS key, CASE WHEN seq % 5 = 0 THEN 'zset' ELSE 'list' END AS kind,
  seq AS idx, CAST(NULL AS STRING) AS field, payload AS value, CAST(seq AS DOUBLE) AS score
FROM raw_sidekiq
UNION ALL SELECT DISTINCT 'queues', 'set', CAST(0 AS BIGINT), CAST(NULL AS STRING), substr(redis_key, 7), CAST(NULL AS DOUBLE) FROM raw_sidekiq""",
    "bullmq_keys": """
SELECT concat('bull:', queue, ':wait') AS key, 'list' AS kind, seq AS idx, CAST(NULL AS STRING) AS field, id AS value, CAST(NULL AS DOUBLE) AS score FROM raw_bullmq
UNION ALL SELECT concat('bull:', queue, ':', id), 'hash', CAST(0 AS BIGINT), 'name', name, CAST(NULL AS DOUBLE) FROM raw_bullmq WHERE name IS NOT NULL
UNION ALL SELECT concat('bull:', queue, ':', id), 'hash', CAST(0 AS BIGINT), 'data', data, CAST(NULL AS DOUBLE) FROM raw_bullmq WHERE data IS NOT NULL
UNION ALL SELECT concat('bull:', queue, ':', id), 'hash', CAST(0 AS BIGINT), 'opts', opts, CAST(NULL AS DOUBLE) FROM raw_bullmq
UNION ALL SELECT concat('bull:', n_name, ':id'), 'string', CAST(0 AS BIGINT), CAST(NULL AS STRING), '1', CAST(NULL AS DOUBLE) FROM nation""",
    "celery_keys": """
SELECT queue AS key, 'list' AS kind, seq AS idx, CAST(NULL AS STRING) AS field, payload AS value, CAST(NULL AS DOUBLE) AS score FROM raw_celery
UNION ALL SELECT DISTINCT concat('_kombu.binding.', queue), 'set', CAST(0 AS BIGINT), CAST(NULL AS STRING), queue, CAST(NULL AS DOUBLE) FROM raw_celery""",
    "river_keys": """
SELECT redis_key AS key, 'list' AS kind, seq AS idx, CAST(NULL AS STRING) AS field, payload AS value, CAST(NULL AS DOUBLE) AS score FROM raw_river""",
    "keyspace": """
SELECT * FROM sidekiq_keys UNION ALL SELECT * FROM bullmq_keys UNION ALL SELECT * FROM celery_keys UNION ALL SELECT * FROM river_keys""",
    "job_progress": """
SELECT concat('job-', CAST(event_id AS STRING)) AS job_id, CASE WHEN event_type = 'click' THEN value / 100 END AS progress,
  CASE WHEN event_type = 'purchase' THEN concat('{"value":', CAST(CAST(floor(value) AS INT) AS STRING), '}') END AS result
FROM events""",
}

# Views a view reads besides base tables.
NEEDS = {
    "target_jobs": ["jobs"],
    "sidekiq_keys": ["raw_sidekiq"],
    "bullmq_keys": ["raw_bullmq"],
    "celery_keys": ["raw_celery"],
    "river_keys": ["raw_river"],
    "keyspace": ["sidekiq_keys", "bullmq_keys", "celery_keys", "river_keys"],
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One entity as a DataFrame over the parquet tables in ``sf_dir``."""
    if name == "attempts":
        return _attempts(spark, sf_dir)
    if name == "workflow_steps":
        return _workflow_steps(spark, sf_dir)
    sql = VIEWS[name]
    for table in BASE_TABLES:
        if f"FROM {table}" in sql:
            load(spark, sf_dir, table).createOrReplaceTempView(table)
    for other in NEEDS.get(name, []):
        view(spark, sf_dir, other).createOrReplaceTempView(other)
    return spark.sql(sql)


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    numbered = with_row_number(load(spark, sf_dir, "lineitem"), ["l_orderkey"], order, "attempt")
    failed = F.col("l_returnflag") != "N"
    return numbered.select(
        F.concat(F.lit("job-"), F.col("l_orderkey").cast("string")).alias("job_id"),
        "attempt",
        F.when(failed, "failed").otherwise("completed").alias("state"),
        F.col("l_shipdate").alias("started_at"),
        F.when(failed, F.expr("l_shipdate + INTERVAL '1' SECOND * CAST(l_quantity AS INT)")).alias("failed_at"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'timeout' WHEN 'A' THEN 'validation failed' END").alias("error"),
        F.concat(F.lit("worker-"), F.col("l_suppkey").cast("string")).alias("worker_id"),
    )


def _workflow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Steps are numbered by order key; read as seconds it also gives the time slices of heavy workflows.
    orders = load(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.timestamp_seconds(F.col("o_orderkey")).alias("_at")
    )
    numbered = with_row_number(orders, ["o_custkey"], ["_at", "o_orderkey"], "rn")
    parent = F.col("rn") - 1 - F.when((F.col("o_orderkey") % 3 == 0) & (F.col("rn") > 2), 1).otherwise(0)
    return numbered.select(
        F.concat(F.lit("wf-"), F.col("o_custkey").cast("string")).alias("workflow_id"),
        F.concat(F.lit("step-"), F.col("rn").cast("string")).alias("step_id"),
        F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id"),
        F.when(F.col("rn") > 1, F.concat(F.lit("step-"), parent.cast("string"))).alias("depends_on"),
    )


def with_views(query: str, *names: str) -> str:
    """``query`` prefixed with the named views as common table expressions, in ANSI spelling."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in ordered)
    parts = parts.replace("TIMESTAMP_NTZ '", "TIMESTAMP '")
    query = query.strip()
    if query.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts},\n{query[len('WITH RECURSIVE'):].strip()}"
    if query.upper().startswith("WITH "):
        return f"WITH {parts},\n{query[5:].strip()}"
    return f"WITH {parts}\n{query}"
