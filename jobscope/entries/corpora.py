"""Configuration files, source code and workflow code."""

from pyspark.sql import functions as F

from jobscope.entries.registry import query
from jobscope.plans import code, configs, validate, workflow_import
from jobscope.session import work_dir
from jobscope.sources import readers

_PART = "concat('cfg/', CAST(p_partkey AS VARCHAR), '.json') AS path"


@query(
    "cfg_sidekiq",
    """SELECT concat('cfg/', CAST(p_partkey AS VARCHAR), '.yml') AS path, concat('mailers.size', CAST(p_size AS VARCHAR), 'worker') AS type,
      CASE WHEN p_partkey % 3 = 0 THEN 'default' ELSE concat('q', CAST(p_size % 4 AS VARCHAR)) END AS queue,
      CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 25 END AS max_attempts, CASE WHEN p_partkey % 4 < 2 THEN 'exponential' END AS backoff, CAST(NULL AS BIGINT) AS delay_ms,
      CASE WHEN p_partkey % 5 = 0 THEN '0 */2 * * *' END AS cron FROM part
    UNION ALL SELECT concat('cfg/', CAST(p_partkey AS VARCHAR), '.yml'), 'hard.worker', 'low', NULL, NULL, NULL, NULL FROM part""",
)
def cfg_sidekiq(t):
    return configs.convert_sidekiq_configs(t.sidekiq_configs).jobs


@query(
    "cfg_sidekiq_warn",
    """SELECT concat('cfg/', CAST(p_partkey AS VARCHAR), '.yml') AS path,
      concat('Mailers::Size', CAST(p_size AS VARCHAR), 'Worker: using Sidekiq default 25 retries; consider reducing') AS message FROM part WHERE p_partkey % 4 = 1""",
)
def cfg_sidekiq_warn(t):
    return configs.convert_sidekiq_configs(t.sidekiq_configs).warnings


@query(
    "cfg_rejects",
    """SELECT 'sidekiq' AS framework, concat('cfg/bad', CAST(p_partkey AS VARCHAR), '.yml') AS path,
      CASE p_partkey % 3 WHEN 0 THEN 'top level is not a mapping' WHEN 1 THEN 'a worker is not a mapping' ELSE 'invalid YAML' END AS reason FROM part WHERE p_partkey % 10 = 0
    UNION ALL SELECT 'bullmq', concat('cfg/bad', CAST(p_partkey AS VARCHAR), '.json'),
      CASE p_partkey % 3 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'not an object' ELSE 'bad type: attempts' END FROM part WHERE p_partkey % 10 = 0
    UNION ALL SELECT 'celery', concat('cfg/bad', CAST(p_partkey AS VARCHAR), '.json'),
      CASE p_partkey % 3 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'bad type: task_routes' ELSE 'bad type: max_retries' END FROM part WHERE p_partkey % 10 = 0""",
)
def cfg_rejects(t):
    found = [
        configs.config_rejects(files, name).select(F.lit(name).alias("framework"), "path", "reason")
        for name, files in (("sidekiq", t.sidekiq_configs), ("bullmq", t.bullmq_configs), ("celery", t.celery_configs))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


_BULLMQ = f"""SELECT {_PART}, concat('job.', CAST(p_partkey AS VARCHAR)) AS type, concat('q', CAST(p_size AS VARCHAR)) AS queue, nullif(p_size % 4, 0) AS max_attempts,
      CASE WHEN p_size % 4 > 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 'fixed' ELSE 'exponential' END END AS backoff,
      CAST(CASE WHEN p_size % 4 > 0 THEN CASE p_partkey % 4 WHEN 0 THEN 30000 WHEN 1 THEN 1000 WHEN 2 THEN 5 END END AS BIGINT) AS delay_ms, CAST(NULL AS VARCHAR) AS cron FROM part
    UNION ALL SELECT {_PART}, 'plain', concat('q', CAST(p_size AS VARCHAR)), NULL, NULL, NULL, NULL FROM part"""


@query("cfg_bullmq", _BULLMQ)
def cfg_bullmq(t):
    return configs.convert_bullmq_configs(t.bullmq_configs).jobs


def _written(t, files, by):
    """Small files below a new folder, one per value of ``by``, which is a path."""
    path = work_dir(t.spark, "files")
    files.repartition(by).write.partitionBy(by).text(path)
    return path


@query("read_configs", _BULLMQ.replace(_PART, "1 AS one").replace("SELECT 1 AS one,", "SELECT "))
def read_configs(t):
    """Configurations of four hundred neighbours in one file, read as files and converted."""
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("bigint")
    queues = t.bullmq_configs.where(~F.col("path").startswith("cfg/bad")).select(F.floor(number / 400).alias("part"), F.from_json("content", "queues array<variant>").alias("c"))
    files = queues.groupBy("part").agg(F.flatten(F.collect_list("c.queues")).alias("queues")).select("part", F.to_json(F.struct("queues")).alias("value"))
    return configs.convert_bullmq_configs(readers.read_configs(t.spark, _written(t, files, "part"))).jobs.drop("path")


@query(
    "cfg_bullmq_warn",
    f"""SELECT {_PART}, concat('job.', CAST(p_partkey AS VARCHAR), ': unsupported backoff type "jitter", defaulting to exponential') AS message FROM part WHERE p_partkey % 4 = 2 AND p_size % 4 > 0
    UNION ALL SELECT {_PART}, concat('job.', CAST(p_partkey AS VARCHAR), ': static delay (5000ms) converted to scheduled_at at enqueue time') FROM part WHERE p_partkey % 5 = 0""",
)
def cfg_bullmq_warn(t):
    return configs.convert_bullmq_configs(t.bullmq_configs).warnings


@query(
    "cfg_celery",
    f"""SELECT {_PART}, concat('app.t', CAST(p_size AS VARCHAR)) AS type, CASE WHEN p_partkey % 3 = 0 THEN 'celery' ELSE concat('q', CAST(p_size % 4 AS VARCHAR)) END AS queue,
      nullif(p_size % 4, 0) AS max_attempts, CASE WHEN p_size % 4 > 0 THEN 'exponential' END AS backoff, CAST(NULL AS BIGINT) AS delay_ms,
      CASE WHEN p_size < 25 AND p_partkey % 7 <> 0 THEN '0 2 * * *' END AS cron FROM part
    UNION ALL SELECT {_PART}, 'app.base', 'low', NULL, NULL, NULL, NULL FROM part""",
)
def cfg_celery(t):
    return configs.convert_celery_configs(t.celery_configs).jobs


@query(
    "cfg_celery_warn",
    f"""SELECT {_PART}, concat('app.t', CAST(p_size AS VARCHAR), ': rate_limit "10/m" requires rate limiting extension configuration') AS message FROM part WHERE p_partkey % 5 = 0
    UNION ALL SELECT {_PART}, concat('beat schedule "nightly" references task "app.t', CAST(p_size % 25 AS VARCHAR), '" not in task_routes') FROM part WHERE p_size >= 25""",
)
def cfg_celery_warn(t):
    return configs.convert_celery_configs(t.celery_configs).warnings


@query(
    "cfg_validate",
    f"""SELECT {_PART}, 0 AS job, 'missing type' AS message FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT {_PART}, 0, 'invalid max_attempts' FROM part WHERE p_size < 10 UNION ALL SELECT {_PART}, 1, 'missing queue' FROM part WHERE p_partkey % 4 = 0""",
)
def cfg_validate(t):
    return validate.validate_config(t.converted_configs)


_CODE = """defs AS (SELECT path, 'sidekiq' AS framework, concat('Job', CAST(p_partkey AS VARCHAR), 'Worker') AS name, CASE WHEN p_size % 2 = 0 THEN 'mailer' ELSE 'low' END AS queue, CAST(5 AS BIGINT) AS retry_count, p_partkey, p_size FROM f WHERE p_partkey % 4 = 0
  UNION ALL SELECT path, 'sidekiq', concat('Next', CAST(p_partkey AS VARCHAR), 'Worker'), 'default', NULL, p_partkey, p_size FROM f WHERE p_partkey % 4 = 0
  UNION ALL SELECT path, 'celery', concat('next_', CAST(p_partkey AS VARCHAR)), 'celery', NULL, p_partkey, p_size FROM f WHERE p_partkey % 4 = 2
  UNION ALL SELECT path, 'bullmq', concat('q', CAST(p_size AS VARCHAR)), concat('q', CAST(p_size AS VARCHAR)), NULL, p_partkey, p_size FROM f WHERE p_partkey % 4 = 1
  UNION ALL SELECT path, 'bullmq', concat('job', CAST(p_size AS VARCHAR)), '', NULL, p_partkey, p_size FROM f WHERE p_partkey % 4 = 1
  UNION ALL SELECT path, 'celery', concat('task_', CAST(p_partkey AS VARCHAR)), concat('q', CAST(p_size AS VARCHAR)), NULL, p_partkey, p_size FROM f WHERE p_partkey % 4 = 2)"""
_FILES = "f AS (SELECT p_partkey, p_size, concat('repo', CAST(p_partkey % 10 AS VARCHAR), '/f', CAST(p_partkey AS VARCHAR)) AS path FROM part)"


@query("code_jobs", f"WITH {_FILES}, {_CODE} SELECT path, framework, name, queue, retry_count FROM defs")
def code_jobs(t):
    return code.extract_all(t.source_files)


@query(
    "read_source_tree",
    f"""WITH {_FILES}, {_CODE} SELECT framework, name, queue, retry_count FROM defs WHERE framework <> 'bullmq'
    UNION ALL SELECT framework, name, queue, retry_count FROM (SELECT DISTINCT p_partkey // 400, framework, name, queue, retry_count FROM defs WHERE framework = 'bullmq')""",
)
def read_source_tree(t):
    """Sources of four hundred neighbours in one file per language, in folders, read as a tree and searched.

    A name that stands several times in a file of the one language is one definition there.
    """
    number = F.regexp_extract("path", "f([0-9]+)$", 1).cast("bigint")
    place = F.concat(F.lit("lang"), (number % 4).cast("string"), F.lit("-"), F.floor(number / 400).cast("string"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda x: x["content"]), "\n")
    files = t.source_files.groupBy(place.alias("place")).agg(joined.alias("value"))
    tree = readers.read_source_tree(t.spark, _written(t, files, "place"), "*.txt")
    return code.extract_all(tree).drop("path")


@query("code_queues", f"WITH {_FILES}, {_CODE} SELECT DISTINCT framework, queue FROM defs WHERE queue <> ''")
def code_queues(t):
    return code.code_queues(code.extract_all(t.source_files))


@query(
    "code_plan",
    f"""WITH {_FILES}, {_CODE} SELECT path, framework, name, CASE framework WHEN 'sidekiq' THEN concat(lower(replace(name, 'Worker', '')), '.worker') ELSE replace(name, '_', '.') END AS target_type, queue FROM defs""",
)
def code_plan(t):
    return code.plan_migration(code.extract_all(t.source_files))


@query("code_plan_summary", f"WITH {_FILES}, {_CODE} SELECT framework, count(*) AS jobs, count(DISTINCT nullif(queue, '')) AS queues FROM defs GROUP BY framework")
def code_plan_summary(t):
    return code.plan_summary(code.extract_all(t.source_files))


_WF = "concat('wf/f', CAST(p_partkey AS VARCHAR), '.go') AS path, 'temporal' AS source"
_ORDER, _AUDIT = "concat('Order', CAST(p_partkey AS VARCHAR), 'Flow') AS workflow", "concat('Audit', CAST(p_partkey AS VARCHAR)) AS workflow"


@query(
    "wf_temporal",
    f"""SELECT {_WF}, {_ORDER}, 0 AS position, 'ValidateOrder' AS name, 'task' AS kind, 'validate.order' AS job_type, 'default' AS queue FROM part
    UNION ALL SELECT {_WF}, {_ORDER}, 1, concat('ShipSize', CAST(p_size AS VARCHAR)), 'chain', concat('ship.size', CAST(p_size AS VARCHAR)), 'default' FROM part WHERE p_size % 4 = 0
    UNION ALL SELECT {_WF}, {_AUDIT}, 0, 'WriteAudit', 'task', 'write.audit', 'default' FROM part WHERE p_size % 2 = 0""",
)
def wf_temporal(t):
    return workflow_import.extract_workflows(t.workflow_code, "temporal").steps


@query(
    "wf_temporal_list",
    f"""SELECT {_WF}, {_ORDER}, CASE WHEN p_size % 4 = 0 THEN 2 ELSE 1 END AS step_count, p_size % 3 = 0 AS parallel FROM part
    UNION ALL SELECT {_WF}, {_AUDIT}, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END, false FROM part""",
)
def wf_temporal_list(t):
    return workflow_import.extract_workflows(t.workflow_code, "temporal").workflows


@query(
    "wf_temporal_warn",
    """WITH f AS (SELECT concat('wf/f', CAST(p_partkey AS VARCHAR), '.go') AS path, concat('Order', CAST(p_partkey AS VARCHAR), 'Flow') AS o, concat('Audit', CAST(p_partkey AS VARCHAR)) AS a, p_size FROM part)
    SELECT path, o AS workflow, concat('child workflow ''ShipSize', CAST(p_size AS VARCHAR), ''' — verify nesting structure manually') AS message FROM f WHERE p_size % 4 = 0
    UNION ALL SELECT path, o, concat('workflow ''', o, ''' uses goroutines/selectors — parallel steps may need manual review') FROM f WHERE p_size % 3 = 0
    UNION ALL SELECT path, a, concat('workflow ''', a, ''' has no detected activities') FROM f WHERE p_size % 2 = 1""",
)
def wf_temporal_warn(t):
    return workflow_import.extract_workflows(t.workflow_code, "temporal").warnings


_DAG = "concat('repo', CAST(p_partkey % 10 AS VARCHAR), '/f', CAST(p_partkey AS VARCHAR)) AS path"
_DAGS = "concat('dag', CAST(p_partkey AS VARCHAR)) AS workflow"
_AIRFLOW = f"""SELECT {_DAG}, 'airflow' AS source, {_DAGS}, position, name, 'task' AS kind, job_type, 'default' AS queue
    FROM part, (VALUES (0, 'a', 'extract.data'), (1, 'b', 'load.data'), (2, 'c', 'check')) s(position, name, job_type) WHERE p_partkey % 4 = 3"""


@query("wf_airflow", _AIRFLOW)
def wf_airflow(t):
    return workflow_import.extract_workflows(t.source_files, "airflow").steps


@query("wf_airflow_edges", f"SELECT {_DAG}, {_DAGS}, upstream, downstream FROM part, (VALUES ('a', 'b'), ('b', 'c')) e(upstream, downstream) WHERE p_partkey % 4 = 3")
def wf_airflow_edges(t):
    return workflow_import.extract_workflows(t.source_files, "airflow").edges


def _all_steps(t):
    airflow = workflow_import.extract_workflows(t.source_files, "airflow")
    temporal = workflow_import.extract_workflows(t.workflow_code, "temporal")
    return airflow.steps.unionByName(temporal.steps)


@query(
    "wf_manifest",
    """SELECT * FROM (VALUES ('extract.data', 'Migrated from airflow (a)'), ('load.data', 'Migrated from airflow (b)'), ('check', 'Migrated from airflow (c)'),
      ('validate.order', 'Migrated from temporal (ValidateOrder)'), ('write.audit', 'Migrated from temporal (WriteAudit)')) v(type, description), (SELECT 'default' AS queue, 3 AS max_attempts, 'exponential' AS backoff, 1000 AS initial_ms)
    UNION ALL SELECT DISTINCT concat('ship.size', CAST(p_size AS VARCHAR)), concat('Migrated from temporal (ShipSize', CAST(p_size AS VARCHAR), ')'), 'default', 3, 'exponential', 1000 FROM part WHERE p_size % 4 = 0""",
)
def wf_manifest(t):
    return workflow_import.manifest_rows(_all_steps(t))


@query(
    "wf_kinds",
    f"""SELECT {_WF}, concat('order', CAST(p_partkey AS VARCHAR), '.flow') AS workflow_type, CASE WHEN p_size % 3 = 0 THEN 'group' ELSE 'chain' END AS kind, 2 AS step_count FROM part WHERE p_size % 4 = 0
    UNION ALL SELECT {_DAG}, 'airflow', concat('dag', CAST(p_partkey AS VARCHAR)), 'chain', 3 FROM part WHERE p_partkey % 4 = 3""",
)
def wf_kinds(t):
    airflow = workflow_import.extract_workflows(t.source_files, "airflow").workflows
    temporal = workflow_import.extract_workflows(t.workflow_code, "temporal").workflows
    return workflow_import.workflow_kinds(temporal.unionByName(airflow))


@query(
    "detect",
    """WITH r AS (SELECT root, min(CASE path WHEN 'sidekiq.yml' THEN 0 WHEN 'config/sidekiq.yml' THEN 1 END) AS s, bool_or(path = 'Gemfile' AND contains(content, 'sidekiq')) AS g,
        bool_or(path = 'package.json' AND contains(content, 'bullmq')) AS b, min(CASE path WHEN 'celeryconfig.py' THEN 0 WHEN 'celery.json' THEN 1 END) AS c,
        bool_or(path = 'requirements.txt' AND contains(content, 'celery')) AS q FROM repo_files GROUP BY root)
    SELECT root, 'sidekiq' AS framework, CASE WHEN s IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence, CASE s WHEN 0 THEN 'sidekiq.yml' WHEN 1 THEN 'config/sidekiq.yml' ELSE '' END AS config_file FROM r WHERE s IS NOT NULL OR g
    UNION ALL SELECT root, 'bullmq', 'high', '' FROM r WHERE b
    UNION ALL SELECT root, 'celery', CASE WHEN c IS NOT NULL THEN 'high' ELSE 'medium' END, CASE c WHEN 0 THEN 'celeryconfig.py' WHEN 1 THEN 'celery.json' ELSE '' END FROM r WHERE c IS NOT NULL OR q""",
    "repo_files",
)
def detect(t):
    return code.detect_frameworks(t.repo_files)


_M = "concat('m/', CAST(p_partkey AS VARCHAR), '.json') AS path"


@query(
    "manifest_validate",
    f"""SELECT {_M}, CAST(NULL AS INTEGER) AS job_type, CAST(NULL AS INTEGER) AS arg, 'manifest contains no job types' AS message FROM part WHERE p_partkey % 11 = 0
    UNION ALL SELECT {_M}, 0, NULL, 'type is required' FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 7 = 0
    UNION ALL SELECT {_M}, 0, 0, 'name is required' FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 5 = 0
    UNION ALL SELECT {_M}, 1, NULL, 'duplicate job type: email.send' FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 = 0""",
)
def manifest_validate(t):
    return validate.validate_manifest(t.manifests)


@query(
    "manifest_defaults",
    f"""SELECT {_M}, 0 AS job_type, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'email.send' END AS type, 'mail' AS queue, 'string' AS arg_type FROM part WHERE p_partkey % 11 <> 0
    UNION ALL SELECT {_M}, 1, CASE WHEN p_partkey % 3 = 0 THEN 'email.send' ELSE 'report.generate' END, 'default', 'int' FROM part WHERE p_partkey % 11 <> 0""",
)
def manifest_defaults(t):
    rows = validate.parse_manifests(t.manifests)
    return rows.select("path", "job_type", F.col("t.type").alias("type"), F.col("t.queue").alias("queue"), F.col("t.args")[0]["type"].alias("arg_type"))


@query(
    "contract_validate",
    """SELECT seq, 'missing service name' AS message FROM contract_rows WHERE service = '' UNION ALL SELECT seq, 'missing job_type' FROM contract_rows WHERE job_type = ''
    UNION ALL SELECT seq, 'role must be ''producer'' or ''consumer'', got "observer"' FROM contract_rows WHERE role = 'observer'""",
    "contract_rows",
)
def contract_validate(t):
    return validate.validate_contracts(t.contract_rows)
