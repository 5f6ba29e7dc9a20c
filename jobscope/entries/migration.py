"""Legacy dumps to canonical jobs: analysis, export, validation, sinks."""

import os
from contextlib import contextmanager

from pyspark.sql import functions as F

from jobscope.entries.registry import AS_OF, query
from jobscope.operators import reconcile
from jobscope.plans import adapters, analysis, validate
from jobscope.session import cut_lineage, work_dir
from jobscope.sources import keyspace, readers, sinks

_DELAYED = "strftime(TIMESTAMP '2024-01-31 00:00:00' + INTERVAL '1' SECOND * (seq % 4), '%Y-%m-%dT%H:%M:%SZ')"
_CLASS = "CASE seq % 4 WHEN 0 THEN 'EmailWorker' WHEN 1 THEN 'Mailers::WelcomeEmail' WHEN 2 THEN 'HTTPServer' ELSE 'HardWorker' END"
_CLASS_TYPE = "CASE seq % 4 WHEN 0 THEN 'email.worker' WHEN 1 THEN 'mailers.welcome.email' WHEN 2 THEN 'httpserver' ELSE 'hard.worker' END"


@query(
    "keyspace_queues",
    """SELECT 'sidekiq' AS system, value AS queue FROM keyspace WHERE key = 'queues' AND kind = 'set'
    UNION SELECT 'bullmq', split_part(key, ':', 2) FROM keyspace WHERE key LIKE 'bull:%:id' OR key LIKE 'bull:%:wait'
    UNION SELECT 'celery', 'celery' UNION SELECT 'celery', substr(key, 16) FROM keyspace WHERE key LIKE '\\_kombu.binding.%' ESCAPE '\\'
    UNION SELECT 'river', substr(key, 13) FROM keyspace WHERE key LIKE 'river:queue:%'""",
    "keyspace",
)
def keyspace_queues(t):
    return keyspace.discover_queues(t.keyspace)


@query(
    "analyze_sidekiq",
    f"""WITH r AS (SELECT seq, substr(redis_key, 7) AS queue, payload <> '{{bad' AS ok, {_CLASS} AS class FROM raw_sidekiq)
    SELECT 'type' AS level, queue, class AS job_type, count(*) AS jobs FROM r WHERE seq % 5 <> 0 AND ok GROUP BY queue, class
    UNION ALL SELECT 'queue', queue, NULL, count(*) FROM r WHERE seq % 5 <> 0 GROUP BY queue UNION ALL SELECT 'total', NULL, NULL, count(*) FROM r""",
    "raw_sidekiq",
)
def analyze_sidekiq(t):
    return analysis.analyze_sidekiq(t.sidekiq_keys)


@query(
    "analyze_bullmq",
    """SELECT 'type' AS level, queue, name AS job_type, count(*) AS jobs FROM raw_bullmq WHERE name IS NOT NULL GROUP BY queue, name
    UNION ALL SELECT 'queue', queue, NULL, count(*) FROM raw_bullmq GROUP BY queue UNION ALL SELECT 'queue', n_name, NULL, 0 FROM nation
    UNION ALL SELECT 'total', NULL, NULL, count(*) FROM raw_bullmq""",
    "raw_bullmq",
)
def analyze_bullmq(t):
    return analysis.analyze_bullmq(t.bullmq_keys)


@query(
    "analyze_celery",
    """SELECT 'type' AS level, queue, concat('app.tasks.t', CAST(seq % 5 AS VARCHAR)) AS job_type, count(*) AS jobs FROM raw_celery WHERE seq % 11 <> 0 GROUP BY 2, 3
    UNION ALL SELECT 'queue', queue, NULL, count(*) FROM raw_celery GROUP BY queue UNION ALL SELECT 'total', NULL, NULL, count(*) FROM raw_celery""",
    "raw_celery",
)
def analyze_celery(t):
    return analysis.analyze_celery(t.celery_keys)


@query(
    "analyze_faktory",
    """SELECT 'type' AS level, list_queue AS queue, concat('Type', CAST(seq % 5 AS VARCHAR)) AS job_type, count(*) AS jobs FROM raw_faktory GROUP BY 2, 3
    UNION ALL SELECT 'queue', list_queue, NULL, count(*) FROM raw_faktory GROUP BY list_queue UNION ALL SELECT 'total', NULL, NULL, count(*) FROM raw_faktory""",
    "raw_faktory",
)
def analyze_faktory(t):
    raw = t.raw_faktory
    sizes = raw.groupBy(F.col("list_queue").alias("queue")).agg(F.count("*").alias("size"))
    return analysis.analyze_faktory(sizes, raw)


@query(
    "analyze_river",
    """SELECT 'type' AS level, substr(redis_key, 13) AS queue, CASE WHEN seq % 13 = 0 THEN '' ELSE concat('kind_', CAST(seq % 5 AS VARCHAR)) END AS job_type, count(*) AS jobs FROM raw_river GROUP BY 2, 3
    UNION ALL SELECT 'queue', substr(redis_key, 13), NULL, count(*) FROM raw_river GROUP BY 2 UNION ALL SELECT 'total', NULL, NULL, count(*) FROM raw_river""",
    "raw_river",
)
def analyze_river(t):
    return analysis.analyze_river(t.river_keys)


@query(
    "analyze_river_exact",
    """SELECT 'type' AS level, substr(redis_key, 13) AS queue, CASE WHEN seq % 13 = 0 THEN '' ELSE concat('kind_', CAST(seq % 5 AS VARCHAR)) END AS job_type, count(*) AS jobs FROM raw_river GROUP BY 2, 3
    UNION ALL SELECT 'queue', substr(redis_key, 13), NULL, count(*) FROM raw_river GROUP BY 2 UNION ALL SELECT 'total', NULL, NULL, count(*) FROM raw_river""",
    "raw_river",
)
def analyze_river_exact(t):
    return analysis.analyze_river(t.river_keys)


@query(
    "sidekiq_export",
    f"""SELECT CASE seq % 10 WHEN 0 THEN 'schedule' WHEN 5 THEN 'retry' ELSE 'queue' END AS source_set, seq AS idx, {_CLASS_TYPE} AS type,
      CASE WHEN seq % 3 = 0 THEN 'default' ELSE substr(redis_key, 7) END AS queue, regexp_extract(payload, '"args":(\\[[0-9]+\\])', 1) AS args, CAST(NULL AS INTEGER) AS priority,
      CASE WHEN seq % 5 = 0 THEN CAST(1700000000 + seq AS VARCHAR) END AS scheduled_at,
      concat('{{"sidekiq_class":"', {_CLASS}, '","sidekiq_jid":"j', CAST(seq AS VARCHAR), '"}}') AS meta
    FROM raw_sidekiq WHERE payload <> '{{bad'""",
    "raw_sidekiq",
)
def sidekiq_export(t):
    return adapters.convert("sidekiq", keyspace.sidekiq_rows(t.sidekiq_keys)).jobs


@query(
    "bullmq_export",
    f"""SELECT id, queue, name AS type, CASE WHEN data IS NULL THEN '[]' WHEN data LIKE '[%' THEN data ELSE concat('[', data, ']') END AS args,
      CASE WHEN seq % 5 > 0 THEN CAST(seq % 5 AS INTEGER) END AS priority, CASE WHEN seq % 4 > 0 THEN {_DELAYED} END AS scheduled_at, '{{"bullmq_source":true}}' AS meta
    FROM raw_bullmq WHERE name IS NOT NULL""",
    "raw_bullmq",
)
def bullmq_export(t):
    return adapters.convert("bullmq", keyspace.bullmq_rows(t.bullmq_keys), as_of=AS_OF).jobs


@query(
    "celery_export",
    """SELECT queue, seq AS idx, concat('app.tasks.t', CAST(seq % 5 AS VARCHAR)) AS type,
      CASE WHEN seq % 4 >= 2 THEN concat('["a",', CAST(o_custkey AS VARCHAR), ']') ELSE '[]' END AS args, CAST(NULL AS INTEGER) AS priority, CAST(NULL AS VARCHAR) AS scheduled_at,
      concat('{', CASE WHEN seq % 4 >= 2 THEN concat('"celery_kwargs":{"k":', CAST(seq AS VARCHAR), '},') ELSE '' END, '"celery_task_id":"t', CAST(seq AS VARCHAR), '"}') AS meta
    FROM raw_celery JOIN orders ON o_orderkey = seq WHERE seq % 11 <> 0""",
    "raw_celery",
)
def celery_export(t):
    return adapters.convert("celery", keyspace.celery_rows(t.celery_keys)).jobs


@query(
    "faktory_export",
    """SELECT seq, list_queue, concat('Type', CAST(seq % 5 AS VARCHAR)) AS type, CASE WHEN seq % 3 = 0 THEN 'default' ELSE list_queue END AS queue,
      regexp_extract(payload, '"args":(\\[[0-9]+\\])', 1) AS args, CASE WHEN seq % 4 > 0 THEN CAST(seq % 4 AS INTEGER) END AS priority,
      CASE WHEN seq % 5 = 0 THEN '2025-01-15T10:30:00Z' END AS scheduled_at,
      concat('{', CASE WHEN seq % 6 = 0 THEN '"faktory_custom":{"tenant":"t1"},' ELSE '' END, '"faktory_jid":"f', CAST(seq AS VARCHAR), '"}') AS meta
    FROM raw_faktory""",
    "raw_faktory",
)
def faktory_export(t):
    return adapters.convert("faktory", t.raw_faktory).jobs


@query(
    "river_export",
    """SELECT seq AS idx, concat('kind_', CAST(seq % 5 AS VARCHAR)) AS type, CASE WHEN seq % 2 = 0 THEN 'own' ELSE substr(redis_key, 13) END AS queue,
      concat('[', regexp_extract(payload, '"args":(\\{[^}]*\\})', 1), ']') AS args, CASE WHEN seq % 5 > 0 THEN CAST(seq % 5 AS INTEGER) END AS priority, CAST(NULL AS VARCHAR) AS scheduled_at,
      concat('{"river_id":', CAST(seq AS VARCHAR), ',"river_state":"available"}') AS meta
    FROM raw_river WHERE seq % 13 <> 0""",
    "raw_river",
)
def river_export(t):
    return adapters.convert("river", keyspace.river_rows(t.river_keys)).jobs


@query(
    "export_rejects",
    """SELECT 'sidekiq' AS system, 'invalid JSON' AS reason, count(*) AS n FROM raw_sidekiq WHERE payload = '{bad'
    UNION ALL SELECT 'bullmq', 'missing job name', count(*) FROM raw_bullmq WHERE name IS NULL
    UNION ALL SELECT 'celery', 'missing task header', count(*) FROM raw_celery WHERE seq % 11 = 0
    UNION ALL SELECT 'river', 'missing kind', count(*) FROM raw_river WHERE seq % 13 = 0""",
    "raw_sidekiq raw_bullmq raw_celery raw_river",
)
def export_rejects(t):
    rejects = {
        "sidekiq": adapters.convert("sidekiq", t.raw_sidekiq).rejects,
        "bullmq": adapters.convert("bullmq", t.raw_bullmq, as_of=AS_OF).rejects,
        "celery": adapters.convert("celery", t.raw_celery).rejects,
        "faktory": adapters.convert("faktory", t.raw_faktory).rejects,
        "river": adapters.convert("river", t.raw_river.withColumn("queue", F.lit("q"))).rejects,
    }
    rows = None
    for system, df in rejects.items():
        part = df.select(F.lit(system).alias("system"), "reason")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("system", "reason").agg(F.count("*").alias("n"))


_ERRORS = """CASE line % 10 WHEN 1 THEN ['invalid JSON'] WHEN 2 THEN ['missing required field: type'] WHEN 3 THEN ['missing required field: queue']
  WHEN 4 THEN ['missing required field: args'] WHEN 5 THEN ['args must be a JSON array'] WHEN 6 THEN ['priority must be non-negative']
  WHEN 7 THEN ['missing required field: type', 'missing required field: queue', 'missing required field: args'] ELSE [] END"""


@query("validate_errors", f"SELECT line, unnest({_ERRORS}) AS message FROM ndjson_lines", "ndjson_lines")
def validate_errors(t):
    return validate.validate_jobs(t.ndjson_lines)[0]


@query(
    "validate_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE line % 10 >= 8) AS valid, count(*) FILTER (WHERE line % 10 < 8) AS invalid FROM ndjson_lines WHERE raw <> ''""",
    "ndjson_lines",
)
def validate_summary(t):
    return validate.validate_jobs(t.ndjson_lines)[1]


@query(
    "validate_top",
    f"""WITH e AS (SELECT line, unnest({_ERRORS}) AS message FROM ndjson_lines) SELECT line, message, (SELECT count(*) - 20 FROM e) AS more FROM e ORDER BY line, message LIMIT 20""",
    "ndjson_lines",
)
def validate_top(t):
    return validate.first_errors(validate.validate_jobs(t.ndjson_lines)[0], ["line"])


@query(
    "scan_ndjson",
    "SELECT * FROM (SELECT line % 8 AS file, row_number() OVER (PARTITION BY line % 8 ORDER BY line) AS line, raw FROM ndjson_lines) WHERE raw <> ''",
    "ndjson_lines",
)
def scan_ndjson(t):
    """Lines written to eight files and read back in small blocks, with their numbers; empty lines count."""
    path = work_dir(t.spark, "ndjson")
    lines = t.ndjson_lines.withColumn("file", F.col("line") % 8)
    lines.repartition(8, "file").sortWithinPartitions("file", "line").select("file", "raw").write.partitionBy("file").text(path)
    with _blocks(t, f"{path}/*", 16 << 10):
        # Written while the size holds, as blocks are cut when a file is listed.
        read = cut_lineage(readers.read_job_ndjson(t.spark, f"{path}/*"), "jobs")
    return read.select(F.regexp_extract("file", "file=([0-9]+)", 1).cast("bigint").alias("file"), "line", "raw")


@query(
    "write_ndjson",
    """SELECT concat('{"type":"Type', CAST(seq % 5 AS VARCHAR), '","queue":"', CASE WHEN seq % 3 = 0 THEN 'default' ELSE list_queue END, '","args":', regexp_extract(payload, '"args":(\\[[0-9]+\\])', 1),
      CASE WHEN seq % 4 > 0 THEN concat(',"priority":', CAST(seq % 4 AS VARCHAR)) ELSE '' END, CASE WHEN seq % 5 = 0 THEN ',"scheduled_at":"2025-01-15T10:30:00Z"' ELSE '' END,
      ',"meta":{', CASE WHEN seq % 6 = 0 THEN '"faktory_custom":{"tenant":"t1"},' ELSE '' END, '"faktory_jid":"f', CAST(seq AS VARCHAR), '"}}') AS value FROM raw_faktory""",
    "raw_faktory",
)
def write_ndjson(t):
    path = work_dir(t.spark, "canonical")
    sinks.write_job_ndjson(adapters.convert("faktory", t.raw_faktory).jobs, path)
    return t.spark.read.text(path)


@query(
    "read_export",
    "SELECT job_id AS id, type, queue, state, args_json AS args, priority, attempt, max_attempts FROM jobs WHERE state NOT IN ('completed', 'discarded', 'cancelled')",
    "jobs",
)
def read_export(t):
    from jobscope.operators.search import select_for_export

    path = work_dir(t.spark, "export")
    jobs = select_for_export(t.jobs).select(
        F.col("job_id").alias("id"), "type", "queue", "state", F.try_parse_json("args_json").alias("args"), "priority", "attempt", "max_attempts"
    )
    sinks.write_export(jobs, path, {"backend": "tables", "url": t.sf_dir, "version": "1"}, AS_OF.isoformat() + "Z")
    back = readers.read_export(t.spark, path)[1]
    return back.select("id", "type", "queue", "state", F.to_json("args").alias("args"), "priority", "attempt", "max_attempts")


#: Jobs in one written document, and blocks that written files are cut into.
DOCUMENT_JOBS, BLOCKS = 500_000, 96


def _documents(t) -> str:
    """All jobs as three export documents, or more where they would hold over ``DOCUMENT_JOBS`` jobs, as one task writes
    each; messages have braces, quotes and backslashes."""
    path = work_dir(t.spark, "documents")
    text = F.concat(F.lit('}{"]\\\\ "jobs": ['), "job_id")
    jobs = t.jobs.select(
        F.col("job_id").alias("id"), text.alias("type"), "queue", "state", F.try_parse_json(F.concat(F.lit('[{"a": "}"},'), F.substring("args_json", 2, 10000))).alias("args"), "priority", "attempt", "max_attempts"
    )
    documents = max(3, -(-jobs.count() // DOCUMENT_JOBS))
    sinks.write_export_documents(jobs.repartition(documents), path, {"backend": "tables", "url": t.sf_dir, "version": "1"}, AS_OF.isoformat() + "Z")
    return path


@query(
    "read_document",
    """SELECT job_id AS id, concat('}{"]\\\\ "jobs": [', job_id) AS type, queue, state, concat('[{"a":"}"},', substr(args_json, 2)) AS args, priority, attempt, max_attempts FROM jobs""",
    "jobs",
)
def read_document(t):
    """Documents cut into many blocks; the size is put back afterwards."""
    path = _documents(t)
    with _blocks(t, path, 256 << 10):
        jobs = readers.read_export_document(t.spark, path)[1]
    return jobs.select("id", "type", "queue", "state", F.to_json("args").alias("args"), "priority", "attempt", "max_attempts")


@contextmanager
def _blocks(t, path, smallest):
    """Files are read in up to ``BLOCKS`` blocks of at least ``smallest`` bytes: blocks grow with the files, up to the
    size that the session gives them."""
    name, size = "spark.sql.files.maxPartitionBytes", t.spark.conf.get("spark.sql.files.maxPartitionBytes")
    total = t.spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    most = t.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    t.spark.conf.set(name, f"{min(most, max(smallest, total // BLOCKS))}b")
    try:
        yield
    finally:
        t.spark.conf.set(name, size)


@query(
    "import_document",
    """SELECT backend, count(*) AS total, count(*) FILTER (WHERE state <> 'completed') AS success, count(*) FILTER (WHERE state = 'completed') AS failed,
      CAST(ceil(count(*) FILTER (WHERE state <> 'completed') / 50) AS BIGINT) AS batches FROM jobs, (SELECT 'tables' AS backend) GROUP BY backend""",
    "jobs",
)
def import_document(t):
    """Jobs of a document go out in batches of 50; here the finished ones count as refused."""
    header, jobs = readers.read_export_document(t.spark, _documents(t))
    backend = header.agg(F.max("source.backend").alias("backend"))
    return backend.join(reconcile.import_result(jobs, F.col("state") != "completed", batch_size=50))


@query(
    "send_jobs",
    "SELECT job_id, type, queue, 1 AS times FROM jobs WHERE state IN ('available', 'scheduled', 'retryable')",
    "jobs",
)
def send_jobs(t):
    """Open jobs handed over in batches by a sink with commits, twice; the receiver keeps one batch per key."""
    jobs = t.jobs.where(F.col("state").isin("available", "scheduled", "retryable")).select("job_id", "type", "queue")
    jobs, path = cut_lineage(jobs, "open"), work_dir(t.spark, "sent").removeprefix("file://").removeprefix("file:")
    os.makedirs(path)

    def receive(key, batch):
        import json
        import os

        place = f"{path}/{'-'.join(map(str, key))}.json"
        with open(f"{place}.part", "w") as f:
            f.writelines(json.dumps(row) + "\n" for row in batch)
        os.replace(f"{place}.part", place)

    for _ in range(2):
        sinks.send_committed(jobs, receive, "first")
    return t.spark.read.schema("job_id string, type string, queue string").json(path).groupBy("job_id", "type", "queue").agg(F.count("*").cast("int").alias("times"))


@query(
    "api_dump",
    """WITH sizes AS (SELECT list_queue, count(*) AS size FROM raw_faktory GROUP BY 1)
    SELECT list_queue AS queue, concat('Type', CAST(seq % 5 AS VARCHAR)) AS type, count(*) AS jobs, any_value(size) AS size FROM raw_faktory JOIN sizes USING (list_queue) GROUP BY 1, 2""",
    "raw_faktory",
)
def api_dump(t):
    """Pages of up to twenty jobs as JSON lines, read back: sizes of the queues, and the jobs converted."""
    path = work_dir(t.spark, "api")
    pages = t.raw_faktory.groupBy(F.col("list_queue").alias("queue"), F.floor(F.col("seq") / 20).alias("page")).agg(F.collect_list("payload").alias("payloads"))
    pages = pages.select("queue", F.size("payloads").cast("bigint").alias("size"), F.transform("payloads", F.try_parse_json).alias("jobs"))
    pages.write.json(path)
    sizes, raw = keyspace.read_api_dump(t.spark, path)
    found = adapters.convert("faktory", raw).jobs.groupBy(F.col("list_queue").alias("queue"), "type").agg(F.count("*").alias("jobs"))
    return found.join(sizes.groupBy("queue").agg(F.sum("size").alias("size")), "queue").select("queue", "type", "jobs", "size")


@query(
    "sse_parse",
    """SELECT line, CASE WHEN ok THEN trim(substr(raw, 6)) ELSE 'not json' END AS data, ok AS is_json, CASE WHEN ok THEN t END AS type, CASE WHEN ok THEN concat('job.', t) END AS event,
      CASE WHEN ok THEN concat('job-', CAST(u AS VARCHAR)) END AS job_id, CASE WHEN ok THEN concat('q', CAST(u % 4 AS VARCHAR)) END AS queue
    FROM (SELECT line, raw, raw <> 'data: not json' AS ok, event_type AS t, user_id AS u FROM event_lines JOIN events ON event_id = line WHERE raw LIKE 'data:%')""",
    "event_lines",
)
def sse_parse(t):
    return readers.parse_event_lines(t.event_lines)
