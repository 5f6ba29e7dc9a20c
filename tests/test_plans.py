"""Adapters, validation, configurations, code and workflow extraction on small inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from jobscope.plans import adapters, code, configs, validate, workflow_import

AS_OF = dt.datetime(2024, 1, 1)


def convert(spark, source, payloads, **options):
    raw = spark.createDataFrame([(i, "q", p) for i, p in enumerate(payloads)], "i int, queue string, payload string")
    return adapters.convert(source, raw, **options)


def test_sidekiq(spark):
    jobs, rejects = convert(
        spark,
        "sidekiq",
        [
            '{"class":"Mailers::WelcomeEmail","args":["a"],"queue":"mail","retry":true,"jid":"j1"}',
            '{"class":"MyJob","args":[1, 2],"at":1700000000.6}',
            '{"class":"NoArgs"}',
            "{bad",
            '{"class":5}',
            "[1]",
        ],
    )
    a, b, c = jobs.orderBy("i").collect()
    assert (a.type, a.queue, json.loads(a.args)) == ("mailers.welcome.email", "mail", ["a"])
    assert json.loads(a.meta) == {"sidekiq_jid": "j1", "sidekiq_class": "Mailers::WelcomeEmail"}
    assert (b.queue, b.scheduled_at, json.loads(b.args)) == ("default", "1700000001", [1, 2])
    assert c.args == "null"
    assert [r.reason for r in rejects.orderBy("i").collect()] == ["invalid JSON", "bad type: class", "not an object"]


def test_bullmq(spark):
    raw = spark.createDataFrame(
        [
            (1, "n", "email.send", '{"to":"x"}', '{"priority":5}'),
            (2, "n", "delayed", "[1]", '{"delay":5000}'),
            (3, "n", "plain", None, "not json"),
            (4, "n", "typed", "1", '{"priority":"high","delay":1}'),
            (5, "n", "", "1", "{}"),
        ],
        "i int, queue string, name string, data string, opts string",
    )
    jobs, rejects = adapters.convert("bullmq", raw, as_of=AS_OF)
    got = [(r.i, r.args, r.priority, r.scheduled_at) for r in jobs.orderBy("i").collect()]
    assert got == [(1, '[{"to":"x"}]', 5, None), (2, "[1]", None, "2024-01-01T00:00:05Z"), (3, "[]", None, None), (4, "[1]", None, None)]
    assert [r.reason for r in rejects.collect()] == ["missing job name"]


def test_bullmq_envelope(spark):
    raw = spark.createDataFrame([("n", '{"name":"email.send","data":{"to":"x"},"opts":{"priority":5}}')], "queue string, payload string")
    row = adapters.from_bullmq_envelope(raw, AS_OF).jobs.first()
    assert (row.type, row.queue, row.args, row.priority) == ("email.send", "n", '[{"to":"x"}]', 5)


def test_celery(spark):
    import base64

    body = base64.b64encode(b'[["a", 1], {"k": "v"}, {}]').decode()
    jobs, rejects = convert(
        spark,
        "celery",
        [
            json.dumps({"body": body, "headers": {"task": "app.send", "id": "t1"}}),
            json.dumps({"body": '[["raw"], null]', "headers": {"task": "app.raw", "id": "t2"}}),
            json.dumps({"body": "!!", "headers": {"task": "app.bad"}}),
            json.dumps({"body": body, "headers": {"id": "t3"}}),
            json.dumps({"body": body}),
        ],
    )
    a, b, c = jobs.orderBy("i").collect()
    assert json.loads(a.args) == ["a", 1] and json.loads(a.meta) == {"celery_task_id": "t1", "celery_kwargs": {"k": "v"}}
    assert json.loads(b.args) == ["raw"] and json.loads(b.meta) == {"celery_task_id": "t2"}
    assert c.args == "[]"
    assert {r.reason for r in rejects.collect()} == {"missing task header"} and rejects.count() == 2


def test_faktory_and_river(spark):
    jobs, _ = convert(spark, "faktory", ['{"jid":"f1","jobtype":"Send","args":["u",42],"queue":"emails","priority":3}', '{"jid":"f2","jobtype":"D","args":[1],"at":"2025-01-15T10:30:00Z","custom":{"t":1}}'])
    a, b = jobs.orderBy("i").collect()
    assert (a.type, a.queue, a.priority) == ("Send", "emails", 3)
    assert (b.queue, b.scheduled_at) == ("default", "2025-01-15T10:30:00Z") and json.loads(b.meta)["faktory_custom"] == {"t": 1}
    jobs, rejects = convert(spark, "river", ['{"id":100,"kind":"send","args":{"to":"x"},"queue":"emails","state":"available","priority":5}', '{"id":200,"args":{}}', '{"id":1,"kind":"k","args":null}'])
    a, b = jobs.orderBy("i").collect()
    assert (a.queue, json.loads(a.args), json.loads(a.meta)) == ("emails", [{"to": "x"}], {"river_id": 100, "river_state": "available"})
    assert (b.queue, b.args) == ("q", "[null]")
    assert [r.reason for r in rejects.collect()] == ["missing kind"]


def test_unknown_source(spark):
    with pytest.raises(ValueError, match="supported sources"):
        adapters.convert("other", None)


def test_validation_rules(spark, rows):
    lines = [
        "",
        "{bad",
        '{"queue":"q","args":[1]}',
        "{}",
        '{"type":"a","queue":"q","args":null}',
        '{"type":"a","queue":"q","args":{"x":1},"priority":-1}',
        '{"type":5,"queue":"q","args":[]}',
        '{"type":"a","queue":"q","args":[],"priority":1.5}',
        "null",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "line int, raw string")
    errors, summary = validate.validate_jobs(df)
    assert rows(errors) == sorted(
        [
            (1, "invalid JSON"),
            (2, "missing required field: type"),
            *[(n, f"missing required field: {f}") for n in (3, 8) for f in ("type", "queue", "args")],
            (5, "args must be a JSON array"),
            (5, "priority must be non-negative"),
            (6, "bad type: type"),
            (7, "bad type: priority"),
        ],
        key=repr,
    )
    assert tuple(summary.first()) == (8, 1, 7)
    top = validate.first_errors(errors, ["line"], limit=2).collect()
    assert [r.line for r in top] == [1, 2] and {r.more for r in top} == {10}


def test_worker_yaml(spark, rows):
    text = "---\n:concurrency: 10\nworkers:\n  - class: EmailWorker\n    queue: mailers\n    retry: 5\n    cron: '0 2 * * *'\n  - class: HardWorker\n    retry: true\n  - class: Quiet\n    retry: false\n"
    files = spark.createDataFrame([("a", text), ("b", "x: ["), ("c", "")], "path string, content string")
    jobs, warnings = configs.convert_sidekiq_configs(files)
    assert rows(jobs.drop("delay_ms")) == sorted(
        [
            ("a", "email.worker", "mailers", 5, "exponential", "0 2 * * *"),
            ("a", "hard.worker", "default", 25, "exponential", None),
            ("a", "quiet", "default", None, None, None),
        ],
        key=repr,
    )
    assert [r.message.split(":")[0] for r in warnings.collect()] == ["HardWorker"]


def test_worker_yaml_rejects(spark, rows):
    good = "# c\nworkers:\n- class: A::B  # note\n  retry: '5'\n  tags:\n    - x\n- queue: \"q\"\n  class: C\n  retry: 7\nother: {a: [1]}\n"
    bad = [("list", "- a\n- b"), ("plain", "workers:\n  - plain\n"), ("open", "x: ["), ("flow", "workers: [A, b]"), ("anchor", "workers: *w\n"), ("none", None), ("empty", "workers: []\n")]
    files = spark.createDataFrame([("good", good), *bad], "path string, content string")
    jobs, _ = configs.convert_sidekiq_configs(files)
    assert rows(jobs.select("path", "type", "queue", "max_attempts")) == [("good", "a.b", "default", None), ("good", "c", "q", 7)]
    assert "Python" not in jobs._jdf.queryExecution().executedPlan().toString()
    assert {r.path: r.reason for r in configs.config_rejects(files, "sidekiq").collect()} == {
        "list": "top level is not a mapping",
        "plain": "a worker is not a mapping",
        "open": "invalid YAML",
        "flow": "a worker is not a mapping",
        "anchor": "workers are not a list",
    }


def test_worker_yaml_in_flow_style(spark, rows):
    """Flow lists and mappings, JSON, and brackets in quotes and comments."""
    files = {
        "flow": "a: 1\nworkers: [{class: A, queue: low, retry: 3, tags: [x, y]}, {class: 'B::C', retry: true}] # note\nother: [1]\n",
        "lines": "workers: [\n  {class: A, queue: 'lo,w', retry: 3},   # first ]\n  {queue: q, class: B},\n]\n",
        "items": "workers:\n  - {class: A, queue: \"l{o]w\", retry: 3}\n  - class: B\n    queue: q\n",
        "json": json.dumps({"x": [1], "workers": [{"class": "A", "queue": "l}ow", "retry": 3}, {"class": "B", "retry": False}], "y": {}}),
        "pretty": json.dumps({"workers": [{"class": "A", "queue": "low", "retry": 3}]}, indent=2),
        "signs": "# it's [ open\nworkers:\n- class: A # {\n  queue: '[low'\n  retry: 3\n",
    }
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    assert configs.config_rejects(df, "sidekiq").collect() == []
    got = {}
    for r in configs.convert_sidekiq_configs(df).jobs.collect():
        got.setdefault(r.path, []).append((r.type, r.queue, r.max_attempts))
    b = lambda name, queue="default", attempts=None: (name, queue, attempts)
    assert got == {
        "flow": [b("a", "low", 3), b("b.c", attempts=25)],
        "lines": [b("a", "lo,w", 3), b("b", "q")],
        "items": [b("a", "l{o]w", 3), b("b", "q")],
        "json": [b("a", "l}ow", 3), b("b")],
        "pretty": [b("a", "low", 3)],
        "signs": [b("a", "[low", 3)],
    }


def test_task_config(spark, rows):
    doc = {
        "task_routes": {"t.a": {"queue": "email"}, "t.b": {}},
        "task_annotations": {"t.a": {"max_retries": 5, "rate_limit": "10/m"}},
        "beat_schedule": {"daily": {"task": "t.b", "schedule": {"crontab": "0 2 * * *"}}, "lost": {"task": "t.x", "schedule": {"crontab": "* * * * *"}}},
    }
    files = spark.createDataFrame([("a", json.dumps(doc)), ("b", "{}")], "path string, content string")
    jobs, warnings = configs.convert_celery_configs(files)
    assert rows(jobs.select("type", "queue", "max_attempts", "cron")) == [("t.a", "email", 5, None), ("t.b", "celery", None, "0 2 * * *")]
    assert sorted(r.message[:10] for r in warnings.collect()) == ["beat sched", "t.a: rate_"]


def test_queue_config(spark, rows):
    doc = {"queues": [{"name": "email", "jobs": [{"name": "send", "opts": {"attempts": 5, "backoff": {"type": "exponential", "delay": 1000}}}, {"name": "verify", "opts": {"attempts": 3, "delay": 5000}}, {"name": "odd", "opts": {"attempts": 1, "backoff": {"type": "weird"}}}]}]}
    files = spark.createDataFrame([("a", json.dumps(doc))], "path string, content string")
    jobs, warnings = configs.convert_bullmq_configs(files)
    assert rows(jobs.select("type", "max_attempts", "backoff", "delay_ms")) == [("odd", 1, "exponential", 0), ("send", 5, "exponential", 1000), ("verify", 3, "exponential", None)]
    assert warnings.count() == 2


def test_code_extraction(spark, rows):
    ruby = "class A\n  include Sidekiq::Worker\n  sidekiq_options queue: 'low', retry: 3\nend\nclass B < ApplicationJob\nend\n"
    js = "const q = new Queue('mail');\nconst w = new Worker('mail', f);\nq.add('send', {});\nq.add('send', {});"
    python = "x = 1\n" * 40 + "@app.task(queue='high', max_retries=4)\ndef go(x):\n    pass\n\n" + "y = 2\n" * 40 + "@shared_task\ndef plain():\n    pass\n"
    files = spark.createDataFrame([("a.rb", ruby), ("b.ts", js), ("c.py", python)], "path string, content string")
    assert rows(code.extract_all(files)) == sorted(
        [
            ("a.rb", "sidekiq", "A", "low", 3),
            ("a.rb", "sidekiq", "B", "default", None),
            ("b.ts", "bullmq", "mail", "mail", None),
            ("b.ts", "bullmq", "send", "", None),
            ("c.py", "celery", "go", "high", 4),
            ("c.py", "celery", "plain", "celery", None),
        ],
        key=repr,
    )
    strict = code.extract_jobs(files, "bullmq", strict=True)
    assert [r.name for r in strict.collect()] == ["send"]


def test_options_belong_to_their_own_definition(spark, rows):
    far = "  # note\n" * 60
    ruby = f"class A\n  include Sidekiq::Worker\n{far}  sidekiq_options queue: 'late', retry: 99999999999\nend\nclass B\n  include Sidekiq::Worker\nend\nclass C\n  include Sidekiq::Worker\n  sidekiq_options queue: 'fast'\nend"
    python = "queue='early'\n@celery.task\ndef go():\n    pass\n@shared_task(queue='slow')\ndef other():\n    pass"
    files = spark.createDataFrame([("a.rb", ruby), ("c.py", python)], "path string, content string")
    got = code.extract_all(files).select("name", "queue", "retry_count")
    assert rows(got) == [("A", "late", 99999999999), ("B", "default", None), ("C", "fast", None), ("go", "celery", None), ("other", "slow", None)]


def test_one_scan_for_all_frameworks(spark, tmp_path):
    spark.createDataFrame([("a", "x")], "path string, content string").write.parquet(str(tmp_path / "t"))
    found = code.extract_all(spark.read.parquet(str(tmp_path / "t")))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_priorities_beyond_32_bits_are_rejected(spark):
    from jobscope.plans import adapters

    raw = spark.createDataFrame([("q", '{"jobtype":"a","priority":3000000000}'), ("q", '{"jobtype":"a","priority":3}')], "queue string, payload string")
    found = adapters.convert("faktory", raw)
    assert [r.reason for r in found.rejects.collect()] == ["priority out of range"]
    assert [r.priority for r in found.jobs.collect()] == [3]


def test_temporal(spark, rows):
    text = "func A(ctx workflow.Context) error {\n workflow.ExecuteActivity(ctx, DoIt)\n workflow.ExecuteChildWorkflow(ctx, Sub)\n workflow.Go(ctx, func(c workflow.Context) {})\n}\nfunc B(ctx workflow.Context) error {\n}\n"
    files = spark.createDataFrame([("f.go", text)], "path string, content string")
    got = workflow_import.extract_workflows(files, "temporal")
    assert rows(got.workflows.select("workflow", "step_count", "parallel")) == [("A", 2, True), ("B", 0, False)]
    assert rows(got.steps.select("name", "kind", "job_type")) == [("DoIt", "task", "do.it"), ("Sub", "chain", "sub")]
    assert got.warnings.count() == 3
    whole_file = workflow_import.extract_workflows(files, "temporal", strict=True)
    assert rows(whole_file.workflows.select("workflow", "step_count", "parallel")) == [("A", 2, True), ("B", 2, True)]


def test_airflow_chains_and_lists(spark, rows):
    text = 'with DAG("d") as dag:\n' + "".join(f'  {n} = BashOperator(\n    task_id="{n}_id",\n  )\n' for n in "abcd") + "  a >> b >> c\n  [a, b] >> d\n"
    files = spark.createDataFrame([("f.py", text), ("g.py", "DAG('empty')")], "path string, content string")
    got = workflow_import.extract_workflows(files, "airflow")
    assert rows(got.edges.select("upstream", "downstream")) == [("a", "b"), ("a", "d"), ("b", "c"), ("b", "d")]
    assert [r.message for r in got.warnings.collect()] == ["DAG 'empty' has no detected tasks"]
    manifest = workflow_import.manifest_rows(got.steps)
    assert manifest.count() == 4 and manifest.filter("backoff = 'exponential' AND max_attempts = 3").count() == 4
    assert rows(workflow_import.workflow_kinds(got.workflows).select("workflow_type", "kind")) == [("d", "chain")]


def test_detection(spark, rows):
    files = spark.createDataFrame(
        [
            ("r1", "config/sidekiq.yml", ""),
            ("r1", "Gemfile", "gem 'sidekiq'"),
            ("r2", "Gemfile", "gem 'sidekiq'"),
            ("r2", "package.json", '{"bullmq": 1}'),
            ("r3", "requirements.txt", "celery"),
            ("r3", "celery.json", ""),
            ("r4", "README.md", "sidekiq"),
        ],
        "root string, path string, content string",
    )
    assert rows(code.detect_frameworks(files)) == sorted(
        [
            ("r1", "sidekiq", "high", "config/sidekiq.yml"),
            ("r2", "sidekiq", "medium", ""),
            ("r2", "bullmq", "high", ""),
            ("r3", "celery", "high", "celery.json"),
        ],
        key=repr,
    )


def test_manifest_rules(spark, rows):
    docs = [
        {"job_types": []},
        {"job_types": [{"type": "a"}, {"type": "a", "args": [{"name": ""}]}, {"type": ""}]},
    ]
    files = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "path string, content string")
    assert rows(validate.validate_manifest(files)) == sorted(
        [
            ("0", None, None, "manifest contains no job types"),
            ("1", 1, None, "duplicate job type: a"),
            ("1", 1, 0, "name is required"),
            ("1", 2, None, "type is required"),
        ],
        key=repr,
    )


def test_adapter_parses_each_payload_once(spark):
    raw = spark.createDataFrame([("q", "{}")], "queue string, payload string")
    plan = adapters.convert("river", raw).jobs.withColumn("x", F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tryParseJson") + plan.count("parse_json") <= 1
