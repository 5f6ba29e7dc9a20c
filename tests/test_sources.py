import json
import os
import pickle
import random
from collections import defaultdict

import pytest

from jobscope.entries import migration
from jobscope.entries.registry import Tables
from jobscope.session import work_dir
from jobscope.sources import keyspace, readers, sinks
from jobscope.sources.documents import read_elements


def test_line_numbers_over_splits(spark, tmp_path):
    want = set()
    for name in ("a", "b"):
        lines = ["" if i % 7 == 0 else f'{{"n":"{name}{i}"}}' for i in range(3000)]
        (tmp_path / f"{name}.ndjson").write_text("\r\n".join(lines) + "\n")
        want |= {(f"{name}.ndjson", i + 1, line) for i, line in enumerate(lines) if line}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
    try:
        df = readers.read_job_ndjson(spark, str(tmp_path))
        got = {(r.file.split("/")[-1], r.line, r.raw) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_export_document(spark, tmp_path):
    doc = {"version": "1.0", "source": {"backend": "b"}, "jobs": [{"id": "1", "type": "t", "queue": "q", "state": "available", "args": [1, {"a": 2}]}], "stats": {"total_jobs": 1}}
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(doc, indent=2))
    bad.write_text(json.dumps(doc | {"version": "2.0"}))
    header, jobs = readers.read_export_document(spark, str(good))
    assert header.first().source.backend == "b" and jobs.first().id == "1"
    with pytest.raises(Exception, match="unsupported export version: 2.0"):
        readers.read_export_document(spark, str(bad))[1].collect()


def nasty_documents(seed, number, most):
    """Documents whose strings and members look like structure, with the array in different places."""
    rnd = random.Random(seed)
    texts = ['}', '{"jobs": [', '\\', '\\"', '"', '\\\\', "]}", "\n", "é😀", "", "x" * 30, '", "jobs": [{']

    def value(depth):
        kind = rnd.random()
        if depth and kind < 0.25:
            return {rnd.choice(["jobs", "a}", 'q"', "b"]) + str(i): value(depth - 1) for i in range(rnd.randint(0, 4))}
        if depth and kind < 0.5:
            return [value(depth - 1) for _ in range(rnd.randint(0, 4))]
        return rnd.choice([1, None, True, -2.5, *texts])

    out = []
    for _ in range(number):
        jobs = [{"id": str(i), "type": rnd.choice(texts), "v": value(3), "jobs": rnd.choice([[], [{"x": 1}], {}])} for i in range(rnd.choice([0, 1, 3, most]))]
        members = [("version", "1.0"), ("options", {"jobs": [1, {"y": "}"}], "queues": ["}"]}), ("jobs", jobs), ("stats", {"total_jobs": len(jobs)}), ("more", [[{"z": []}], "jobs"])]
        rnd.shuffle(members)
        style = rnd.choice([{}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
        out.append((jobs, dict(members), json.dumps(dict(members), **style) + rnd.choice(["", "\n", " \n\t"])))
    return out


@pytest.mark.parametrize("block", [41, 97, 700, 1 << 20])
def test_elements_of_documents(spark, tmp_path, block):
    """Blocks that begin anywhere, also inside strings, names and escapes, give each element once, and the rest."""
    documents = nasty_documents(block, 12 if block > 100 else 3, 60 if block > 100 else 2)
    assert sum(len(text) for *_, text in documents) / block < 300
    for i, (_, _, text) in enumerate(documents):
        (tmp_path / f"{i:02}.json").write_text(text, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{block}b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rest, elements = read_elements(spark, str(tmp_path), "jobs")
        rest, elements = rest.collect(), elements.orderBy("file", "block", "number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = defaultdict(list)
    for r in elements:
        got[r.file].append(json.loads(r.raw))
    around = {r.file: json.loads(r.raw) for r in rest}
    assert len(around) == len(documents)
    order = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(([got[f], around[f]] for f in around), key=order) == sorted(([jobs, whole | {"jobs": []}] for jobs, whole, _ in documents), key=order)


def test_elements_that_are_no_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": "1.0", "jobs": [{"id": "1"}, 5]}')
    with pytest.raises(Exception, match="no objects"):
        read_elements(spark, str(tmp_path), "jobs")[1].collect()


def test_documents_round_trip(spark, tmp_path):
    jobs = spark.range(1000).selectExpr("cast(id as string) AS id", "concat('t}', id) AS type", "'q' AS queue", "'available' AS state", "try_parse_json('[{\"a\":\"}\"}]') AS args")
    sinks.write_export_documents(jobs.repartition(2), str(tmp_path / "d"), {"backend": "b"}, "2024-01-01T00:00:00Z")
    header, back = readers.read_export_document(spark, str(tmp_path / "d"))
    assert header.count() == 2 and {r.source.backend for r in header.collect()} == {"b"}
    assert sorted(back.selectExpr("id", "type", "to_json(args)").collect()) == sorted(jobs.selectExpr("id", "type", "to_json(args)").collect())


def test_export_folder(spark, tmp_path):
    jobs = spark.createDataFrame([("1", "t", "q", "available"), ("2", "t", "r", "scheduled")], "id string, type string, queue string, state string")
    path = str(tmp_path / "out")
    sinks.write_export(jobs, path, {"backend": "b", "url": "u", "version": "1"}, "2024-01-01T00:00:00Z")
    header, back = readers.read_export(spark, path)
    assert back.count() == 2 and header.first().version == "1.0"
    assert spark.read.json(f"{path}/stats").filter("grouping = 'total'").first().n == 2
    (tmp_path / "out" / "header").rename(tmp_path / "out" / "old")
    spark.createDataFrame([('{"version":"3"}',)], "value string").write.text(f"{path}/header")
    with pytest.raises(Exception, match="unsupported export version"):
        readers.read_export(spark, path)[1].collect()
    (tmp_path / "out" / "header").rename(tmp_path / "out" / "third")
    (tmp_path / "out" / "header").mkdir()
    with pytest.raises(Exception, match="no header"):
        readers.read_export(spark, path)[1].collect()


def test_job_lines_keep_raw_json(spark):
    jobs = spark.createDataFrame([('a"b', "q", "[1e5, 1.0]", None, "", "{}"), ("t", "q", None, 3, "2024", '{"k":1}')], "type string, queue string, args string, priority int, scheduled_at string, meta string")
    got = [r.value for r in sinks.job_lines(jobs).collect()]
    assert got == ['{"type":"a\\"b","queue":"q","args":[1e5, 1.0]}', '{"type":"t","queue":"q","args":null,"priority":3,"scheduled_at":"2024","meta":{"k":1}}']


def test_api_dump_and_configs(spark, tmp_path):
    (tmp_path / "dump.json").write_text('{"queue":"q","size":2,"jobs":[{"jid":"1"},{"jid":"2"}]}\n{"queue":"e","size":0,"jobs":[]}\n')
    sizes, raw = keyspace.read_api_dump(spark, str(tmp_path / "dump.json"))
    assert sizes.count() == 2 and sorted(r.payload for r in raw.collect()) == ['{"jid":"1"}', '{"jid":"2"}']
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "deep" / "x.py").write_text("a\nb")
    (tmp_path / "src" / "y.rb").write_text("c")
    assert readers.read_source_tree(spark, str(tmp_path / "src")).count() == 2
    assert readers.read_source_tree(spark, str(tmp_path / "src"), "*.py").first().content == "a\nb"
    assert readers.read_configs(spark, str(tmp_path / "src" / "y.rb")).first().content == "c"


def test_unregistered_queue_lists_are_not_read(spark, rows):
    dump = [("queues", "set", 0, None, "a", None), ("queue:a", "list", 0, None, "p1", None), ("queue:b", "list", 0, None, "p2", None), ("retry", "zset", 0, None, "p3", 1.0)]
    df = spark.createDataFrame(dump, "key string, kind string, idx bigint, field string, value string, score double")
    assert rows(keyspace.sidekiq_rows(df).select("source_set", "payload")) == [("queue", "p1"), ("retry", "p3")]


def test_event_lines_stream(spark, tmp_path):
    from jobscope.streaming.tables import EpochTable, ddl, drain, start

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text('event: x\ndata: {"type":"job","event":"done","job_id":"1","queue":"q"}\n\ndata:  plain \n')
    stream = readers.parse_event_lines(readers.read_event_stream(spark, str(tmp_path / "in")))
    table = EpochTable(spark, work_dir(spark, "sse"), ddl(stream))
    drain(start(stream, table.write, "append"))
    got = {r.data: (r.is_json, r.job_id) for r in table.read().collect()}
    assert got == {'{"type":"job","event":"done","job_id":"1","queue":"q"}': (True, "1"), "plain": (False, None)}


def test_batches_are_sent_from_tasks(spark, tmp_path):
    target = str(tmp_path)

    def send(batch):
        import uuid

        with open(f"{target}/{uuid.uuid4()}", "w") as f:
            f.write(str(len(batch)))

    sinks.send_in_batches(spark.range(250).coalesce(1), send, size=100)
    assert sorted(p.read_text() for p in tmp_path.iterdir()) == ["100", "100", "50"]


def test_work_dir_follows_the_session_setting():
    class Session:
        def __init__(self, setting, master):
            self.conf = {"spark.checkpoint.dir": setting} if setting else {}
            self.sparkContext = self
            self.master = master

        def getConf(self):
            return {}

    assert work_dir(Session("hdfs://shared/", "yarn"), "x").startswith("hdfs://shared/jobscope-x-")
    assert work_dir(Session(None, "local[2]"), "x").startswith("/tmp/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session(None, "yarn"), "x")


def test_sink_with_commits(spark, tmp_path):
    """A task that fails gives the write up; started again, the same batches replace what had come through."""
    jobs = spark.range(1050, numPartitions=3).selectExpr("cast(id as string) AS id")
    folder, ended = str(tmp_path), []

    def send(key, batch):
        if not os.path.exists(f"{folder}/mended") and key[1:] == (1, 2):
            raise RuntimeError("the target is away")
        with open(f"{folder}/{'-'.join(map(str, key))}", "w") as f:
            f.write(" ".join(r["id"] for r in batch))

    def run():
        sinks.send_committed(jobs, send, "r1", finish=lambda done, sent: ended.append((done, sent)))

    with pytest.raises(Exception, match="the target is away"):
        run()
    open(f"{folder}/mended", "w").close()
    run()
    run()
    files = [p for p in tmp_path.iterdir() if p.name.startswith("r1-")]
    assert sorted(int(i) for p in files for i in p.read_text().split()) == list(range(1050))
    assert sorted(p.name for p in files) == sorted(f"r1-{t}-{b}" for t in range(3) for b in range(4))


def test_the_driver_sees_little_of_a_document(spark, tmp_path, monkeypatch):
    """Brackets inside strings, which look like nesting from a wrong beginning, are not sent to the driver."""
    text = "".join(rf']}}{{\"n{i}\": [' for i in range(50))
    jobs = ",".join(f'{{"id": "{i}", "type": "{text}"}}' for i in range(40))
    (tmp_path / "a.json").write_text(f'{{"version": "1.0", "jobs": [{jobs}]}}')
    sizes, frame = [], type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: sizes.append(collect(self)) or sizes[-1])
    elements = read_elements(spark, str(tmp_path), "jobs")[1]
    assert 0 < sum(len(pickle.dumps(rows)) for rows in sizes) < 3000
    monkeypatch.undo()
    assert elements.count() == 40


def test_documents_grow_in_number(spark, tmp_path, monkeypatch):
    """Documents beyond three hold so many jobs each, as one task writes a document."""
    spark.range(400).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice", "timestamp_ntz'2024-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    tables = Tables(spark, str(tmp_path))
    files = lambda: spark.read.text(migration._documents(tables)).select("_metadata.file_path").distinct().count()
    assert files() == 3
    monkeypatch.setattr(migration, "DOCUMENT_JOBS", 50)
    assert files() == 8


def test_blocks_do_not_grow_in_number(spark, tmp_path, monkeypatch):
    """Sixteen times the bytes are read in as many tasks; the session's own size is put back."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    monkeypatch.setattr(migration, "BLOCKS", 8)
    for n in (4000, 64000):
        path = str(tmp_path / str(n))
        spark.range(n).selectExpr("concat('line of some length ', id) AS value").coalesce(1).write.text(path)
        with migration._blocks(Tables(spark, str(tmp_path)), path, 1000):
            assert 4 <= spark.read.text(path).rdd.getNumPartitions() <= 9
    assert spark.conf.get(name) == before
