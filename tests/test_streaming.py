"""Streams fed in several micro-batches give the batch results; repeated batches leave no duplicates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from jobscope.operators import history, stats
from jobscope.operators.ordered import unique_within
from jobscope.streaming import live
from jobscope.streaming.tables import EpochTable, drain

SCHEMA = "event_id bigint, ts timestamp_ntz, job_id string, type string, queue string, latency_ms double"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events in five files, each a later piece of time; one job has a third of them."""
    rnd = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        ts = start + dt.timedelta(seconds=i * 60 + rnd.randrange(50))
        job = "hot" if rnd.random() < 0.33 else f"job-{rnd.randrange(40)}"
        rows.append((i, ts, job, "job." + rnd.choice(["enqueued", "started", "completed", "failed"]), rnd.choice("ab"), rnd.random() * 10))
    folder = tmp_path_factory.mktemp("events")
    for part in range(5):
        df = spark.createDataFrame(rows[part * 300 : (part + 1) * 300], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(folder))
    batch = spark.read.schema(SCHEMA).parquet(str(folder))
    return str(folder), batch


def stream(spark, events):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(events[0])


def test_history(spark, events, rows):
    query, table = live.start_history(stream(spark, events), "1h")
    drain(query)
    want = stats.stats_history(events[1], "1h")
    assert rows(table.latest(["timestamp"]).select(want.columns)) == rows(want)
    assert table.read().select("epoch").distinct().count() == 5


def passed(batch, seconds=0):
    """The watermark after all events, less ``seconds``."""
    last = max(r.ts for r in batch.select("ts").collect())
    return last.replace(microsecond=last.microsecond // 1000 * 1000) - dt.timedelta(hours=1, seconds=seconds)


def disordered(spark, folder, parts, schema):
    """One file per part, and all rows as a table."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return feed, spark.createDataFrame([r for p in parts for r in p], schema)


def state_rows(query):
    """Rows in the last stateful operator after each batch."""
    return [p.stateOperators[-1].numRowsTotal for p in query.recentProgress if p.stateOperators]


def shuffled_parts(n=900, minutes=40):
    """Six parts whose events are up to ``minutes`` out of order, so they overlap; null and hot jobs among them."""
    rnd = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        job = rnd.choice([None, "hot", "hot", *[f"job-{k}" for k in range(12)]])
        ts = start + dt.timedelta(seconds=i * 60, microseconds=rnd.randrange(10**6))
        rows.append((i, ts, job, "job." + rnd.choice(["enqueued", "started", "completed", "failed"]), rnd.choice(["a", "b", None]), 1.0))
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.random() * minutes))
    return [late[k * n // 6 : (k + 1) * n // 6] for k in range(6)]


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("mixed"))
    disordered(spark, folder, shuffled_parts(), SCHEMA)
    batch = spark.read.schema(SCHEMA).parquet(folder)
    return folder, batch


def test_dashboard(spark, mixed, rows):
    changing, changes = live.start_changes(stream(spark, mixed))
    drain(changing)
    assert live.late_rows(changing) == 0
    query, table = live.start_dashboard(spark, changes)
    drain(query)
    want = history.latest_state(mixed[1]).groupBy("queue", "type").agg(F.count("*"))
    assert rows(live.dashboard_counts(table)) == rows(want)


def test_dashboard_forgets_finished_jobs(spark, tmp_path, rows):
    """Numbers stay right while state falls, and the table holds the newest numbers only."""
    day = lambda d, job, kind, n: (n, dt.datetime(2024, 1, 1 + d), job, "job." + kind, "a", 1.0)
    parts = [[day(0, f"j{k}", "started", k) for k in range(5)], [day(1, f"j{k}", "completed", 10 + k) for k in range(4)], [day(9, "x", "started", 20)], [day(10, "x", "failed", 21)]]
    feed, everything = disordered(spark, str(tmp_path / "in"), parts, SCHEMA)
    changing, changes = live.start_changes(feed, forget_after=dt.timedelta(days=2), path=str(tmp_path / "changes"))
    drain(changing)
    assert max(state_rows(changing)) == 5 + 1 and state_rows(changing)[-1] == 2
    for _ in range(2):
        query, table = live.start_dashboard(spark, changes, path=str(tmp_path / "table"), checkpoint=str(tmp_path / "check"))
        drain(query)
    assert rows(live.dashboard_counts(table)) == [("a", "job.completed", 4), ("a", "job.failed", 1), ("a", "job.started", 1)]
    assert len(list((tmp_path / "table").glob("epoch=*"))) <= 2


@pytest.mark.parametrize("seconds", [0, 500, 5000])
def test_unique(spark, mixed, rows, seconds):
    query, table = live.start_unique(stream(spark, mixed), "job_id", seconds)
    drain(query)
    want = unique_within(mixed[1], "job_id", "ts", "event_id", seconds, heavy=[]).where(F.col("ts") <= F.lit(passed(mixed[1])).cast("timestamp_ntz"))
    assert rows(table.read().drop("epoch")) == rows(want)
    assert table.read().select("epoch").distinct().count() > 3 and live.late_rows(query) == 0


def test_unique_forgets(spark, tmp_path, rows):
    """State holds what the window still needs; ties, a number as key and late events."""
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "event_id bigint, ts timestamp_ntz, k bigint"
    big = 2**53 + 1
    parts = [
        [(2, at(1), big), (1, at(1), big), (3, at(1, 20), big), (4, at(1, 5), big - 1)],
        [(5, at(1, 10), big - 1), (6, at(2), big), (7, None, big)],
        [(8, at(9), 1)],
        [(10, at(12), 2), (11, at(10), 3)],
        [(9, at(3), big), (12, at(20), 4)],
    ]
    feed, _ = disordered(spark, str(tmp_path), parts, schema)
    query, table = live.start_unique(feed, "k", 1800)
    drain(query)
    assert rows(table.read().drop("epoch")) == sorted([(big, at(1), 1), (big - 1, at(1, 5), 4), (big, at(2), 6), (1, at(9), 8), (2, at(12), 10), (3, at(10), 11)], key=repr)
    assert live.late_rows(query) == 1
    assert state_rows(query)[-1] == 1 and max(state_rows(query)) >= 3


def test_unique_keeps_buckets(spark, mixed, rows, monkeypatch):
    """Keys that share a row of state are judged each by itself; a null tie comes last."""
    monkeypatch.setattr(live, "UNIQUE_BUCKETS", 2)
    few = lambda df: df.withColumn("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_id")))
    query, table = live.start_unique(few(stream(spark, mixed)), "job_id", 500)
    drain(query)
    want = unique_within(few(mixed[1]).withColumn("event_id", F.coalesce("event_id", F.lit(10**9))), "job_id", "ts", "event_id", 500, heavy=[])
    want = want.where(F.col("ts") <= F.lit(passed(mixed[1])).cast("timestamp_ntz")).withColumn("event_id", F.nullif("event_id", F.lit(10**9)))
    assert rows(table.read().drop("epoch")) == rows(want)
    assert 0 < max(state_rows(query)) <= 2


def test_unique_writes_the_rest_at_the_end(spark, mixed, rows, tmp_path):
    ends = live.open_ends(spark, str(tmp_path / "ends"))
    want = unique_within(mixed[1], "job_id", "ts", "event_id", 500, heavy=[])
    counts = []
    for ended in (False, True):
        if ended:
            live.mark_end(spark, ends)
        query, table = live.start_unique(stream(spark, mixed), "job_id", 500, path=str(tmp_path / "t"), ends=ends, checkpoint=str(tmp_path / "c"))
        drain(query)
        counts.append(table.read().count())
    assert counts[0] < counts[1] and rows(table.read().drop("epoch")) == rows(want)
    assert state_rows(query)[-1] == 0


def test_unique_needs_a_number_as_tie(spark, events):
    with pytest.raises(ValueError):
        live.start_unique(stream(spark, events), "job_id", 5, tie="type")


def test_latency(spark, mixed, rows):
    query, table = live.start_latency(stream(spark, mixed), 3000)
    drain(query)
    want = history.start_to_finish(mixed[1], 3000, heavy=[]).where(F.col("finished_at") <= F.lit(passed(mixed[1], 3000)).cast("timestamp_ntz"))
    assert rows(table.read().drop("epoch")) == rows(want) and want.where("job_id is null").count() > 0
    assert table.read().select("epoch").distinct().count() > 3


def test_out_of_order_batches(spark, tmp_path, rows):
    """A finish that arrives after a later start meets the earlier one; old events leave the join's state."""
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    parts = [
        [(1, at(10, 0), "a", "job.started"), (2, at(10, 30), "a", "job.started")],
        [(3, at(10, 20), "a", "job.completed"), (4, at(10, 40), "a", "job.failed"), (4, at(10, 40), "a", "job.failed"), (8, at(10, 30), "a", "job.completed")],
        [(5, at(20, 0), "b", "job.started")],
        [(6, at(20, 5), "b", "job.completed"), (7, at(20, 6), "a", "job.completed"), (9, at(23, 0), "c", "job.started")],
    ]
    schema = "event_id bigint, ts timestamp_ntz, job_id string, type string"
    feed, everything = disordered(spark, str(tmp_path / "in"), parts, schema)
    query, table = live.start_latency(feed, 3600, path=str(tmp_path / "out"))
    drain(query)
    assert rows(table.read().drop("epoch")) == rows(history.start_to_finish(everything, 3600, heavy=[]).distinct())
    assert sorted(p.name[:6] for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["epoch="] * len(list((tmp_path / "out").glob("epoch=*")))
    joined = [[op.numRowsTotal for op in p.stateOperators if "Join" in op.operatorName] for p in query.recentProgress]
    assert max(map(sum, joined)) >= 5 and sum(joined[-1]) <= 2


def test_rollup(spark, tmp_path, rows):
    """Days, hours and five minutes of closed days, from one query; equal to the batch forms."""
    parts = shuffled_parts(6 * 24 * 60 // 2, 30)
    parts = [[(i, ts + (ts - dt.datetime(2024, 1, 1)), *rest) for i, ts, *rest in p] for p in parts]
    feed, everything = disordered(spark, str(tmp_path), parts, SCHEMA)
    query, table = live.start_rollup(feed)
    drain(query)
    closed = passed(everything).replace(hour=0, minute=0, second=0, microsecond=0)
    got = table.read().drop("epoch")
    assert closed > dt.datetime(2024, 1, 3)
    for period in ("5m", "1h", "1d"):
        want = stats.stats_history(everything, period).where(F.col("timestamp") < F.lit(closed).cast("timestamp_ntz"))
        assert rows(got.where(F.col("period") == period).drop("period").select(want.columns)) == rows(want)
    assert table.read().select("epoch").distinct().count() > 1
    sources = query.lastProgress.sources
    assert len(sources) == 1


def test_history_of_all_periods(events, rows):
    got = stats.stats_history_all(events[1])
    for period in ("5m", "1h", "1d"):
        want = stats.stats_history(events[1], period)
        assert rows(got.where(F.col("period") == period).select(want.columns)) == rows(want)


def test_subscriptions(spark, events, rows, tmp_path):
    subs = spark.createDataFrame([("s1", "u", ["job.failed", "job.failed"], True), ("s2", "u", ["job.enqueued"], False)], "id string, url string, events array<string>, active boolean")
    query, table = live.start_subscription_match(stream(spark, events))
    drain(query)
    want = stats.match_subscriptions(subs, events[1])
    assert want.count() == 1 and rows(live.subscription_matches(subs, table).select(want.columns)) == rows(want)
    compacted = table.compact(["type"], str(tmp_path / "compact"))
    assert rows(live.subscription_matches(subs, compacted).select(want.columns)) == rows(want)


def test_filter(spark, events):
    query, table = live.start_filter(stream(spark, events), ["job.failed"], "a")
    drain(query)
    assert table.read().count() == events[1].filter("type = 'job.failed' AND queue = 'a'").count()


def test_dual_run_cut_over(spark, events):
    shares = iter([0, 50, 100, 100, 100])
    query, routed, counters = live.start_dual_run(stream(spark, events).select("event_id", "job_id"), lambda: next(shares))
    drain(query)
    assert routed.read().count() == 1500
    per_batch = [(r.target, r.legacy) for r in counters.read().orderBy("epoch").collect()]
    assert per_batch[0] == (0, 300) and per_batch[2:] == [(300, 0)] * 3
    assert sum(a + b for a, b in per_batch) == 1500


def test_stale_workers(spark, events):
    beats = stream(spark, events).select(F.col("job_id").alias("worker_id"), "ts")
    query, table = live.start_stale(beats, "90 minutes")
    drain(query)
    got = {(r.worker_id, r.last_heartbeat) for r in table.read().collect()}
    last = max(r.ts for r in events[1].select("ts").collect())
    want = set()
    by_worker = {}
    for r in events[1].orderBy("ts").collect():
        by_worker.setdefault(r.job_id, []).append(r.ts)
    gap = dt.timedelta(minutes=90)
    for worker, times in by_worker.items():
        for a, b in zip(times, times[1:] + [None]):
            if (b is None or b - a >= gap) and a + gap <= last - dt.timedelta(hours=1):
                want.add((worker, a))
    assert got == want


def test_repeated_batch_replaces_its_part(spark, tmp_path):
    table = EpochTable(spark, str(tmp_path / "t"), "a bigint")
    assert table.read().count() == 0
    part = spark.createDataFrame([(1,), (2,)], "a bigint")
    table.write(part, 0)
    table.write(part, 0)
    table.write(part, 1)
    assert table.read().count() == 4 and table.read(before=1).count() == 2


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    folder = str(tmp_path)
    for times in ([at], [at + dt.timedelta(hours=5)], [at - dt.timedelta(hours=3), at + dt.timedelta(hours=6)], [at + dt.timedelta(hours=6)]):
        rows = [(1, t, "j", "job.enqueued", "a", 1.0) for t in times]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    query, table = live.start_history(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), "1h")
    drain(query)
    assert table.latest(["timestamp"]).agg(F.sum("enqueued")).first()[0] == 4
    assert live.late_rows(query) == 1


def test_sender(spark, events, tmp_path):
    target = str(tmp_path)

    def send(batch):
        import uuid

        with open(f"{target}/{uuid.uuid4()}", "w") as f:
            f.write(str(len(batch)))

    drain(live.start_sender(stream(spark, events).select("job_id"), send, size=100))
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 1500
