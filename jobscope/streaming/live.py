"""Live operators.  Each ``start_*`` returns (query, table): a running query and where its rows go.

All state is Spark's own: windows, sessions, both sides of a stream-stream join, and a value with a timer per key.
Event time is ``ts``.  Operators with state drop rows later than the watermark, and Spark counts them; those that
must see a key's events in order give their results once the watermark has passed them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegralType

from jobscope.functions import route
from jobscope.operators import stats
from jobscope.schemas import NDJSON_BATCH
from jobscope.session import work_dir
from jobscope.sources.sinks import send_in_batches
from jobscope.streaming import state
from jobscope.streaming.tables import EpochTable, ddl, start

WATERMARK = "1 hour"
#: Events after which a job is done.
TERMINAL_EVENTS = ("job.completed", "job.failed", "job.cancelled", "job.discarded")


def with_event_time(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Event time as an instant (zoneless times are read as UTC) with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def filter_events(events: DataFrame, types: Sequence[str] = (), queue: str | None = None) -> DataFrame:
    """Events of the listed types and the queue; stateless, so it works on streams and tables."""
    if types:
        events = events.filter(F.col("type").isin(list(types)))
    if queue:
        events = events.filter(F.col("queue") == queue)
    return events


def _table(stream: DataFrame, name: str, path: str | None) -> EpochTable:
    return EpochTable(stream.sparkSession, path or work_dir(stream.sparkSession, name), ddl(stream))


def start_filter(events: DataFrame, types: Sequence[str] = (), queue: str | None = None, path: str | None = None, **options) -> tuple[StreamingQuery, EpochTable]:
    chosen = filter_events(events, types, queue)
    table = _table(chosen, "filter", path)
    return start(chosen, table.write, "append", **options), table


def start_history(events: DataFrame, period: str = "1h", path: str | None = None, **options) -> tuple[StreamingQuery, EpochTable]:
    """Statistics per period, updated as events arrive; ``table.latest(["timestamp"])`` is the current state."""
    points = stats.stats_history(with_event_time(events), period)
    table = _table(points, "history", path)
    return start(points, table.write, "update", **options), table


def start_rollup(events: DataFrame, watermark: str = WATERMARK, path: str | None = None, **options) -> tuple[StreamingQuery, EpochTable]:
    """Statistics of closed days with their hours and five-minute periods, from one pass over the events.

    Periods are built from each other: counts and sums of five minutes merge into hours and those into days, by
    three windowed aggregates one behind the other.  Each carries the periods that it is made of, at most 12 and 24,
    so a day is written once, when the watermark has passed its end, with rows (period, timestamp, ...).
    """
    parts = stats.THROUGHPUT_PARTS
    own = F.struct("start", *parts)

    def level(rows: DataFrame, period: str, inner: list[str]) -> DataFrame:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in inner]
        merged = [*stats.throughput_merged(), *lists] if inner else stats.throughput_parts()
        found = rows.groupBy(F.window("ts", stats.PERIODS[period]).alias("w")).agg(*merged)
        found = found.select(F.window_time("w").alias("ts"), F.col("w.start").alias("start"), *parts, *inner)
        return found.withColumn(f"p{period}", F.array(own))

    fives = level(with_event_time(events, watermark), "5m", [])
    days = level(level(fives, "1h", ["p5m"]), "1d", ["p5m", "p1h"])

    def named(period: str) -> Column:
        return F.transform(f"p{period}", lambda x: F.struct(F.lit(period).alias("period"), *[x[c].alias(c) for c in ("start", *parts)]))

    each = F.concat(*map(named, stats.PERIODS))
    rows = days.select(F.inline(each)).select("period", F.col("start").cast("timestamp_ntz").alias("timestamp"), *stats.throughput_of_parts())
    table = _table(rows, "rollup", path)
    return start(rows, table.write, "append", **options), table


def start_changes(
    events: DataFrame,
    terminal: Sequence[str] = TERMINAL_EVENTS,
    forget_after: dt.timedelta = dt.timedelta(days=30),
    watermark: str = WATERMARK,
    path: str | None = None,
    retention: str = "7d",
    **options,
) -> tuple[StreamingQuery, str]:
    """What each event changes in the numbers of jobs per queue and latest event type; returns (query, folder).

    A job that moves on gives a row -1 for what it leaves and a row +1 for what it comes to.  A job is remembered
    by its latest event, and no longer than ``forget_after`` once that event is ``terminal``; should it come back
    later, it counts as a new job.  An event that is older than the job's latest one changes nothing.  Files are
    no longer listed after ``retention``; :func:`start_dashboard` must have read them by then.
    """
    rows = events.select(
        state.key_text("job_id").alias("g"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_id").cast("bigint").alias("id"),
        "queue",
        "type",
    ).where(F.col("ts").isNotNull())
    newest = state.thinned(rows, ["g"], ["-us", "-id"]).withWatermark("ts", watermark)
    step = state.state_change(frozenset(terminal), int(forget_after.total_seconds() * 1000))
    changes = newest.groupBy("g").applyInPandasWithState(step, state.CHANGE_ROWS, state.CHANGE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    folder = path or work_dir(events.sparkSession, "changes")
    writer = changes.writeStream.format("parquet").outputMode("append").option("path", folder).option("retention", retention)
    writer = writer.option("checkpointLocation", options.pop("checkpoint", None) or work_dir(events.sparkSession, "stream"))
    return writer.trigger(**(options or {"availableNow": True})).start(), folder


def start_dashboard(spark: SparkSession, changes: str, path: str | None = None, **options) -> tuple[StreamingQuery, EpochTable]:
    """Jobs per queue and latest event type, summed from the folder of :func:`start_changes`.

    The state is one number per queue and type, and the table holds the newest numbers only, however many batches
    there were.  Read it with :func:`dashboard_counts`.
    """
    rows = spark.readStream.schema(state.CHANGE_ROWS).parquet(changes)
    counts = rows.groupBy("queue", "type").agg(F.sum("change").alias("jobs"))
    table = _table(counts, "dashboard", path)
    return start(counts, table.replace, "complete", **options), table


def dashboard_counts(table: EpochTable) -> DataFrame:
    """Jobs per queue and latest event type."""
    return table.newest().where("jobs > 0")


#: Keys are dealt to this many buckets, each a row of state.
UNIQUE_BUCKETS = 4096
#: A null tie comes last.
LAST_TIE = 2**63 - 1
#: An instant after all events.
END = dt.datetime(9999, 1, 1, tzinfo=dt.timezone.utc)


def open_ends(spark: SparkSession, path: str | None = None) -> str:
    """A folder in which :func:`mark_end` says that a stream has ended."""
    path = path or work_dir(spark, "ends")
    spark.createDataFrame([], "ts timestamp").write.parquet(path)
    return path


def mark_end(spark: SparkSession, ends: str) -> None:
    """No more events come: the watermark of the streams with ``ends``, run again, passes all they have read."""
    spark.createDataFrame([(END,)], "ts timestamp").write.mode("append").parquet(ends)


def start_unique(events: DataFrame, key: str, within_seconds: int, tie: str = "event_id", watermark: str = WATERMARK, path: str | None = None, ends: str | None = None, **options) -> tuple[StreamingQuery, EpochTable]:
    """Events kept when a key may occur once per window, written once the watermark has passed them.

    A key's state is its last kept time and the events that the watermark has not passed; it is dropped when the
    watermark is a window beyond the last kept one.  ``ends`` names a folder of :func:`open_ends`: once it is marked,
    the query, started again with its checkpoint, writes the events that still waited.  Of events at one instant the
    one with the smallest ``tie``, a number, counts; a null one comes last.  Rows without a time are left out; a null key is a key.
    """
    kinds = {f.name: f.dataType for f in events.schema.fields}
    if not isinstance(kinds[tie], IntegralType):
        raise ValueError("the tie must be an integer column")
    instant = F.col("ts").cast("timestamp")
    rows = events.where(F.col("ts").isNotNull()).select(
        state.key_text(key).alias("g"), instant.alias("ts"), F.unix_micros(instant).alias("us"), F.coalesce(F.col(tie).cast("bigint"), F.lit(LAST_TIE)).alias("tie")
    )
    rows = state.thinned(rows, ["g", "us"], ["tie"])
    if ends:
        marks = events.sparkSession.readStream.schema("ts timestamp").parquet(ends)
        rows = rows.unionByName(marks, allowMissingColumns=True)
    # A condition on the event time stays behind the watermark, so that a mark moves it before it goes.
    rows = rows.withWatermark("ts", watermark).where(F.col("g").isNotNull() | (F.col("ts") < F.lit(END)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(UNIQUE_BUCKETS)))
    step = state.keep_once(int(within_seconds * 1_000_000))
    kept = rows.groupBy("bucket").applyInPandasWithState(step, state.UNIQUE_ROWS, state.UNIQUE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    kept = kept.select(state.key_value("g", kinds[key]).alias(key), F.timestamp_micros("us").cast(kinds["ts"]).alias("ts"), F.nullif("tie", F.lit(LAST_TIE)).cast(kinds[tie]).alias(tie))
    table = _table(kept, "unique", path)
    return start(kept, table.write, "append", **options), table


def start_subscription_match(events: DataFrame, path: str | None = None, **options) -> tuple[StreamingQuery, EpochTable]:
    """Events counted per type as they arrive: a batch writes one row per type it saw, however many subscribe.

    Read it with :func:`subscription_matches`, which sees the subscriptions as they are then.
    """
    counted = stats.count_types(events)
    table = _table(counted, "types", path)
    return start(counted, table.write, "update", **options), table


def subscription_matches(subscriptions: DataFrame, table: EpochTable) -> DataFrame:
    """Matched events per active subscription and type."""
    return stats.match_type_counts(subscriptions, table.latest(["type"]))


def start_dual_run(jobs: DataFrame, percent: int | Callable[[], int], path: str | None = None, **options) -> tuple[StreamingQuery, EpochTable, EpochTable]:
    """Send a share of jobs to the target and the rest to the legacy side.

    Returns (query, routed, counters).  ``routed`` holds the jobs with their route, one sub-folder per
    route.  ``percent`` may be a function, asked once per batch: 100 cuts over, 0 rolls back.
    """
    spark = jobs.sparkSession
    routed = jobs.withColumn("route", route("job_id", 0))
    base = path or work_dir(spark, "dual")
    sink = EpochTable(spark, f"{base}/jobs", ddl(routed))
    counters = EpochTable(spark, f"{base}/counters", "target bigint, legacy bigint, percent int")

    def step(batch: DataFrame, epoch: int) -> None:
        share = percent() if callable(percent) else percent
        seen = Observation(f"routes-{epoch}")
        split = batch.withColumn("route", route("job_id", share)).observe(
            seen, F.count_if(F.col("route") == "target").alias("target"), F.count_if(F.col("route") == "legacy").alias("legacy")
        )
        split.write.mode("overwrite").partitionBy("route").parquet(f"{sink.path}/epoch={epoch}")
        counts = seen.get
        row = [(counts["target"], counts["legacy"], share)]
        counters.write(spark.createDataFrame(row, counters.schema), epoch)

    return start(jobs, step, "append", **options), sink, counters


def start_stale(heartbeats: DataFrame, stale_after: str = "5 minutes", watermark: str = WATERMARK, path: str | None = None, **options) -> tuple[StreamingQuery, EpochTable]:
    """Workers that fell silent: one row per gap, written once the watermark has passed it.

    A run of heartbeats is a session that ends ``stale_after`` the last one.  Sessions are merged in each task
    before the shuffle (a setting of the session, set here), so a chatty worker is not gathered in one place.
    """
    heartbeats.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    sessions = (
        with_event_time(heartbeats, watermark)
        .groupBy("worker_id", F.session_window("ts", stale_after).alias("s"))
        .agg(F.count("*").alias("heartbeats"), F.max("ts").alias("last_heartbeat"))
        .select("worker_id", F.col("s.end").alias("stale_at"), "last_heartbeat", "heartbeats")
    )
    table = _table(sessions, "stale", path)
    return start(sessions, table.write, "append", **options), table


def start_sender(jobs: DataFrame, send: Callable[[list[dict]], None], size: int = NDJSON_BATCH, **options) -> StreamingQuery:
    """Hand every arriving job to ``send`` in batches from the tasks; at least once after a failure."""
    return start(jobs, lambda batch, epoch: send_in_batches(batch, send, size), "append", **options)


def late_rows(query: StreamingQuery) -> int:
    """Rows the windowed operators of a query dropped because they were later than the watermark."""
    return sum(op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)


def start_latency(events: DataFrame, within_seconds: int = 3600, watermark: str = WATERMARK, path: str | None = None, **options) -> tuple[StreamingQuery, EpochTable]:
    """Latency of each finish from the job's latest start before it, written when the watermark is ``within_seconds``
    beyond the finish.

    Starts and finishes are joined as two streams, within the time limit, so Spark drops what can meet nothing any
    more; an aggregate over the finish picks its closest start.  An event that arrives twice counts once.
    """
    kind = events.schema["ts"].dataType
    timed = with_event_time(events.select("job_id", "event_id", "ts", "type"), watermark)
    starts = timed.where(F.col("type") == "job.started").select(F.col("job_id").alias("_job"), F.col("ts").alias("_ts"), F.col("event_id").alias("_id"))
    ends = timed.where(F.col("type").isin("job.completed", "job.failed"))
    met = (
        F.col("job_id").eqNullSafe(F.col("_job"))
        & (F.col("_ts") <= F.col("ts"))
        & (F.col("_ts") >= F.col("ts") - F.expr(f"INTERVAL {int(within_seconds)} SECONDS"))
        & ((F.col("_ts") < F.col("ts")) | (F.col("_id") < F.col("event_id")))
    )
    # One event time goes on: the start's becomes a plain number.
    pairs = ends.join(starts, met).select("ts", "job_id", "event_id", "type", F.unix_micros("_ts").alias("_us"))
    closest = pairs.groupBy("ts", "job_id", "event_id", "type").agg(F.max("_us").alias("_us"))
    rows = closest.select(
        "job_id",
        "event_id",
        F.timestamp_micros("_us").cast(kind).alias("started_at"),
        F.col("ts").cast(kind).alias("finished_at"),
        F.col("type").alias("outcome"),
        F.round((F.unix_micros("ts") - F.col("_us")) / 1000.0, 3).alias("latency_ms"),
    )
    table = _table(rows, "latency", path)
    return start(rows, table.write, "append", **options), table
