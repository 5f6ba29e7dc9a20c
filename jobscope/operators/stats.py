"""Queue, system, worker and cron statistics.

Every operator is a partial aggregate followed by a merge of a few rows, so low-cardinality keys
(queue, type, state) never move the base rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.functions.timing import parse_duration
from jobscope.operators.shape import broadcast_if_small, measured
from jobscope.schemas import BOTTLENECK_LIMIT, STATES, WAITING_STATES
from jobscope.session import cut_lineage

STALE_AFTER = "5m"


def ntz(moment: dt.datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def queue_stats(jobs: DataFrame) -> DataFrame:
    """One row per queue with a count per state; discarded jobs are shown as dead."""
    names = {s: "dead" if s == "discarded" else s for s in STATES if s != "cancelled"}
    return jobs.groupBy("queue").agg(*[F.count_if(F.col("state") == s).alias(n) for s, n in names.items()])


def queue_view(jobs: DataFrame, paused: DataFrame | None = None) -> DataFrame:
    """Depth, running and paused per queue; ``paused`` has (queue, paused)."""
    view = jobs.groupBy("queue").agg(
        F.count_if(F.col("state").isin(WAITING_STATES)).alias("depth"), F.count_if(F.col("state") == "active").alias("running")
    )
    if paused is None:
        return view.withColumn("paused", F.lit(False))
    return view.join(paused, "queue", "left").withColumn("paused", F.coalesce("paused", F.lit(False)))


def dashboard(queues: DataFrame, jobs: DataFrame) -> DataFrame:
    """All queues with their job counts; a queue without jobs keeps its row with zeros."""
    counts = queue_stats(jobs)
    shown = ["available", "active", "scheduled", "retryable", "dead"]
    return queues.join(counts, "queue", "left").select(
        *queues.columns, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in shown]
    )


def count_groups(df: DataFrame, *groups: str) -> DataFrame:
    """Total and counts per value of each column, in long form (grouping, value, n), in one aggregate.

    Null values are shown as empty text, which is also how they are told apart from the total row.
    """
    sets = [[F.col(g)] for g in groups] + [[]]
    filled = df.select(*[F.coalesce(F.col(g), F.lit("")).alias(g) for g in groups])
    grouped = filled.groupingSets(sets, *[F.col(g) for g in groups]).agg(F.count("*").alias("n"))
    grouping, value = F.lit("total"), F.lit(None).cast("string")
    for g in groups:
        grouping = F.when(F.col(g).isNotNull(), F.lit(f"by_{g}")).otherwise(grouping)
        value = F.coalesce(F.col(g), value)
    return grouped.select(grouping.alias("grouping"), value.alias("value"), "n")


def export_stats(jobs: DataFrame) -> DataFrame:
    """Total, by state and by queue."""
    return count_groups(jobs, "state", "queue")


def dead_letter_stats(jobs: DataFrame) -> DataFrame:
    """Total, by queue and by type of the discarded jobs."""
    return count_groups(jobs.filter(F.col("state") == "discarded"), "queue", "type")


def _long(section: str, one_row: DataFrame) -> DataFrame:
    """A one-row aggregate as (section, metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns])
    return one_row.select(F.lit(section).alias("section"), F.inline(pairs))


def worker_state(as_of: dt.datetime, stale_after: str = STALE_AFTER) -> Column:
    """stale when the heartbeat is older than ``stale_after``, else quiet by directive, else running."""
    stale = F.col("last_heartbeat") < ntz(as_of - parse_duration(stale_after))
    return F.when(stale, "stale").when(F.col("directive") == "quiet", "quiet").otherwise("running")


def worker_list(workers: DataFrame, jobs_per_worker: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Workers with state and number of jobs worked on; ``jobs_per_worker`` has (id, active_jobs)."""
    return workers.join(jobs_per_worker, "id", "left").select(
        "id",
        worker_state(as_of).alias("state"),
        "directive",
        F.coalesce("active_jobs", F.lit(0).cast("bigint")).alias("active_jobs"),
        "last_heartbeat",
        "hostname",
        "pid",
    )


def worker_summary(workers: DataFrame, as_of: dt.datetime) -> DataFrame:
    state = worker_state(as_of)
    return workers.agg(
        F.count("*").alias("total"),
        F.count_if(state == "running").alias("running"),
        F.count_if(state == "quiet").alias("quiet"),
        F.count_if(state == "stale").alias("stale"),
    )


# Event types counted as enqueued, completed and failed.
ENQUEUED, COMPLETED, FAILED = "job.enqueued", "job.completed", "job.failed"


def _average(total: Column, number: Column, digits: int = 4) -> Column:
    average = total.cast("double") / F.nullif(number, F.lit(0))
    return F.round(average.cast("decimal(30,10)"), digits).cast("double")


def exact_avg(value: Column, digits: int = 4) -> Column:
    """Average over an exact decimal sum, rounded as a decimal: it does not depend on the order of the rows."""
    return _average(F.sum(value.cast("decimal(20,6)")), F.count(value), digits)


#: Counts and sums of a period, from which those of a longer one follow.
THROUGHPUT_PARTS = ("enqueued", "completed", "failed", "latency_sum", "latencies")


def throughput_parts() -> list[Column]:
    """Aggregates over events that give the parts of a period."""
    kind = F.col("type")
    latency = F.when(kind == COMPLETED, F.col("latency_ms"))
    counts = [F.count_if(kind == t) for t in (ENQUEUED, COMPLETED, FAILED)]
    found = [*counts, F.sum(latency.cast("decimal(20,6)")).cast("decimal(38,6)"), F.count(latency)]
    return [c.alias(n) for c, n in zip(found, THROUGHPUT_PARTS)]


def throughput_merged() -> list[Column]:
    """Aggregates over parts that give the parts of the whole."""
    return [F.sum(n).cast("decimal(38,6)" if n == "latency_sum" else "bigint").alias(n) for n in THROUGHPUT_PARTS]


def throughput_of_parts() -> list[Column]:
    """The statistics that the parts stand for."""
    return ["enqueued", "completed", "failed", _average(F.col("latency_sum"), F.col("latencies")).alias("avg_latency_ms")]


def _throughput() -> list[Column]:
    kind = F.col("type")
    return [
        F.count_if(kind == ENQUEUED).alias("enqueued"),
        F.count_if(kind == COMPLETED).alias("completed"),
        F.count_if(kind == FAILED).alias("failed"),
        exact_avg(F.when(kind == COMPLETED, F.col("latency_ms"))).alias("avg_latency_ms"),
    ]


def stats_overview(
    jobs: DataFrame, workers: DataFrame, events: DataFrame, queues: DataFrame, as_of: dt.datetime, queue: str | None = None
) -> DataFrame:
    """System statistics in long form (section, metric, value).

    ``queues`` has (queue, paused).  Throughput covers the minute that ends at ``as_of``.
    """
    if queue:
        jobs, events, queues = (df.filter(F.col("queue") == queue) for df in (jobs, events, queues))
    queue_row = queues.agg(F.count("*").alias("total"), F.count_if(~F.col("paused")).alias("active"), F.count_if("paused").alias("paused"))
    job_row = jobs.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    minute = events.filter((F.col("ts") > ntz(as_of - dt.timedelta(minutes=1))) & (F.col("ts") <= ntz(as_of)))
    flow = minute.agg(*_throughput()).select(
        F.col("enqueued").alias("enqueued_per_min"),
        F.col("completed").alias("completed_per_min"),
        F.col("failed").alias("failed_per_min"),
        F.coalesce("avg_latency_ms", F.lit(0.0)).alias("avg_latency_ms"),
    )
    parts = [_long("queues", queue_row), _long("workers", worker_summary(workers, as_of)), _long("jobs", job_row), _long("throughput", flow)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# History periods.
PERIODS = {"5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}


def stats_history(events: DataFrame, period: str = "1h", since=None, queue: str | None = None, as_of: dt.datetime | None = None) -> DataFrame:
    """Counts and average latency per tumbling period.

    ``since`` is a datetime, or a duration text counted back from ``as_of``.
    """
    if isinstance(since, str):
        if as_of is None:
            raise ValueError("a relative since needs as_of")
        since = as_of - parse_duration(since)
    if since is not None:
        events = events.filter(F.col("ts") >= ntz(since))
    if queue:
        events = events.filter(F.col("queue") == queue)
    return (
        events.groupBy(F.window("ts", PERIODS[period]).alias("w"))
        .agg(*_throughput())
        .select(F.col("w.start").cast("timestamp_ntz").alias("timestamp"), "enqueued", "completed", "failed", "avg_latency_ms")
    )


def stats_history_all(events: DataFrame) -> DataFrame:
    """All periods at once, (period, timestamp, ...): hours and days are merged from the five-minute parts, which alone
    are counted from the events; they are written out, as each of the three reads them."""
    start = F.col("w.start").cast("timestamp_ntz").alias("timestamp")
    fives = events.groupBy(F.window("ts", PERIODS["5m"]).alias("w")).agg(*throughput_parts()).select(start, *THROUGHPUT_PARTS)
    levels = {"5m": cut_lineage(fives, "history")}
    for finer, period in (("5m", "1h"), ("1h", "1d")):
        levels[period] = levels[finer].groupBy(F.window("timestamp", PERIODS[period]).alias("w")).agg(*throughput_merged()).select(start, *THROUGHPUT_PARTS)
    rows = [df.select(F.lit(p).alias("period"), "timestamp", *throughput_of_parts()) for p, df in levels.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def metrics(jobs: DataFrame, events: DataFrame, workers: DataFrame, queues: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Counters and gauges in long form (metric, value)."""
    span = F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))
    flow = events.agg(
        F.count_if(F.col("type") == ENQUEUED).alias("jobs_enqueued_total"),
        F.count_if(F.col("type") == COMPLETED).alias("jobs_completed_total"),
        F.count_if(F.col("type") == FAILED).alias("jobs_failed_total"),
        exact_avg(F.when(F.col("type") == COMPLETED, F.col("latency_ms"))).alias("avg_latency_ms"),
        span.alias("uptime_seconds"),
    ).withColumn("throughput_per_second", F.round(F.col("jobs_completed_total") / F.nullif(F.col("uptime_seconds"), F.lit(0)), 6))
    active = jobs.agg(F.count_if(F.col("state") == "active").alias("jobs_active"))
    queue_row = queues.agg(F.count_if(~F.col("paused")).alias("queues_active"))
    worker_row = workers.agg(F.count_if(worker_state(as_of) == "running").alias("workers_active"))
    result = _long("", flow)
    for part in (active, queue_row, worker_row):
        result = result.unionByName(_long("", part))
    return result.select("metric", "value")


def bottleneck(jobs: DataFrame, events: DataFrame, limit: int = BOTTLENECK_LIMIT) -> DataFrame:
    """Slowest queues first: depth, average duration and error rate."""
    micros = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    duration_ms = micros.cast("decimal(20,3)") / 1000
    per_queue = jobs.groupBy("queue").agg(
        F.count_if(F.col("state").isin(WAITING_STATES)).alias("depth"), exact_avg(duration_ms).alias("avg_duration_ms")
    )
    done = F.count_if(F.col("type").isin(COMPLETED, FAILED))
    errors = events.groupBy("queue").agg(F.round(F.count_if(F.col("type") == FAILED) / F.nullif(done, F.lit(0)), 6).alias("error_rate"))
    return (
        per_queue.join(errors, "queue", "left")
        .orderBy(F.desc_nulls_last("avg_duration_ms"), "queue")
        .limit(limit)
    )


def rate_limits(limits: DataFrame, jobs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Usage per limit key: active jobs of the queue, what is left, and an override that replaces the limit."""
    active = jobs.filter(F.col("state") == "active").groupBy(F.col("queue").alias("key")).agg(F.count("*").alias("active"))
    usage = limits.join(active, "key", "left").withColumn("active", F.coalesce("active", F.lit(0).cast("bigint")))
    if overrides is None:
        usage = usage.withColumn("override", F.lit(None).cast("int"))
    else:
        usage = usage.join(overrides, "key", "left")
    effective = F.coalesce("override", "concurrency")
    return usage.select(
        "key",
        effective.alias("concurrency"),
        "active",
        F.greatest(F.lit(0).cast("bigint"), effective - F.col("active")).alias("available"),
        "override",
    )


def exact_percentile(df: DataFrame, group: str, value: str, q: float, out: str) -> DataFrame:
    """Interpolated exact percentile per group, the null group included, without bringing a group together.

    Values are counted, ranked within logarithmic buckets and shifted by the counts of the buckets before;
    only the one or two values around the wanted position are left for the last step.  The buckets grow
    with the logarithm of the value range, so the running sum over them stays short.
    """
    bucket = F.floor(F.signum(value) * F.log1p(F.abs(value)) * 1000)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(group, bucket.alias("_bucket"), F.col(value).alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        counted.groupBy(group, "_bucket")
        .agg(F.sum("_n").alias("_in"))
        .withColumns({"_below": F.coalesce(F.sum("_in").over(before), F.lit(0)), "_all": F.sum("_in").over(Window.partitionBy(group))})
        .withColumnsRenamed({group: "_group", "_bucket": "_inside"})
    )
    inside = Window.partitionBy(group, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = (F.col("_all") - 1) * q
    upto = F.col("_below") + F.col("_run")
    start = upto - F.col("_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < upto), F.col("_v")))

    return (
        counted.withColumn("_run", F.sum("_n").over(inside))
        .join(buckets, (F.col(group).eqNullSafe(F.col("_group"))) & (F.col("_bucket") == F.col("_inside")))
        .groupBy(group)
        .agg(at(F.floor(position)).alias("_lo"), at(F.ceil(position)).alias("_hi"), F.max(position - F.floor(position)).alias("_part"))
        .select(group, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(out))
    )


def health(events: DataFrame, slo_ms: float = 100.0, error_budget: float = 0.05, sigmas: float = 3.0) -> DataFrame:
    """Score, status, and the number of objective violations and anomalies.

    A queue violates when its error rate exceeds the budget or its 95th latency percentile the objective;
    an hour is an anomaly when its failures exceed the queue's mean by ``sigmas`` deviations.
    """
    # One row per queue and hour, from one scan, says all but the percentile.
    hourly = events.groupBy("queue", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count_if(F.col("type") == FAILED).alias("failed"), F.count_if(F.col("type").isin(COMPLETED, FAILED)).alias("done")
    )
    hours = Window.partitionBy("queue")
    usual = F.avg("failed").over(hours) + sigmas * F.stddev_pop("failed").over(hours)
    queues = (
        hourly.withColumn("unusual", F.col("failed") > usual)
        .groupBy("queue")
        .agg(F.sum("failed").alias("failed"), F.sum("done").alias("done"), F.count_if("unusual").alias("anomalies"))
    )
    tail = exact_percentile(events, "queue", "latency_ms", 0.95, "p95").withColumnRenamed("queue", "_queue")
    violates = (F.col("failed") / F.nullif(F.col("done"), F.lit(0)) > error_budget) | (F.col("p95") > slo_ms)
    found = queues.join(tail, F.col("queue").eqNullSafe(F.col("_queue")), "left").agg(
        F.count_if(violates).alias("slo_violations"), F.coalesce(F.sum("anomalies"), F.lit(0).cast("bigint")).alias("anomaly_count")
    )
    scored = found.withColumn("score", F.greatest(F.lit(0).cast("bigint"), F.lit(100) - 10 * F.col("slo_violations") - 5 * F.col("anomaly_count")))
    status = F.when(F.col("score") >= 80, "healthy").when(F.col("score") >= 50, "degraded").otherwise("critical")
    return scored.select("score", status.alias("status"), "slo_violations", "anomaly_count")


#: Size of a latency sketch; ranks are off by at most RANK_ERROR with 99 % confidence.
SKETCH_SIZE, RANK_ERROR = 800, 0.01


def latency_sketches(events: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """(queue, hour, sketch): latencies of an hour as a quantile sketch of a few kilobytes, which can be kept and merged."""
    known = events.where(F.col("latency_ms").isNotNull())
    return known.groupBy("queue", F.date_trunc("hour", "ts").alias("hour")).agg(F.kll_sketch_agg_double("latency_ms", size).alias("sketch"))


def latency_quantiles(sketches: DataFrame, q: float = 0.95, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
    """(queue, latencies, estimate): the ``q`` quantile of each queue over the hours from ``since`` up to ``until``.

    Estimates come from the sketches alone, whatever the span; the share of latencies up to the estimate is within
    ``RANK_ERROR`` of ``q``.  :func:`exact_percentile` gives the exact value from the events.
    """
    if since is not None:
        sketches = sketches.where(F.col("hour") >= ntz(since))
    if until is not None:
        sketches = sketches.where(F.col("hour") < ntz(until))
    merged = sketches.groupBy("queue").agg(F.kll_merge_agg_double("sketch").alias("s"))
    return merged.select("queue", F.kll_sketch_get_n_double("s").alias("latencies"), F.kll_sketch_get_quantile_double("s", F.lit(q)).alias("estimate"))


def cron_detail(runs: DataFrame) -> DataFrame:
    """Number of runs and the latest run of each cron."""
    newest = F.struct("scheduled_at", "job_id")
    return runs.groupBy("name").agg(
        F.count("*").alias("run_count"),
        F.max("scheduled_at").alias("last_run_at"),
        F.max_by("job_id", newest).alias("last_job_id"),
        F.max_by("state", newest).alias("last_state"),
    )


def subscription_stats(subscriptions: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Success and failure counts and the last delivery of each subscription."""
    log = deliveries.groupBy(F.col("subscription_id").alias("id")).agg(
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
        F.max("delivered_at").alias("last_delivery_at"),
    )
    zero = F.lit(0).cast("bigint")
    return subscriptions.join(log, "id", "left").select(
        "id",
        "url",
        "active",
        F.coalesce("success_count", zero).alias("success_count"),
        F.coalesce("failure_count", zero).alias("failure_count"),
        "last_delivery_at",
    )


def match_subscriptions(subscriptions: DataFrame, events: DataFrame) -> DataFrame:
    """Active subscriptions with the events they listen to, as one row per subscription and event type.

    Events are counted per type first: the join then has as many rows as subscriptions have types, not
    one per subscription and event.
    """
    return match_type_counts(subscriptions, count_types(events))


def count_types(events: DataFrame) -> DataFrame:
    """Events per type with the first and the last time."""
    return events.groupBy("type").agg(F.count("*").alias("events"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def match_type_counts(subscriptions: DataFrame, counts: DataFrame) -> DataFrame:
    """Active subscriptions with the counts of the types they name, each type once."""
    wanted = subscriptions.filter("active").select("id", "url", F.explode(F.array_distinct("events")).alias("type"))
    return wanted.join(broadcast_if_small(measured(counts)), "type")


def metrics_exposition(metric_rows: DataFrame, prefix: str = "") -> DataFrame:
    """Metric rows (metric, value) as lines of the text exposition format, in one column ``value``."""
    name = F.concat(F.lit(prefix), F.col("metric"))
    whole = F.col("value") == F.floor("value")
    decimal = F.rtrim(F.col("value").cast("decimal(38,6)").cast("string"), F.lit("0"))
    number = F.when(whole, F.col("value").cast("bigint").cast("string")).otherwise(decimal)
    return metric_rows.filter(F.col("value").isNotNull()).select(F.concat_ws(" ", name, number).alias("value"))
