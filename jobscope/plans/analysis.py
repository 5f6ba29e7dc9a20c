"""What a legacy system holds: pending jobs and job types per queue, in long form.

Results are (level, queue, job_type, jobs): level ``type`` counts jobs per type, ``queue`` the pending
jobs of a queue, ``total`` all of them.  The three levels come from one grouping-sets aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions import json_kind
from jobscope.functions.jsons import text_member
from jobscope.operators.shape import once, spread
from jobscope.sources.keyspace import (
    bullmq_queues,
    bullmq_rows,
    celery_queues,
    celery_rows,
    river_rows,
    sidekiq_queues,
    sidekiq_rows,
)


def _levels(rows: DataFrame, typed: Column, queues: DataFrame | None = None) -> DataFrame:
    """Jobs per (queue, job_type), per queue and in total; ``typed`` marks rows whose type counts.

    ``queues`` are listed even without jobs: each adds a row that counts nothing.
    """
    rows = rows.select("queue", "job_type", F.coalesce(typed, F.lit(False)).alias("typed"), F.lit(1).cast("bigint").alias("n"))
    if queues is not None:
        nothing = [F.lit(None).cast("string").alias("job_type"), F.lit(False).alias("typed"), F.lit(0).cast("bigint").alias("n")]
        rows = rows.unionByName(queues.select("queue", *nothing))
    q, t, k = F.col("queue"), F.col("job_type"), F.col("typed")
    grouped = rows.groupingSets([[q, t, k], [q], []], q, t, k).agg(F.sum("n").alias("jobs"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "type").when(F.col("g") == 3, "queue").otherwise("total")
    return (
        grouped.withColumn("level", level)
        .filter((F.col("level") != "type") | F.col("typed"))
        .select("level", "queue", "job_type", "jobs")
    )


def analyze_sidekiq(keyspace: DataFrame) -> DataFrame:
    """Queue lists by class; scheduled and retrying jobs count in the total only."""
    rows = once(spread(sidekiq_rows(keyspace)), _v=F.try_parse_json("payload"))
    rows = rows.withColumn("job_type", F.coalesce(text_member("_v", "$.class"), F.lit("")))
    readable = (json_kind("_v") == "object") & (F.col("source_set") == "queue")
    counted = _levels(rows, readable, sidekiq_queues(keyspace))
    return counted.filter((F.col("level") == "total") | F.col("queue").isNotNull())


def analyze_bullmq(keyspace: DataFrame) -> DataFrame:
    """Wait lists by job name; only the names are read from the job hashes."""
    rows = bullmq_rows(keyspace, fields=("name",)).withColumn("job_type", F.col("name"))
    return _levels(rows, F.col("name").isNotNull(), bullmq_queues(keyspace))


def analyze_celery(keyspace: DataFrame) -> DataFrame:
    """Messages by task header; messages without one count as pending only."""
    rows = once(spread(celery_rows(keyspace)), _v=F.try_parse_json("payload"))
    rows = rows.withColumn("job_type", text_member("_v", "$.headers.task"))
    return _levels(rows, F.coalesce(F.col("job_type"), F.lit("")) != "", celery_queues(keyspace))


def analyze_faktory(sizes: DataFrame, raw_jobs: DataFrame | None = None) -> DataFrame:
    """Queue sizes as reported (queue, size); types too when the job rows are there."""
    q = F.col("queue")
    none = F.lit(None).cast("string").alias("job_type")
    counted = sizes.groupingSets([[q], []], q).agg(F.sum("size").alias("jobs"), F.grouping_id().alias("g"))
    result = counted.select(F.when(F.col("g") == 0, "queue").otherwise("total").alias("level"), "queue", none, "jobs")
    if raw_jobs is None:
        return result
    typed = (
        once(spread(raw_jobs), _v=F.try_parse_json("payload"))
        .filter(json_kind("_v") == "object")
        .groupBy(F.col("list_queue").alias("queue"), F.coalesce(text_member("_v", "$.jobtype"), F.lit("")).alias("job_type"))
        .agg(F.count("*").alias("jobs"))
    )
    return result.unionByName(typed.select(F.lit("type").alias("level"), "queue", "job_type", "jobs"))


def analyze_river(keyspace: DataFrame) -> DataFrame:
    """Full list lengths, and types from all entries of each queue."""
    rows = river_rows(keyspace)
    lengths = _levels(rows.withColumn("job_type", F.lit(None).cast("string")), F.lit(False))
    typed = (
        once(spread(rows), _v=F.try_parse_json("payload"))
        .filter(json_kind("_v") == "object")
        .groupBy("queue", F.coalesce(text_member("_v", "$.kind"), F.lit("")).alias("job_type"))
        .agg(F.count("*").alias("jobs"))
    )
    return lengths.unionByName(typed.select(F.lit("type").alias("level"), "queue", "job_type", "jobs"))


