"""Store dumps: key, kind, idx, field, value, score rows as the raw rows of each queue system.

kinds are ``list``, ``zset``, ``set`` and ``hash``; a list or set entry is in ``value``, a hash entry in
``field`` and ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions import key_suffix
from jobscope.operators.shape import broadcast_if_small, measured
from jobscope.schemas import KEYSPACE

# Key names of the supported stores.
SIDEKIQ_QUEUES, SIDEKIQ_QUEUE, SIDEKIQ_SETS = "queues", "queue:", ["schedule", "retry"]
BULL = "bull:"
KOMBU_BINDING, CELERY_DEFAULT = "_kombu.binding.", "celery"
RIVER_QUEUE = "river:queue:"


def read_keyspace(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(KEYSPACE).format(fmt).load(path)


def read_api_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Dumped HTTP replies, one JSON line per queue: {queue, size, jobs[]}.  Returns (sizes, raw jobs)."""
    pages = spark.read.schema("queue string, size bigint, jobs array<variant>").json(path)
    jobs = pages.select(F.col("queue").alias("list_queue"), F.explode("jobs").alias("job"))
    return pages.select("queue", "size"), jobs.select("list_queue", F.to_json("job").alias("payload"))


def sidekiq_queues(keyspace: DataFrame) -> DataFrame:
    """Names of the registered queues."""
    registered = keyspace.filter((F.col("kind") == "set") & (F.col("key") == SIDEKIQ_QUEUES))
    return registered.select(F.col("value").alias("queue")).distinct()


def sidekiq_rows(keyspace: DataFrame) -> DataFrame:
    """Entries of the registered queue lists, then of the schedule and retry sets; duplicates are kept."""
    queues = sidekiq_queues(keyspace)
    lists = keyspace.filter((F.col("kind") == "list") & F.col("key").startswith(SIDEKIQ_QUEUE)).select(
        F.lit("queue").alias("source_set"), key_suffix("key", SIDEKIQ_QUEUE).alias("queue"), "idx", F.col("value").alias("payload")
    )
    sets = keyspace.filter((F.col("kind") == "zset") & F.col("key").isin(SIDEKIQ_SETS)).select(
        F.col("key").alias("source_set"), F.lit(None).cast("string").alias("queue"), "idx", F.col("value").alias("payload")
    )
    return lists.join(broadcast_if_small(measured(queues)), "queue", "left_semi").select(sets.columns).unionByName(sets)


def bull_part(key: Column | str, part: int) -> Column:
    """``bull:<queue>:<rest>``: part 2 is the queue; the rest may contain more colons."""
    return F.get(F.split(key, ":", 3), F.lit(part - 1))


def bullmq_queues(keyspace: DataFrame) -> DataFrame:
    """Distinct queues that have an id counter or a wait list."""
    rest = bull_part("key", 3)
    named = keyspace.filter(F.col("key").startswith(BULL) & rest.isin("id", "wait"))
    return named.select(bull_part("key", 2).alias("queue")).distinct()


def bullmq_rows(keyspace: DataFrame, sets: tuple[str, ...] = ("wait",), fields: tuple[str, ...] = ("name", "data", "opts")) -> DataFrame:
    """Waiting job ids with the fields of their hash; ids without a hash keep null fields.

    ``sets`` may name further lists (delayed, prioritized, active).  Hash fields are folded per job before
    the join, with a map-side partial aggregate; only ``fields`` are read.
    """
    rest = bull_part("key", 3)
    ids = keyspace.filter(F.col("kind").isin("list", "zset") & F.col("key").startswith(BULL) & rest.isin(list(sets))).select(
        bull_part("key", 2).alias("queue"), F.col("value").alias("id")
    )

    def field(name: str) -> Column:
        return F.max(F.when(F.col("field") == name, F.col("value"))).alias(name)

    hashes = (
        keyspace.filter((F.col("kind") == "hash") & F.col("key").startswith(BULL) & F.col("field").isin(list(fields)))
        .groupBy(bull_part("key", 2).alias("queue"), rest.alias("id"))
        .agg(*[field(name) for name in fields])
    )
    return ids.join(hashes, ["queue", "id"], "left")


def celery_queues(keyspace: DataFrame, default: str = CELERY_DEFAULT) -> DataFrame:
    """The default queue and every queue with a binding key, once each."""
    bound = keyspace.filter(F.col("key").startswith(KOMBU_BINDING)).select(key_suffix("key", KOMBU_BINDING).alias("queue"))
    first = keyspace.sparkSession.range(1).select(F.lit(default).alias("queue"))
    return bound.filter(F.col("queue") != "").unionByName(first).distinct()


def celery_rows(keyspace: DataFrame) -> DataFrame:
    lists = keyspace.filter(F.col("kind") == "list").select(F.col("key").alias("queue"), "idx", F.col("value").alias("payload"))
    return lists.join(broadcast_if_small(measured(celery_queues(keyspace))), "queue", "left_semi")


def river_rows(keyspace: DataFrame) -> DataFrame:
    return keyspace.filter((F.col("kind") == "list") & F.col("key").startswith(RIVER_QUEUE)).select(
        key_suffix("key", RIVER_QUEUE).alias("queue"), "idx", F.col("value").alias("payload")
    )


def discover_queues(keyspace: DataFrame) -> DataFrame:
    """All queues of a mixed dump as (system, queue); every row of the dump is looked at once."""
    key = F.col("key")
    named = {
        "sidekiq": ((F.col("kind") == "set") & (key == SIDEKIQ_QUEUES), F.col("value")),
        "bullmq": (key.startswith(BULL) & bull_part("key", 3).isin("id", "wait"), bull_part("key", 2)),
        "celery": (key.startswith(KOMBU_BINDING) & (key_suffix("key", KOMBU_BINDING) != ""), key_suffix("key", KOMBU_BINDING)),
        "river": (key.startswith(RIVER_QUEUE), key_suffix("key", RIVER_QUEUE)),
    }
    system = queue = F.lit(None).cast("string")
    for name, (condition, value) in named.items():
        system = F.when(condition, name).otherwise(system)
        queue = F.when(condition, value).otherwise(queue)
    found = keyspace.select(system.alias("system"), queue.alias("queue")).where("system is not null")
    first = keyspace.sparkSession.range(1).select(F.lit("celery").alias("system"), F.lit(CELERY_DEFAULT).alias("queue"))
    return found.unionByName(first).distinct()
