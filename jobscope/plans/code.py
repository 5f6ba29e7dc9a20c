"""Job definitions from a code corpus, migration plan rows, framework detection.

Input rows are (path, content) with the whole file in ``content``; everything is JVM regular expressions
on one row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions import name_to_type
from jobscope.operators.shape import spread

# Patterns that find job definitions.
SIDEKIQ_WORKER = r"class\s+(\w+)\s*\n(?:[^}]*?)include\s+Sidekiq::Worker"
ACTIVE_JOB = r"class\s+(\w+)\s*<\s*(?:ApplicationJob|ActiveJob::Base)"
SIDEKIQ_QUEUE = r"""sidekiq_options\s+queue:\s*['":](\w+)"""
SIDEKIQ_RETRY = r"sidekiq_options\s+.*retry:\s*(\w+)"
BULLMQ_QUEUE = r"""new\s+Queue\s*\(\s*['"]([^'"]+)['"]"""
BULLMQ_WORKER = r"""new\s+Worker\s*\(\s*['"]([^'"]+)['"]"""
BULLMQ_ADD = r"""\.add\s*\(\s*['"]([^'"]+)['"]"""
CELERY_TASK = r"@(?:app\.task|shared_task|celery\.task)\s*(?:\([^)]*\))?\s*\ndef\s+(\w+)"
CELERY_QUEUE = r"""queue\s*=\s*['"]([^'"]+)['"]"""
CELERY_RETRY = r"max_retries\s*=\s*(\d+)"
# The default queues.
RUBY_QUEUE, PYTHON_QUEUE = "default", "celery"

# Text without which a file holds no definition of a framework.
HINTS = {
    "sidekiq": r"Sidekiq::Worker|ApplicationJob|ActiveJob::Base",
    "bullmq": r"new\s+Worker|\.add\s*\(",
    "celery": r"@(?:app\.task|shared_task|celery\.task)",
}


# A worker's options stand between its class line and the next one.
SIDEKIQ_SCOPE = r"(?m)" + SIDEKIQ_WORKER + r"[\s\S]*?(?=^\s*class\s|\z)"


def _find(pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all("content", F.lit(pattern), F.lit(group))


def _option(block: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(block, pattern, 1), F.lit(""))


def _definition(framework: str, name: Column, queue: Column, retry: Column | None = None) -> Column:
    count = F.lit(None).cast("bigint") if retry is None else retry.try_cast("bigint")
    return F.struct(F.lit(framework).alias("framework"), name.alias("name"), queue.alias("queue"), count.alias("retry_count"))


def _sidekiq(strict: bool) -> list[Column]:
    def worker(block: Column) -> Column:
        name = F.regexp_extract(block, r"class\s+(\w+)", 1)
        return _definition("sidekiq", name, F.coalesce(_option(block, SIDEKIQ_QUEUE), F.lit(RUBY_QUEUE)), _option(block, SIDEKIQ_RETRY))

    active = F.transform(_find(ACTIVE_JOB, 1), lambda n: _definition("sidekiq", n, F.lit(RUBY_QUEUE)))
    return [F.transform(_find(SIDEKIQ_SCOPE), worker), active]


def _celery(strict: bool) -> list[Column]:
    def task(block: Column) -> Column:
        # The block is the decorator with the def line; its options are the task's own.
        name = F.regexp_extract(block, r"def\s+(\w+)\z", 1)
        return _definition("celery", name, F.coalesce(_option(block, CELERY_QUEUE), F.lit(PYTHON_QUEUE)), _option(block, CELERY_RETRY))

    return [F.transform(_find(CELERY_TASK), task)]


def _bullmq(strict: bool) -> list[Column]:
    """Workers and added job names, each name once per file.

    With ``strict`` a worker is left out when the file also creates a queue of its name.
    """
    workers, added = F.array_distinct(_find(BULLMQ_WORKER, 1)), F.array_distinct(_find(BULLMQ_ADD, 1))
    if strict:
        queues = _find(BULLMQ_QUEUE, 1)
        workers = F.array_except(workers, queues)
        added = F.array_except(added, queues)
    added = F.array_except(added, workers)
    return [
        F.transform(workers, lambda n: _definition("bullmq", n, n)),
        F.transform(added, lambda n: _definition("bullmq", n, F.lit(""))),
    ]


EXTRACTORS = {"sidekiq": _sidekiq, "bullmq": _bullmq, "celery": _celery}


def _extract(files: DataFrame, frameworks: list[str], strict: bool = False) -> DataFrame:
    hint = "|".join(HINTS[f] for f in frameworks)
    # A cheap test skips files that cannot match; only the others are dealt out for the patterns.
    files = spread(files.filter(F.col("content").rlike(hint)).select("path", "content"))
    found = []
    for framework in frameworks:
        possible = F.col("content").rlike(HINTS[framework])
        found += [F.when(possible, c) for c in EXTRACTORS[framework](strict)]
    return files.select("path", F.inline(F.flatten(F.array_compact(F.array(*found)))))


def extract_jobs(files: DataFrame, framework: str, strict: bool = False) -> DataFrame:
    """Job definitions of one framework: path, framework, name, queue, retry_count."""
    if framework not in EXTRACTORS:
        raise ValueError(f"unsupported framework: {framework}")
    return _extract(files, [framework], strict)


def extract_all(files: DataFrame) -> DataFrame:
    """Job definitions of all frameworks, from one scan."""
    return _extract(files, list(EXTRACTORS))


def code_queues(definitions: DataFrame) -> DataFrame:
    """Distinct non-empty queue names per framework, sorted."""
    return definitions.filter(F.col("queue") != "").select("framework", "queue").distinct().orderBy("framework", "queue")


def plan_migration(definitions: DataFrame) -> DataFrame:
    """Target type of every definition."""
    return definitions.select("path", "framework", "name", name_to_type("name").alias("target_type"), "queue")


def plan_summary(definitions: DataFrame) -> DataFrame:
    """Jobs and distinct queues per framework."""
    return definitions.groupBy("framework").agg(
        F.count("*").alias("jobs"), F.countDistinct(F.when(F.col("queue") != "", F.col("queue"))).alias("queues")
    )


# Files that name a framework, in order of preference, and files that may mention it.
CONFIG_FILES = {
    "sidekiq": ["sidekiq.yml", "config/sidekiq.yml"],
    "celery": ["celeryconfig.py", "celery.json", "celeryconfig.json"],
}
MENTIONS = {"sidekiq": "Gemfile", "bullmq": "package.json", "celery": "requirements.txt"}


def detect_frameworks(files: DataFrame) -> DataFrame:
    """Frameworks per repository root: (root, framework, confidence, config_file).

    ``files`` has (root, path, content), the path relative to the root.  A configuration file gives high
    confidence, a mention in a dependency list medium; a mention of bullmq counts as high.
    """
    flags = []
    for framework, mentioned_in in MENTIONS.items():
        configs = CONFIG_FILES.get(framework, [])
        rank = F.lit(None).cast("int")
        for position, name in reversed(list(enumerate(configs))):
            rank = F.when(F.col("path") == name, position).otherwise(rank)
        flags.append(F.min(rank).alias(f"{framework}_config"))
        flags.append(F.max((F.col("path") == mentioned_in) & F.contains("content", F.lit(framework))).alias(f"{framework}_named"))
    roots = files.groupBy("root").agg(*flags)
    options = []
    for framework in MENTIONS:
        names = F.array(*[F.lit(n) for n in CONFIG_FILES.get(framework, [""])])
        config = F.get(names, F.col(f"{framework}_config"))
        sure = F.lit("high") if framework == "bullmq" else F.lit("medium")
        confidence = F.when(config.isNotNull(), "high").when(F.col(f"{framework}_named"), sure)
        options.append(F.struct(F.lit(framework).alias("framework"), confidence.alias("confidence"), F.coalesce(config, F.lit("")).alias("config_file")))
    return roots.select("root", F.inline(F.array(*options))).filter(F.col("confidence").isNotNull())
