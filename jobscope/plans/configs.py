"""Configuration files of three frameworks to job definitions and warnings.

Input rows are (path, content), one file per row.  Each converter returns (jobs, warnings): jobs have
path, type, queue, max_attempts, backoff, delay_ms, cron; warnings have path and message.  Files that cannot be
read give neither; :func:`config_rejects` lists them with the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions import class_to_type, json_kind, member
from jobscope.functions.jsons import kind_differs
from jobscope.operators.shape import once, spread
from jobscope.schemas import BULLMQ_CONFIG, CELERY_CONFIG, SIDEKIQ_WORKERS

# Attempts meant by "retry: true", queue of a task route without one.
DEFAULT_RETRIES = 25
CELERY_QUEUE = "celery"


class Converted(NamedTuple):
    jobs: DataFrame
    warnings: DataFrame


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _yaml_value(item: Column, key: str) -> tuple[Column, Column]:
    """(value, plain value) of a key of a block mapping: the text without quotes, and only if it has none."""
    pattern = rf"""(?m)^(?:[ \t]*-)?[ \t]+{key}:[ \t]*(?:"([^"\n]*)"|'([^'\n]*)'|([^#\n]*?))[ \t]*(?:#[^\n]*)?$"""
    quoted = F.concat(F.regexp_extract(item, pattern, 1), F.regexp_extract(item, pattern, 2))
    plain = F.regexp_extract(item, pattern, 3)
    return F.nullif(F.concat(quoted, plain), F.lit("")), F.lower(plain)


#: What brackets and commas mean nothing in: quoted text and comments.
_QUIET = r"""(?m)"(?:[^"\\\n]|\\.)*"|'[^'\n]*'|(?:^|[ \t])#[^\n]*"""
_MAPPING = r"""\{(?:[^{}"']++|"[^"\n]*"|'[^'\n]*')*\}"""
#: A list in brackets under ``workers``, up to the bracket that the next top-level key or the end follows.
_FLOW = r"""(?:\n[{ \t"']*:?|\n\{[^\n]*?,[ \t]*["'])workers["']?:[ \t\n]*\["""
_FLOW_LIST = rf"""(?s){_FLOW}(.*?)\][ \t]*(?:#[^\n]*)?(?=\n[^\s}}]|\s*\z|\s*\}}\s*\z|[ \t]*,\s*["']\w+["'][ \t]*:)"""


def _flow_to_block(item: Column) -> Column:
    """An item ``- {a: 1, "b": 2}`` as a block mapping, one key a line; others as they are."""
    inner = F.regexp_extract(item, r"^[ \t]*(?:-[ \t]+)?\{(?s:(.*))\}[ \t]*(?:#[^\n]*)?\s*$", 1)
    plain = F.regexp_replace(inner, r"""(^|[,\s])["'](\w+)["'][ \t]*:[ \t]*""", "$1$2: ")
    lines = F.regexp_replace(F.regexp_replace(plain, r"^\s+", ""), r"""[ \t\n]*,[ \t\n]*(?=\w+:[ \t])""", "\n  ")
    return F.when(inner != "", F.concat(F.lit("- "), F.regexp_replace(lines, r"[ \t\n,]*$", ""), F.lit("\n"))).otherwise(item)


def parse_worker_yaml(configs: DataFrame) -> DataFrame:
    """(path, workers, reason) from worker files; ``reason`` says why a file has no workers.

    Read are the list under ``workers``, in block or flow style, and the keys class, queue, retry and cron of its
    items, which may be flow mappings too, JSON included.  ``retry`` may be a whole number or a boolean; it becomes
    text, ``true``, ``false`` or digits.  Aliases of other values and several documents in a file are not followed.
    """
    files = spread(configs.select("path", "content"))
    text = F.concat(F.lit("\n"), F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n"), F.lit("\n"))
    doc = once(files.select("path", text.alias("text")), block=F.regexp_extract("text", r"(?s)\n:?workers:[ \t]*(?:#[^\n]*)?\n(.*?)(?=\n[^\s#-]|\z)", 1))
    # Items start at the dash column of the first one; deeper dashes belong to an item.
    dash = F.concat(F.lit("^"), F.regexp_extract("block", r"(?m)^([ \t]*)-[ \t]", 1), F.lit(r"-[ \t]+"))
    pattern = F.concat(F.lit("(?m)"), dash, F.lit(r"(?s:.*?)(?="), dash, F.lit(r"|\z)"))
    doc = once(doc, flow=F.when(F.col("text").rlike(_FLOW), F.regexp_extract("text", _FLOW_LIST, 1)))
    items = F.when(F.col("flow").isNotNull(), F.regexp_extract_all("flow", F.lit(_MAPPING), F.lit(0)))
    doc = once(doc, items=F.transform(F.coalesce(items, F.regexp_extract_all("block", pattern, F.lit(0))), _flow_to_block))

    def worker(item: Column) -> Column:
        plain = _yaml_value(item, "retry")[1]
        retry = F.when(plain.isin("true", "yes", "on"), "true").when(plain.isin("false", "no", "off"), "false")
        retry = F.coalesce(retry, F.when(plain.rlike(r"^[-+]?[0-9]+$"), F.ltrim(plain, F.lit("+"))))
        values = {key: _yaml_value(item, key)[0] for key in ("class", "queue", "cron")}
        return F.struct(values["class"].alias("class"), values["queue"].alias("queue"), retry.alias("retry"), values["cron"].alias("cron"))

    doc = once(doc, bare=F.regexp_replace("text", _QUIET, ""))

    def count(sign: str) -> Column:
        return F.length("bare") - F.length(F.replace("bare", F.lit(sign)))

    others = F.regexp_replace("flow", rf"""{_MAPPING}|[\s,]|#[^\n]*""", "")
    mapping = F.forall("items", lambda i: i.rlike(r"^[ \t]*-[ \t]+\w+:(?:\s|$)"))
    reason = (
        F.when(F.col("text").rlike(r"^(?:\s|---|#[^\n]*\n)*-[ \t]"), "top level is not a mapping")
        .when((count("[") != count("]")) | (count("{") != count("}")), "invalid YAML")
        .when(F.col("text").rlike(r"\n:?workers:[ \t]*[^\s#\[~]"), "workers are not a list")
        .when(others != "", "a worker is not a mapping")
        .when(~mapping, "a worker is not a mapping")
    )
    workers = F.transform("items", worker).cast(SIDEKIQ_WORKERS)
    return once(doc, reason=reason).select("path", F.when(F.col("reason").isNull(), workers).alias("workers"), "reason")


def _json_document(configs: DataFrame, schema: str, top: dict[str, str], numbers: Callable[[], Column]) -> DataFrame:
    """(path, c, reason): the document, null where ``reason`` says why it cannot be used.

    ``top`` names the kind of each top member; ``numbers`` tells whether a member that must be a whole number is not.
    """
    doc = once(spread(configs.select("path", "content")), v=F.try_parse_json("content"))
    reason = F.when(F.col("v").isNull(), "invalid JSON").when(json_kind("v") != "object", "not an object")
    for name, kind in top.items():
        reason = F.coalesce(reason, F.when(kind_differs(member("v", f"$.{name}"), (kind, "null")), f"bad type: {name}"))
    reason = F.coalesce(reason, numbers())
    doc = once(doc, reason=reason)
    return once(doc, c=F.when(F.col("reason").isNull(), F.from_json("content", schema))).select("path", "c", "reason")


def _not_whole(value: Column, path: str) -> Column:
    return F.coalesce(kind_differs(F.variant_get(value, path, "variant"), ("int", "null")), F.lit(False))


def _option_not_whole(name: str) -> Callable[[Column], Column]:
    return lambda job: _not_whole(job, f"$.opts.{name}")


def _bullmq_document(configs: DataFrame) -> DataFrame:
    def numbers() -> Column:
        queues = F.coalesce(F.try_variant_get("v", "$.queues", "array<variant>"), F.array().cast("array<variant>"))
        jobs = F.flatten(F.array_compact(F.transform(queues, lambda q: F.try_variant_get(q, "$.jobs", "array<variant>"))))
        found = F.lit(None).cast("string")
        for name in ("attempts", "delay"):
            found = F.coalesce(found, F.when(F.exists(jobs, _option_not_whole(name)), f"bad type: {name}"))
        return found

    return _json_document(configs, BULLMQ_CONFIG, {"queues": "array"}, numbers)


def _celery_document(configs: DataFrame) -> DataFrame:
    def numbers() -> Column:
        notes = F.map_values(F.try_variant_get("v", "$.task_annotations", "map<string,variant>"))
        return F.when(F.exists(notes, lambda n: _not_whole(n, "$.max_retries")), "bad type: max_retries")

    return _json_document(configs, CELERY_CONFIG, {"task_routes": "object", "task_annotations": "object", "beat_schedule": "object"}, numbers)


def config_rejects(configs: DataFrame, framework: str) -> DataFrame:
    """(path, reason) of configuration files that cannot be read."""
    readers = {"sidekiq": parse_worker_yaml, "bullmq": _bullmq_document, "celery": _celery_document}
    if framework not in readers:
        raise ValueError(f"unsupported framework: {framework}")
    return readers[framework](configs).where("reason is not null").select("path", "reason")


def convert_sidekiq_configs(configs: DataFrame) -> Converted:
    """Workers to job definitions; a number of retries is kept, true means the default, with a warning."""
    rows = parse_worker_yaml(configs).select("path", F.posexplode("workers").alias("pos", "w"))
    retry = F.col("w.retry")
    attempts = F.when(retry == "true", DEFAULT_RETRIES).when(retry != "false", retry.cast("int"))
    jobs = rows.select(
        "path",
        class_to_type(F.coalesce("w.class", F.lit(""))).alias("type"),
        F.when(_blank(F.col("w.queue")), "default").otherwise(F.col("w.queue")).alias("queue"),
        attempts.alias("max_attempts"),
        F.when(attempts.isNotNull(), "exponential").alias("backoff"),
        F.lit(None).cast("bigint").alias("delay_ms"),
        F.when(~_blank(F.col("w.cron")), F.col("w.cron")).alias("cron"),
    )
    message = F.concat(F.col("w.class"), F.lit(f": using Sidekiq default {DEFAULT_RETRIES} retries; consider reducing"))
    return Converted(jobs, rows.filter(retry == "true").select("path", message.alias("message")))


def convert_bullmq_configs(configs: DataFrame) -> Converted:
    """Queues and their jobs; positive attempts give a retry policy, unknown backoff names a warning."""
    doc = _bullmq_document(configs)
    rows = doc.select("path", F.explode("c.queues").alias("q")).select("path", F.col("q.name").alias("queue"), F.explode("q.jobs").alias("j"))
    attempts = F.when(F.col("j.opts.attempts") > 0, F.col("j.opts.attempts"))
    kind = F.col("j.opts.backoff.type")
    has_backoff = F.col("j.opts.backoff").isNotNull()
    jobs = rows.select(
        "path",
        F.coalesce("j.name", F.lit("")).alias("type"),
        F.coalesce("queue", F.lit("")).alias("queue"),
        attempts.alias("max_attempts"),
        F.when(attempts.isNotNull(), F.when(kind == "fixed", "fixed").otherwise("exponential")).alias("backoff"),
        F.when(attempts.isNotNull() & has_backoff, F.coalesce("j.opts.backoff.delay", F.lit(0).cast("bigint"))).alias("delay_ms"),
        F.lit(None).cast("string").alias("cron"),
    )
    unknown = attempts.isNotNull() & has_backoff & ~F.coalesce(kind, F.lit("")).isin("fixed", "exponential")
    found = F.array_compact(
        F.array(
            F.when(
                unknown,
                F.concat(F.col("j.name"), F.lit(': unsupported backoff type "'), F.coalesce(kind, F.lit("")), F.lit('", defaulting to exponential')),
            ),
            F.when(
                F.col("j.opts.delay") > 0,
                F.concat(F.col("j.name"), F.lit(": static delay ("), F.col("j.opts.delay").cast("string"), F.lit("ms) converted to scheduled_at at enqueue time")),
            ),
        )
    )
    return Converted(jobs, rows.select("path", F.explode(found).alias("message")))


def convert_celery_configs(configs: DataFrame) -> Converted:
    """Task routes with their annotations and beat schedules.

    The three maps of a file sit in one row, so they are matched by map lookups without any shuffle.
    """
    doc = _celery_document(configs)
    routes = doc.select(
        "path",
        F.col("c.task_annotations").alias("annotations"),
        F.map_entries(F.coalesce("c.beat_schedule", F.from_json(F.lit("{}"), "map<string,struct<task:string,schedule:struct<crontab:string>>>"))).alias("beats"),
        F.explode("c.task_routes").alias("task", "route"),
    ).withColumn("note", F.col("annotations")[F.col("task")])
    crons = F.filter(
        "beats", lambda b: (b["value"]["task"] == F.col("task")) & (F.coalesce(b["value"]["schedule"]["crontab"], F.lit("")) != "")
    )
    attempts = F.when(F.col("note.max_retries") > 0, F.col("note.max_retries"))
    jobs = routes.select(
        "path",
        F.col("task").alias("type"),
        F.when(_blank(F.col("route.queue")), CELERY_QUEUE).otherwise(F.col("route.queue")).alias("queue"),
        attempts.alias("max_attempts"),
        F.when(attempts.isNotNull(), "exponential").alias("backoff"),
        F.lit(None).cast("bigint").alias("delay_ms"),
        F.try_element_at(crons, F.lit(-1))["value"]["schedule"]["crontab"].alias("cron"),
    )
    limited = routes.filter(~_blank(F.col("note.rate_limit"))).select(
        "path",
        F.concat(F.col("task"), F.lit(': rate_limit "'), F.col("note.rate_limit"), F.lit('" requires rate limiting extension configuration')).alias("message"),
    )
    unrouted = (
        doc.select("path", F.col("c.task_routes").alias("routes"), F.explode("c.beat_schedule").alias("beat", "b"))
        .filter(~F.coalesce(F.map_contains_key("routes", F.coalesce("b.task", F.lit(""))), F.lit(False)))
        .select(
            "path",
            F.concat(F.lit('beat schedule "'), F.col("beat"), F.lit('" references task "'), F.coalesce("b.task", F.lit("")), F.lit('" not in task_routes')).alias("message"),
        )
    )
    return Converted(jobs, limited.unionByName(unrouted))
