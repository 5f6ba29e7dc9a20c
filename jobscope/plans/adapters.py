"""Legacy payloads to canonical jobs: one adapter per queue system.

Each adapter takes raw rows and returns (jobs, rejects).  A payload is parsed once into a variant; a
row that cannot become a job goes to the rejects with a reason.  Canonical jobs have type, queue,
args and meta (JSON text), priority and scheduled_at; all other input columns are passed through.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions import class_to_type, delay_to_timestamp, epoch_text, json_kind, member, wrap_in_array
from jobscope.functions.jsons import kind_differs, text_member
from jobscope.operators.shape import once, spread

_LARGEST = 2**31 - 1
CANONICAL = ["type", "queue", "args", "priority", "scheduled_at", "meta"]


class Conversion(NamedTuple):
    jobs: DataFrame
    rejects: DataFrame


# The members each payload format types, with the JSON kinds they may have.
_TEXT = ("string", "null")
_INT = ("int", "null")
_NUMBER = ("int", "number", "null")
PAYLOAD_TYPES = {
    "sidekiq": {"class": _TEXT, "queue": _TEXT, "jid": _TEXT, "enqueued_at": _NUMBER, "at": _NUMBER},
    "celery": {"body": _TEXT, "headers": ("object", "null"), "headers.task": _TEXT, "headers.id": _TEXT},
    "faktory": {
        "jid": _TEXT,
        "jobtype": _TEXT,
        "queue": _TEXT,
        "priority": _INT,
        "at": _TEXT,
        "reserve_for": _INT,
        "retry": _INT,
        "custom": ("object", "null"),
    },
    "river": {"id": _INT, "kind": _TEXT, "queue": _TEXT, "state": _TEXT, "priority": _INT, "scheduled_at": _TEXT},
    "bullmq": {"name": _TEXT, "opts": ("object", "null"), "opts.delay": _INT, "opts.priority": _INT},
}


def _starts_object(text: str) -> Column:
    """Whether valid JSON text is an object; a lone null counts as an empty one."""
    start = F.ltrim(text)
    return start.startswith("{") | start.startswith("n")


def _parsed(raw: DataFrame, payload: str, fmt: str, required: tuple[str, str] | None = None) -> DataFrame:
    """Add the parsed document ``_v`` and the reason why it cannot become a job, if any.

    ``required`` names a text member that must not be empty and the reason given when it is.
    """
    doc = once(spread(raw), _v=F.try_parse_json(payload))
    reason = F.when(F.col("_v").isNull(), "invalid JSON").when(~_starts_object(payload), "not an object")
    for name, allowed in PAYLOAD_TYPES[fmt].items():
        reason = F.coalesce(reason, F.when(kind_differs(member("_v", f"$.{name}"), allowed), f"bad type: {name}"))
        if name.endswith("priority"):
            reason = F.coalesce(reason, _too_large(F.try_variant_get("_v", f"$.{name}", "decimal(38,0)")))
    if required:
        path, message = required
        reason = F.coalesce(reason, F.when(_text(path) == "", message))
    return once(doc, _reason=reason)


def _split(df: DataFrame, raw: DataFrame, drop: list[str]) -> Conversion:
    kept = [c for c in raw.columns if c not in drop and c not in CANONICAL]
    jobs = df.filter(F.col("_reason").isNull()).select(*kept, *CANONICAL)
    rejects = df.filter(F.col("_reason").isNotNull()).select(*[F.col(f"_raw.{c}") for c in raw.columns], F.col("_reason").alias("reason"))
    return Conversion(jobs, rejects)


def _keep_raw(raw: DataFrame) -> DataFrame:
    return raw.withColumn("_raw", F.struct(*raw.columns))


def _text(path: str) -> Column:
    return F.coalesce(text_member("_v", path), F.lit(""))


def _or(value: Column, default: str | Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def _too_large(value: Column) -> Column:
    """The reason for a priority that 32 bits cannot hold."""
    return F.when((value > _LARGEST) | (value < -_LARGEST), "priority out of range")


def _positive(path: str) -> Column:
    value = F.try_variant_get("_v", path, "int")
    return F.when(value > 0, value)


def from_sidekiq(raw: DataFrame, payload: str = "payload") -> Conversion:
    """Class name to type, queue ``default`` when empty, epoch text when scheduled."""
    df = _parsed(_keep_raw(raw), payload, "sidekiq")
    out = df.withColumns(
        {
            "type": class_to_type(_text("$.class")),
            "queue": _or(_text("$.queue"), "default"),
            "args": F.coalesce(F.to_json(member("_v", "$.args")), F.lit("null")),
            "priority": F.lit(None).cast("int"),
            "scheduled_at": epoch_text(F.try_variant_get("_v", "$.at", "double")),
            "meta": F.to_json(F.struct(_text("$.class").alias("sidekiq_class"), _text("$.jid").alias("sidekiq_jid"))),
        }
    )
    return _split(out, raw, [payload])


def from_bullmq(raw: DataFrame, as_of: dt.datetime, name: str = "name", data: str = "data", opts: str = "opts") -> Conversion:
    """Job hashes, one row per job with the fields as columns; unreadable options are ignored."""
    df = once(spread(_keep_raw(raw)), _o=F.try_parse_json(opts))
    usable = json_kind("_o") == "object"
    for field in ("delay", "priority"):
        usable &= F.coalesce(~kind_differs(member("_o", f"$.{field}"), _INT), F.lit(True))
    df = df.withColumn("_o", F.when(usable, F.col("_o")))
    priority = F.try_variant_get("_o", "$.priority", "int")
    out = df.withColumns(
        {
            "_reason": F.coalesce(
                F.when(F.coalesce(F.col(name), F.lit("")) == "", "missing job name"),
                _too_large(F.try_variant_get("_o", "$.priority", "decimal(38,0)")),
            ),
            "type": F.col(name),
            "args": F.when(F.col(data).isNull(), "[]").otherwise(wrap_in_array(data)),
            "priority": F.when(priority > 0, priority),
            "scheduled_at": delay_to_timestamp(F.try_variant_get("_o", "$.delay", "bigint"), F.lit(as_of).cast("timestamp_ntz")),
            "meta": F.lit('{"bullmq_source":true}'),
        }
    )
    return _split(out, raw, [name, data, opts])


def from_bullmq_envelope(raw: DataFrame, as_of: dt.datetime, payload: str = "payload") -> Conversion:
    """The same job as one JSON document ``{name, data, opts}``; a missing name is allowed here."""
    df = _parsed(_keep_raw(raw), payload, "bullmq")
    out = df.withColumns(
        {
            "type": _text("$.name"),
            "args": F.coalesce(wrap_in_array(F.to_json(member("_v", "$.data"))), F.lit("[null]")),
            "priority": _positive("$.opts.priority"),
            "scheduled_at": delay_to_timestamp(F.try_variant_get("_v", "$.opts.delay", "bigint"), F.lit(as_of).cast("timestamp_ntz")),
            "meta": F.lit('{"bullmq_source":true}'),
        }
    )
    return _split(out, raw, [payload])


def from_celery(raw: DataFrame, payload: str = "payload") -> Conversion:
    """Task name from the headers; the body is base64 or plain JSON ``[args, kwargs, embed]``."""
    df = _parsed(_keep_raw(raw), payload, "celery", required=("$.headers.task", "missing task header"))
    body = _text("$.body")
    decoded = F.coalesce(F.try_to_binary(body, F.lit("base64")).cast("string"), body)
    df = once(df, _b=F.try_parse_json(decoded))
    kwargs = F.when(json_kind(member("_b", "$[1]")) == "object", member("_b", "$[1]"))
    out = df.withColumns(
        {
            "type": _text("$.headers.task"),
            "args": F.when(json_kind("_b") == "array", F.coalesce(F.to_json(member("_b", "$[0]")), F.lit("[]"))).otherwise("[]"),
            "priority": F.lit(None).cast("int"),
            "scheduled_at": F.lit(None).cast("string"),
            "meta": F.to_json(F.struct(kwargs.alias("celery_kwargs"), _text("$.headers.id").alias("celery_task_id"))),
        }
    )
    return _split(out, raw, [payload])


def from_faktory(raw: DataFrame, payload: str = "payload") -> Conversion:
    df = _parsed(_keep_raw(raw), payload, "faktory")
    custom = F.when(json_kind(member("_v", "$.custom")) == "object", member("_v", "$.custom"))
    out = df.withColumns(
        {
            "type": _text("$.jobtype"),
            "queue": _or(_text("$.queue"), "default"),
            "args": F.coalesce(F.to_json(member("_v", "$.args")), F.lit("null")),
            "priority": _positive("$.priority"),
            "scheduled_at": F.nullif(_text("$.at"), F.lit("")),
            "meta": F.to_json(F.struct(custom.alias("faktory_custom"), _text("$.jid").alias("faktory_jid"))),
        }
    )
    return _split(out, raw, [payload])


def from_river(raw: DataFrame, payload: str = "payload") -> Conversion:
    """``queue`` holds the name of the list; the job's own queue wins."""
    df = _parsed(_keep_raw(raw), payload, "river", required=("$.kind", "missing kind"))
    job_id = F.coalesce(F.try_variant_get("_v", "$.id", "bigint"), F.lit(0).cast("bigint"))
    out = df.withColumns(
        {
            "type": _text("$.kind"),
            "queue": _or(_text("$.queue"), F.col("queue")),
            "args": F.coalesce(wrap_in_array(F.to_json(member("_v", "$.args"))), F.lit("[]")),
            "priority": _positive("$.priority"),
            "scheduled_at": F.nullif(_text("$.scheduled_at"), F.lit("")),
            "meta": F.to_json(F.struct(job_id.alias("river_id"), _text("$.state").alias("river_state"))),
        }
    )
    return _split(out, raw, [payload])


ADAPTERS: dict[str, Callable[..., Conversion]] = {
    "sidekiq": from_sidekiq,
    "bullmq": from_bullmq,
    "celery": from_celery,
    "faktory": from_faktory,
    "river": from_river,
}


def register_adapter(name: str, adapter: Callable[..., Conversion]) -> None:
    """Add a source format: a function from raw rows to a :class:`Conversion`."""
    ADAPTERS[name] = adapter


def convert(source: str, raw: DataFrame, **options) -> Conversion:
    if source not in ADAPTERS:
        raise ValueError(f"unsupported source: {source}; supported sources: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[source](raw, **options)
