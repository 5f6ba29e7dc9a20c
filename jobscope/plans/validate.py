"""Row validation: canonical job lines, converted configurations, manifests, contracts.

Every rule that fails gives one error row; nothing stops at the first error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from jobscope.functions import args_state, member
from jobscope.functions.jsons import kind_differs, text_member
from jobscope.operators.shape import once, spread
from jobscope.schemas import CONVERTED_CONFIG, MANIFEST
from jobscope.session import cut_lineage

# Messages of the job rules.
INVALID_JSON = "invalid JSON"
MISSING = "missing required field: "
NOT_ARRAY = "args must be a JSON array"
NEGATIVE = "priority must be non-negative"
BAD_TYPE = "bad type: "

# Members of a job line with a type, and the JSON kinds they may have.
JOB_MEMBERS = {
    "type": ("string", "null"),
    "queue": ("string", "null"),
    "priority": ("int", "null"),
    "scheduled_at": ("string", "null"),
    "meta": ("object", "null"),
}


def _errors(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def with_job_errors(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Non-empty lines with an ``errors`` array; a line that cannot be read has exactly one error."""
    parsed = once(spread(lines.filter(F.col(raw) != "")), _v=F.try_parse_json(raw))
    start = F.ltrim(raw)
    unreadable = F.when(F.col("_v").isNull() | ~(start.startswith("{") | start.startswith("n")), INVALID_JSON)
    for name, kinds in JOB_MEMBERS.items():
        wrong = kind_differs(member("_v", f"$.{name}"), kinds)
        unreadable = F.coalesce(unreadable, F.when(wrong, BAD_TYPE + name))
    args = args_state("_v")
    rules = _errors(
        F.when(_blank(text_member("_v", "$.type")), MISSING + "type"),
        F.when(_blank(text_member("_v", "$.queue")), MISSING + "queue"),
        F.when(args == "missing", MISSING + "args").when(args == "not_array", NOT_ARRAY),
        F.when(F.try_variant_get("_v", "$.priority", "bigint") < 0, NEGATIVE),
    )
    parsed = once(parsed, _unreadable=unreadable)
    errors = F.when(F.col("_unreadable").isNotNull(), F.array("_unreadable")).otherwise(rules)
    return once(parsed, errors=errors).drop("_v", "_unreadable")


def validate_jobs(lines: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(error rows, summary): a line counts as invalid once however many errors it has."""
    checked = with_job_errors(lines, raw)
    keys = [c for c in lines.columns if c != raw]
    errors = checked.select(*keys, F.explode("errors").alias("message"))
    summary = checked.agg(
        F.count("*").alias("total"),
        F.count_if(F.size("errors") == 0).alias("valid"),
        F.count_if(F.size("errors") > 0).alias("invalid"),
    )
    return errors, summary


def first_errors(errors: DataFrame, order: list[str], limit: int = 20) -> DataFrame:
    """The first errors in file order, each with the number of errors that are not shown.

    Errors are counted on the way to the first ones, so lines are parsed once; the few rows are written out.
    """
    seen = Observation()
    counted = errors.observe(seen, F.count(F.lit(1)).alias("n"))
    first = cut_lineage(counted.orderBy(*order, "message").limit(limit), "errors")
    return first.withColumn("more", F.lit(max(0, seen.get["n"] - limit)).cast("bigint"))


def validate_config(configs: DataFrame, content: str = "content") -> DataFrame:
    """Errors of converted configurations, one row per (path, job index, message)."""
    doc = once(spread(configs.select("path", content)), c=F.from_json(content, CONVERTED_CONFIG))
    jobs = doc.select("path", F.posexplode("c.jobs").alias("job", "j"))
    errors = _errors(
        F.when(_blank(F.col("j.type")), "missing type"),
        F.when(_blank(F.col("j.queue")), "missing queue"),
        F.when(F.col("j.options.retry.max_attempts") < 0, "invalid max_attempts"),
    )
    broken = configs.where(F.try_parse_json(content).isNull()).select("path", F.lit(None).cast("int").alias("job"), F.lit("invalid JSON").alias("message"))
    return jobs.select("path", "job", F.explode(errors).alias("message")).unionByName(broken)


def parse_manifests(manifests: DataFrame, content: str = "content") -> DataFrame:
    """Job types of JSON manifests, one row per entry, with the defaults for queue and argument type."""
    doc = once(spread(manifests.select("path", content)), m=F.from_json(content, MANIFEST))
    entries = doc.select("path", F.posexplode("m.job_types").alias("job_type", "t"))
    queue = F.when(_blank(F.col("t.queue")), "default").otherwise(F.col("t.queue"))
    args = F.transform(
        "t.args", lambda a: a.withField("type", F.when(F.coalesce(a["type"], F.lit("")) == "", "string").otherwise(a["type"]))
    )
    return entries.withColumn("t", F.col("t").withField("queue", queue).withField("args", args))


def validate_manifest(manifests: DataFrame, content: str = "content") -> DataFrame:
    """Errors per manifest: no job types, missing type, repeated type, argument without a name.

    ``job_type`` and ``arg`` are positions, null when the error is not about one.
    """
    none = F.lit(None).cast("int")
    doc = once(spread(manifests.select("path", content)), m=F.from_json(content, MANIFEST))
    empty = doc.filter(F.coalesce(F.size("m.job_types"), F.lit(0)) < 1).select(
        "path",
        none.alias("job_type"),
        none.alias("arg"),
        F.when(F.try_parse_json(content).isNull(), "invalid JSON").otherwise("manifest contains no job types").alias("message"),
    )
    types = F.transform("m.job_types", lambda t: t["type"])
    entries = doc.select("path", types.alias("types"), F.posexplode("m.job_types").alias("job_type", "t"))
    earlier = F.array_contains(F.slice("types", F.lit(1), F.col("job_type")), F.col("t.type"))
    of_types = entries.select(
        "path",
        "job_type",
        none.alias("arg"),
        F.explode(
            _errors(
                F.when(_blank(F.col("t.type")), "type is required"),
                F.when(~_blank(F.col("t.type")) & earlier, F.concat(F.lit("duplicate job type: "), F.col("t.type"))),
            )
        ).alias("message"),
    )
    of_args = (
        entries.select("path", "job_type", F.posexplode("t.args").alias("arg", "a"))
        .filter(_blank(F.col("a.name")))
        .select("path", "job_type", "arg", F.lit("name is required").alias("message"))
    )
    return empty.unionByName(of_types).unionByName(of_args)


def validate_contracts(contracts: DataFrame, key: str = "seq") -> DataFrame:
    """Errors of contract rows (service, role, job_type)."""
    role = F.coalesce("role", F.lit(""))
    errors = _errors(
        F.when(_blank(F.col("service")), "missing service name"),
        F.when(_blank(F.col("job_type")), "missing job_type"),
        F.when(~role.isin("producer", "consumer"), F.concat(F.lit("role must be 'producer' or 'consumer', got \""), role, F.lit('"'))),
    )
    return contracts.select(key, F.explode(errors).alias("message"))
