"""Scalar functions over whole tables, as expressions and as SQL functions."""

from pyspark.sql import functions as F

from jobscope import functions as fn
from jobscope.entries.registry import query

_NAMES = """n AS (SELECT p_partkey, concat(p_brand, '::', upper(substr(p_name, 1, 1)), replace(substr(p_name, 2), ' ', 'Big'), 'HTTPWorker') AS class,
  concat(replace(p_name, ' ', '_'), 'ToSize-', CAST(p_size AS VARCHAR), '.Xy') AS name FROM part)"""
# A word is found here by position instead of by pattern, to differ from the expression under test.
_SPLIT_CAPS = "lower(concat(substr({0}, 1, 1), regexp_replace(substr({0}, 2), '([A-Z])', '{1}\\1', 'g')))"
_WORDS = "list_filter(string_split_regex(lower(name), '[. _-]'), lambda x: x <> '')"


def _names(t):
    part = t.base("part")
    return part.select(
        "p_partkey",
        F.concat("p_brand", F.lit("::"), F.upper(F.left("p_name", F.lit(1))), F.replace(F.substr("p_name", F.lit(2)), F.lit(" "), F.lit("Big")), F.lit("HTTPWorker")).alias("class"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("ToSize-"), F.col("p_size").cast("string"), F.lit(".Xy")).alias("name"),
    )


_NAME_SQL = f"""WITH {_NAMES} SELECT p_partkey, lower(regexp_replace(replace(class, '::', '.'), '([a-z])([A-Z])', '\\1.\\2', 'g')) AS class_type,
      replace({_SPLIT_CAPS.format('class', '_')}, '_', '.') AS name_type,
      trim(regexp_replace({_SPLIT_CAPS.format('name', '.')}, '[._-]+', '.', 'g'), '.') AS function_type,
      array_to_string(list_transform({_WORDS}, lambda w: upper(w[1]) || w[2:]), '') AS pascal,
      array_to_string(list_transform({_WORDS}, lambda w, i: CASE WHEN i = 1 THEN w ELSE upper(w[1]) || w[2:] END), '') AS camel,
      array_to_string({_WORDS}, '_') AS snake FROM n"""


@query("fn_names", _NAME_SQL)
def fn_names(t):
    return _names(t).select(
        "p_partkey",
        fn.class_to_type("class").alias("class_type"),
        fn.name_to_type("class").alias("name_type"),
        fn.function_to_type("name").alias("function_type"),
        fn.pascal_case("name").alias("pascal"),
        fn.camel_case("name").alias("camel"),
        fn.snake_case("name").alias("snake"),
    )


@query("fn_sql", _NAME_SQL)
def fn_sql(t):
    """The same through the registered SQL functions."""
    fn.register_functions(t.spark)
    return _names(t).selectExpr(
        "p_partkey",
        "class_to_type(class) AS class_type",
        "name_to_type(class) AS name_type",
        "function_to_type(name) AS function_type",
        "pascal_case(name) AS pascal",
        "camel_case(name) AS camel",
        "snake_case(name) AS snake",
    )


def _sometimes_array():
    return F.when(F.col("priority") % 3 == 0, F.col("args_json")).otherwise(F.concat(F.lit('{"a":'), F.col("args_json"), F.lit("}")))


@query(
    "fn_text",
    """SELECT job_id, CASE WHEN length(error) > 60 THEN concat(left(error, 57), '...') ELSE error END AS short, coalesce(error, '-') AS dashed,
      CASE state WHEN 'completed' THEN 'done' WHEN 'active' THEN 'running' WHEN 'available' THEN 'waiting' WHEN 'retryable' THEN 'retrying' WHEN 'discarded' THEN 'failed' ELSE state END AS shown,
      concat('[', CAST(priority AS VARCHAR), ']') AS wrapped, args_json AS kept, priority % 3 = 0 AS is_array, CAST(1700000000 + priority AS VARCHAR) AS epoch, priority * 60 AS seconds
    FROM jobs""",
    "jobs",
)
def fn_text(t):
    text = F.concat(F.col("priority").cast("string"), F.lit("m"))
    zero = F.timestamp_seconds(F.lit(0))
    return t.jobs.select(
        "job_id",
        fn.short_error("error").alias("short"),
        fn.dash_if_null("error").alias("dashed"),
        fn.state_class("state").alias("shown"),
        fn.wrap_in_array(F.col("priority").cast("string")).alias("wrapped"),
        fn.wrap_in_array("args_json").alias("kept"),
        fn.is_json_array(_sometimes_array()).alias("is_array"),
        fn.epoch_text(F.col("priority") + F.lit(1700000000.4)).alias("epoch"),
        F.unix_seconds(zero + fn.duration(text)).cast("int").alias("seconds"),
    )


@query(
    "fn_lists",
    "SELECT id, unnest(list_filter(string_split(events_csv, ','), lambda x: x <> '')) AS event FROM subscriptions",
    "subscriptions",
)
def fn_lists(t):
    return t.subscriptions.select("id", F.explode(fn.split_list("events_csv")).alias("event"))


@query(
    "fn_route",
    "SELECT job_id, CASE WHEN CAST(concat('0x', left(md5(job_id), 8)) AS BIGINT) % 100 < 30 THEN 'target' ELSE 'legacy' END AS route FROM jobs",
    "jobs",
)
def fn_route(t):
    return t.jobs.select("job_id", fn.route("job_id", 30).alias("route"))


@query(
    "fn_arg_types",
    """SELECT DISTINCT arg_type, CASE arg_type WHEN 'string' THEN 'string' WHEN 'int' THEN 'bigint' WHEN 'float' THEN 'double' END AS spark_type,
      CASE WHEN arg_type = 'string' THEN 'any' ELSE arg_type END AS folded FROM contract_args""",
    "contract_args",
)
def fn_arg_types(t):
    other = F.when(F.col("arg_type") == "int", "INTEGER").when(F.col("arg_type") == "float", "number").otherwise("text")
    return t.contract_args.select("arg_type", fn.spark_arg_type("arg_type").alias("spark_type"), fn.arg_type(other).alias("folded")).distinct()


@query(
    "fn_sql_values",
    """SELECT job_id, CASE WHEN length(error) > 60 THEN concat(left(error, 57), '...') ELSE error END AS short, coalesce(error, '-') AS dashed,
      CASE state WHEN 'completed' THEN 'done' WHEN 'active' THEN 'running' WHEN 'available' THEN 'waiting' WHEN 'retryable' THEN 'retrying' WHEN 'discarded' THEN 'failed' ELSE state END AS shown,
      concat('[', CAST(priority AS VARCHAR), ']') AS wrapped, priority % 3 = 0 AS is_array, CAST(1700000000 + priority AS VARCHAR) AS epoch,
      concat(CAST(CAST(round_even(priority * 12.5, 0) AS INTEGER) AS VARCHAR), '%') AS share, CASE WHEN queue LIKE 'b%' THEN substr(queue, 2) END AS suffix,
      CASE WHEN priority >= 5 THEN 'A' WHEN priority >= 4 THEN 'C' ELSE 'F' END AS grade, args_json AS body,
      CASE priority % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'bool' ELSE 'any' END AS kind,
      strftime(TIMESTAMP '2024-01-31 00:00:00' + INTERVAL '1' SECOND * (priority * 2), '%Y-%m-%dT%H:%M:%SZ') AS scheduled,
      CAST(priority * CASE priority % 3 WHEN 0 THEN 60 WHEN 1 THEN 3600 ELSE 86400 END AS BIGINT) AS seconds,
      CAST(CASE priority % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 * priority WHEN 2 THEN priority ** 4 + 15 ELSE 2 * 2 ** (priority - 1) END AS DOUBLE) AS wait,
      CAST(concat('0x', left(md5(job_id), 8)) AS BIGINT) % 100 < 30 AS to_target, len(list_filter(string_split(concat(queue, ',,', state), ','), lambda x: x <> '')) AS parts
    FROM jobs""",
    "jobs",
)
def fn_sql_values(t):
    """The other registered SQL functions."""
    fn.register_functions(t.spark)
    jobs = t.jobs.withColumn("sometimes", _sometimes_array())
    return jobs.selectExpr(
        "job_id",
        "short_error(error) AS short",
        "dash_if_null(error) AS dashed",
        "state_class(state) AS shown",
        "wrap_in_array(cast(priority AS STRING)) AS wrapped",
        "is_json_array(sometimes) AS is_array",
        "epoch_text(1700000000.4D + priority) AS epoch",
        "percent_text(priority / 8D) AS share",
        "key_suffix(queue, 'b') AS suffix",
        "audit_grade(cast(priority * 19 AS BIGINT), 100L) AS grade",
        "celery_body(base64(cast(args_json AS BINARY))) AS body",
        "arg_type(element_at(array('Integer', 'number', 'BOOLEAN', 'date'), cast(priority % 4 AS INT) + 1)) AS kind",
        "delay_to_timestamp(cast(priority * 2000 AS BIGINT), TIMESTAMP_NTZ '2024-01-31 00:00:00') AS scheduled",
        "duration_seconds(concat(cast(priority AS STRING), element_at(array('m', 'h', 'd'), cast(priority % 3 AS INT) + 1))) AS seconds",
        "backoff_seconds(element_at(array('constant', 'linear', 'polynomial', 'exponential'), cast(priority % 4 AS INT) + 1), cast(priority AS INT), 2D) AS wait",
        "route_target(job_id, 30) AS to_target",
        "cast(size(split_list(concat(queue, ',,', state))) AS BIGINT) AS parts",
    )
