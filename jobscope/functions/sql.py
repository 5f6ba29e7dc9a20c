"""The scalar functions as temporary SQL functions, for users of ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

_CASE = "upper(left(w, 1)) || substr(w, 2)"
_WORDS = "filter(split(lower(s), '[. _-]'), w -> w <> '')"

SQL_FUNCTIONS = {
    "class_to_type(s STRING)": "lower(regexp_replace(replace(s, '::', '.'), '([a-z])([A-Z])', '$1.$2'))",
    "name_to_type(s STRING)": "replace(lower(regexp_replace(s, '(?<!^)([A-Z])', '_$1')), '_', '.')",
    "function_to_type(s STRING)": "trim(BOTH '.' FROM regexp_replace(lower(regexp_replace(s, '(?<!^)([A-Z])', '.$1')), '[._-]+', '.'))",
    "pascal_case(s STRING)": f"array_join(transform({_WORDS}, w -> {_CASE}), '')",
    "camel_case(s STRING)": f"array_join(transform({_WORDS}, (w, i) -> if(i = 0, w, {_CASE})), '')",
    "snake_case(s STRING)": f"array_join({_WORDS}, '_')",
    "split_list(s STRING)": "filter(split(s, ','), x -> x <> '')",
    "short_error(s STRING)": "if(length(s) > 60, left(s, 57) || '...', s)",
    "wrap_in_array(s STRING)": "if(startswith(ltrim(s), '['), s, '[' || s || ']')",
    "epoch_text(x DOUBLE)": "if(x > 0, cast(cast(bround(x, 0) AS BIGINT) AS STRING), NULL)",
    "percent_text(x DOUBLE)": "if(x IS NULL, NULL, format_string('%.0f%%', bround(x * 100, 0)))",
    "dash_if_null(s STRING)": "coalesce(s, '-')",
    "state_class(s STRING)": "CASE WHEN s = 'completed' THEN 'done' WHEN s = 'active' THEN 'running' WHEN s IN ('available', 'pending') THEN 'waiting' "
    "WHEN s = 'retryable' THEN 'retrying' WHEN s IN ('discarded', 'failed', 'dead') THEN 'failed' ELSE s END",
    "arg_type(s STRING)": "CASE lower(s) WHEN 'string' THEN 'string' WHEN 'int' THEN 'int' WHEN 'integer' THEN 'int' WHEN 'float' THEN 'float' "
    "WHEN 'number' THEN 'float' WHEN 'bool' THEN 'bool' WHEN 'boolean' THEN 'bool' WHEN 'object' THEN 'object' WHEN 'array' THEN 'array' ELSE 'any' END",
    "key_suffix(k STRING, prefix STRING)": "if(startswith(k, prefix), substr(k, length(prefix) + 1), NULL)",
    "audit_grade(score BIGINT, max_score BIGINT)": "CASE WHEN score * 100 DIV max_score >= 90 THEN 'A' WHEN score * 100 DIV max_score >= 80 THEN 'B' "
    "WHEN score * 100 DIV max_score >= 70 THEN 'C' WHEN score * 100 DIV max_score >= 60 THEN 'D' ELSE 'F' END",
    "celery_body(s STRING)": "coalesce(cast(try_to_binary(s, 'base64') AS STRING), s)",
    "delay_to_timestamp(ms BIGINT, as_of TIMESTAMP_NTZ)": "if(ms > 0, date_format(as_of + make_dt_interval(0, 0, 0, cast(ms / 1000 AS DECIMAL(18, 6))), "
    "\"yyyy-MM-dd'T'HH:mm:ss'Z'\"), NULL)",
    "duration_seconds(s STRING)": "cast(nullif(regexp_extract(s, '^(\\\\d+)([smhd])$', 1), '') AS BIGINT) * "
    "element_at(map('s', 1, 'm', 60, 'h', 3600, 'd', 86400), nullif(regexp_extract(s, '^(\\\\d+)([smhd])$', 2), ''))",
    "backoff_seconds(strategy STRING, attempt INT, initial DOUBLE)": "CASE WHEN strategy IN ('fixed', 'constant') THEN initial WHEN strategy = 'linear' THEN initial * attempt "
    "WHEN strategy = 'polynomial' THEN pow(attempt, 4) + 15 ELSE initial * pow(2, attempt - 1) END",
    "is_json_array(s STRING)": "json_array_length(s) IS NOT NULL",
    "route_target(id STRING, pct INT)": "cast(conv(left(md5(id), 8), 16, 10) AS BIGINT) % 100 < pct",
}

RESULT_TYPES = {
    "split_list": "ARRAY<STRING>",
    "route_target": "BOOLEAN",
    "is_json_array": "BOOLEAN",
    "duration_seconds": "BIGINT",
    "backoff_seconds": "DOUBLE",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create all functions in the session and return their names."""
    for signature, body in SQL_FUNCTIONS.items():
        result = RESULT_TYPES.get(signature.split("(")[0], "STRING")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
    return [s.split("(")[0] for s in SQL_FUNCTIONS]
