"""Scalar functions: native column expressions only, no Python row functions."""

from jobscope.functions.jsons import args_state, is_json_array, json_kind, member, wrap_in_array  # noqa: F401
from jobscope.functions.names import (  # noqa: F401
    camel_case,
    class_to_type,
    function_to_type,
    name_to_type,
    pascal_case,
    snake_case,
)
from jobscope.functions.sql import register_functions  # noqa: F401
from jobscope.functions.text import (  # noqa: F401
    arg_type,
    dash_if_null,
    grade,
    key_suffix,
    percent_text,
    short_error,
    spark_arg_type,
    split_list,
    state_class,
)
from jobscope.functions.timing import (  # noqa: F401
    backoff_seconds,
    delay_to_timestamp,
    duration,
    epoch_text,
    route,
)
