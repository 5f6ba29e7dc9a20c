"""Text, state and grading helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope.functions.names import _col
from jobscope.schemas import ERROR_WIDTH


def split_list(c: Column | str) -> Column:
    """Comma list to array; empty items are dropped, blanks are kept as they are."""
    return F.filter(F.split(_col(c), ","), lambda x: x != "")


def short_error(c: Column | str, width: int = ERROR_WIDTH) -> Column:
    """Texts longer than ``width`` characters end in three dots."""
    c = _col(c)
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width - 3)), F.lit("..."))).otherwise(c)


def state_class(c: Column | str) -> Column:
    """Groups job states and their aliases for display."""
    c = _col(c)
    return (
        F.when(c == "completed", "done")
        .when(c == "active", "running")
        .when(c.isin("available", "pending"), "waiting")
        .when(c == "retryable", "retrying")
        .when(c.isin("discarded", "failed", "dead"), "failed")
        .when(c == "cancelled", "cancelled")
        .otherwise(c)
    )


def percent_text(c: Column | str) -> Column:
    """A share between 0 and 1 as whole percent, such as ``42%``; null stays null."""
    c = _col(c)
    return F.when(c.isNotNull(), F.format_string("%.0f%%", F.bround(c * 100, 0)))


def dash_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit("-"))


def arg_type(c: Column | str) -> Column:
    """Contract argument types with their synonyms folded; unknown names become ``any``."""
    t = F.lower(_col(c))
    return (
        F.when(t == "string", "string")
        .when(t.isin("int", "integer"), "int")
        .when(t.isin("float", "number"), "float")
        .when(t.isin("bool", "boolean"), "bool")
        .when(t.isin("object", "array"), t)
        .otherwise("any")
    )


# Spark column type for each contract argument type.
SPARK_TYPES = {
    "string": "string",
    "int": "bigint",
    "float": "double",
    "bool": "boolean",
    "object": "map<string,variant>",
    "array": "array<variant>",
    "any": "variant",
}


def spark_arg_type(c: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SPARK_TYPES.items() for x in pair])
    return table[arg_type(c)]


def grade(score: Column, max_score: Column) -> Column:
    """School grade for a whole percentage of the greatest possible score."""
    pct = F.floor(score * 100 / max_score)
    return F.when(pct >= 90, "A").when(pct >= 80, "B").when(pct >= 70, "C").when(pct >= 60, "D").otherwise("F")


def key_suffix(key: Column | str, prefix: str) -> Column:
    """The part of a store key behind ``prefix``; null when the key does not start with it."""
    key = _col(key)
    return F.when(key.startswith(prefix), F.substr(key, F.lit(len(prefix) + 1)))
