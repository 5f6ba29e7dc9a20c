"""JSON helpers on variants: presence, kind, wrapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope.functions.names import _col


# Variant type names and the JSON kind each stands for.
KINDS = {
    "STRING": "string",
    "BIGINT": "int",
    "DECIMAL": "number",
    "DOUBLE": "number",
    "FLOAT": "number",
    "BOOLEAN": "bool",
    "OBJECT": "object",
    "ARRAY": "array",
    "VOID": "null",
}


def member(doc: Column | str, path: str) -> Column:
    """The member as a variant: SQL null when absent, a JSON null when it is there but null."""
    return F.variant_get(_col(doc), path, "variant")


def json_kind(value: Column | str) -> Column:
    """string, int, number, bool, object, array or null; SQL null when there is no value.

    One table lookup on the type name, so that the value is looked at once.
    """
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return kinds[F.regexp_extract(F.schema_of_variant(_col(value)), "^[A-Z]+", 0)]


def kind_differs(value: Column | str, kinds: tuple[str, ...]) -> Column:
    """Whether a value has none of the given JSON kinds; null when there is no value.

    Plain type names are compared directly, which is cheaper than :func:`json_kind`.
    """
    schema = F.schema_of_variant(_col(value))
    fits = schema.isin([name for name, kind in KINDS.items() if kind in kinds])
    for name in ("DECIMAL", "OBJECT", "ARRAY"):
        if KINDS[name] in kinds:
            fits |= schema.startswith(name)
    return ~fits


def text_member(doc: Column | str, path: str) -> Column:
    return F.try_variant_get(_col(doc), path, "string")


def args_state(doc: Column | str) -> Column:
    """``missing``, ``not_array`` or null.  A JSON null counts as present and valid."""
    kind = json_kind(member(doc, "$.args"))
    return F.when(kind.isNull(), "missing").when(~kind.isin("array", "null"), "not_array")


def is_json_array(text: Column | str) -> Column:
    return F.json_array_length(_col(text)).isNotNull()


def wrap_in_array(text: Column | str) -> Column:
    """JSON text as a one-element array unless it is an array already."""
    text = _col(text)
    return F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
