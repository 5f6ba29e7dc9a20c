"""Name normalisers.  Three of them differ on acronyms on purpose; callers choose by data source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def class_to_type(c: Column | str) -> Column:
    """``Mailers::WelcomeEmail`` to ``mailers.welcome.email``; runs of capitals stay together."""
    dotted = F.regexp_replace(F.replace(_col(c), F.lit("::"), F.lit(".")), "([a-z])([A-Z])", "$1.$2")
    return F.lower(dotted)


def name_to_type(c: Column | str) -> Column:
    """``sendEmail`` or ``send_email`` to ``send.email``; every capital starts a new word."""
    return F.replace(F.lower(F.regexp_replace(_col(c), "(?<!^)([A-Z])", "_$1")), F.lit("_"), F.lit("."))


def function_to_type(c: Column | str) -> Column:
    """As :func:`name_to_type`, with dashes as dots, runs of dots collapsed and outer dots removed."""
    dotted = F.lower(F.regexp_replace(_col(c), "(?<!^)([A-Z])", ".$1"))
    return F.btrim(F.regexp_replace(dotted, "[._-]+", "."), F.lit("."))


def _words(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(_col(c)), "[. _-]"), lambda w: w != "")


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.substr(word, F.lit(2)))


def pascal_case(c: Column | str) -> Column:
    """``image-resize`` to ``ImageResize``."""
    return F.array_join(F.transform(_words(c), _capitalised), "")


def camel_case(c: Column | str) -> Column:
    """``image-resize`` to ``imageResize``."""
    words = _words(c)
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(_capitalised(w))), "")


def snake_case(c: Column | str) -> Column:
    """``image-resize`` to ``image_resize``."""
    return F.array_join(_words(c), "_")
