"""Durations, delays, backoff and percentage routing."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope.functions.names import _col

# Seconds per duration unit.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def duration(c: Column | str) -> Column:
    """``90s``, ``5m``, ``24h`` or ``7d`` as an interval; anything else is null."""
    c = _col(c)
    number = F.regexp_extract(c, r"^(\d+)([smhd])$", 1)
    unit = F.regexp_extract(c, r"^(\d+)([smhd])$", 2)
    scale = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])[F.nullif(unit, F.lit(""))]
    seconds = F.nullif(number, F.lit("")).cast("bigint") * scale
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def parse_duration(text: str) -> dt.timedelta:
    """The same duration texts for Python parameters."""
    match = re.fullmatch(r"(\d+)([smhd])", text)
    if not match:
        raise ValueError(f"not a duration: {text!r}; use a number with s, m, h or d")
    return dt.timedelta(seconds=int(match[1]) * UNIT_SECONDS[match[2]])


def epoch_text(seconds: Column | str) -> Column:
    """Epoch seconds without fraction, rounded half to even; null unless positive."""
    seconds = _col(seconds)
    return F.when(seconds > 0, F.bround(seconds, 0).cast("bigint").cast("string"))


def delay_to_timestamp(millis: Column | str, as_of: Column) -> Column:
    """``as_of`` plus a positive delay, as RFC 3339 text in whole seconds; null otherwise."""
    millis = _col(millis)
    shifted = as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (millis / 1000).cast("decimal(18,6)"))
    return F.when(millis > 0, F.date_format(shifted, RFC3339))


def backoff_seconds(strategy: Column, attempt: Column, initial: Column) -> Column:
    """Wait before the retry after ``attempt``: fixed, linear, exponential or polynomial (n^4 + 15)."""
    attempt = attempt.cast("double")
    return (
        F.when(strategy.isin("fixed", "constant"), initial.cast("double"))
        .when(strategy == "linear", initial * attempt)
        .when(strategy == "polynomial", F.pow(attempt, F.lit(4)) + 15)
        .otherwise(initial * F.pow(F.lit(2.0), attempt - 1))
    )


def route(job_id: Column | str, percent: Column | int) -> Column:
    """``target`` for the given share of ids, ``legacy`` for the rest; an id always goes the same way."""
    bucket = F.conv(F.left(F.md5(_col(job_id)), F.lit(8)), 16, 10).cast("bigint") % 100
    return F.when(bucket < percent, "target").otherwise("legacy")
