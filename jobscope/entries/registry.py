"""Registered queries: a Spark function over the parquet tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobscope import bindings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = dt.datetime(2024, 1, 31)


class Tables:
    """Entities of one data folder: ``t.jobs`` is the jobs view, ``t.base("part")`` a stored table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # Stored times carry no zone and mean UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return bindings.view(self.spark, self.sf_dir, name)

    def base(self, name: str) -> DataFrame:
        return bindings.load(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register a query; ``views`` names the entities the SQL text reads."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = bindings.with_views(sql, *views.split()) if views else sql
        return fn

    return register
