"""Job search, dead letters, status and result lookups, export selection."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.functions import percent_text, short_error
from jobscope.operators.shape import broadcast_if_small
from jobscope.schemas import FAILURE_LIMIT, IMPORTABLE_STATES, SEARCH_LIMIT, SHORT_ID, TERMINAL_STATES


class Page(NamedTuple):
    """The rows of one result page and a one-row frame with the number of matches before the limit."""

    rows: DataFrame
    total: DataFrame

    def with_total(self) -> DataFrame:
        """The page rows with the total as a column (a scalar subquery, not a join)."""
        return self.rows.withColumn("total", self.total.scalar())


def page(matches: DataFrame, order: Sequence, limit: int) -> Page:
    return Page(matches.orderBy(*order).limit(limit), matches.agg(F.count("*").alias("total")))


def match_jobs(jobs: DataFrame, state: str | None = None, queue: str | None = None, type: str | None = None) -> DataFrame:
    """Equality filters, each optional, all of them ANDed; they reach the parquet scan."""
    for column, wanted in (("state", state), ("queue", queue), ("type", type)):
        if wanted:
            jobs = jobs.filter(F.col(column) == wanted)
    return jobs


def search_jobs(jobs: DataFrame, state: str | None = None, queue: str | None = None, type: str | None = None, limit: int = SEARCH_LIMIT) -> Page:
    """Newest jobs first, ties by id."""
    columns = [c for c in ("job_id", "type", "queue", "state", "priority", "attempt", "created_at") if c in jobs.columns]
    return page(match_jobs(jobs, state, queue, type).select(*columns), [F.desc("created_at"), "job_id"], limit)


def recent_failures(jobs: DataFrame, limit: int = FAILURE_LIMIT) -> DataFrame:
    """The latest discarded jobs with a shortened id and error text."""
    failed = jobs.filter(F.col("state") == "discarded").select("job_id", "type", "queue", "error", "created_at")
    return (
        failed.orderBy(F.desc("created_at"), "job_id")
        .limit(limit)
        .select(F.left("job_id", F.lit(SHORT_ID)).alias("id"), "type", "queue", short_error("error").alias("error"))
    )


def dead_letter(jobs: DataFrame, limit: int = SEARCH_LIMIT) -> Page:
    """Discarded jobs, the most recently discarded first."""
    dead = jobs.filter(F.col("state") == "discarded").select(
        "job_id", "type", "queue", F.col("attempt").alias("attempts"), F.col("completed_at").alias("discarded_at")
    )
    return page(dead, [F.desc("discarded_at"), "job_id"], limit)


def importable(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs in an importable state, and one row with the imported and skipped counts."""
    ready = F.col("state").isin(IMPORTABLE_STATES)
    counts = jobs.agg(F.count_if(ready).alias("importable"), F.count_if(~F.coalesce(ready, F.lit(False))).alias("skipped"))
    return jobs.filter(ready), counts


def select_for_export(
    jobs: DataFrame,
    include_completed: bool = False,
    queues: Sequence[str] = (),
    since=None,
    include_dead_letter: bool = False,
) -> DataFrame:
    """Jobs that go into an export.

    Finished jobs stay out unless asked for; ``include_dead_letter`` brings the discarded ones back.
    An empty ``queues`` means all; ``since`` is a timestamp literal or column.
    """
    if not include_completed:
        finished = [s for s in TERMINAL_STATES if not (include_dead_letter and s == "discarded")]
        jobs = jobs.filter(~F.col("state").isin(finished))
    if queues:
        jobs = jobs.filter(F.col("queue").isin(list(queues)))
    if since is not None:
        jobs = jobs.filter(F.col("created_at") >= since)
    return jobs


def cron_list(cron_jobs: DataFrame, enabled: bool | None = None) -> DataFrame:
    if enabled is None:
        return cron_jobs
    return cron_jobs.filter(F.col("enabled") == enabled)


def jobs_by_id(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Semi join; the id list is broadcast only when it is known to be small."""
    return jobs.join(broadcast_if_small(ids.select("job_id").distinct()), "job_id", "left_semi")


_BASE = ["job_id", "type", "state", "queue", "attempt", "priority", "created_at"]
_OPTIONAL = ["scheduled_at", "completed_at", "progress_data", "error"]
_DETAIL = ["args_json", "meta", "options", "started_at", "result", "errors"]


def job_status(jobs: DataFrame, ids: DataFrame, detail: bool = False) -> DataFrame:
    """Status rows for a table of ids; optional columns appear only when the input has them."""
    found = jobs_by_id(jobs, ids)
    wanted = _BASE + _OPTIONAL + (_DETAIL if detail else [])
    columns = [F.col(c) for c in wanted if c in jobs.columns]
    if "progress" in jobs.columns:
        columns.append(percent_text("progress").alias("progress"))
    return found.select(*columns)


def job_result(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """State, result, error and completion time for a table of ids."""
    wanted = [c for c in ("job_id", "state", "result", "error", "completed_at") if c in jobs.columns]
    return jobs_by_id(jobs, ids).select(*wanted)
