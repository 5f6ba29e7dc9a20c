"""Writers for canonical job lines, export folders and metric text."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from jobscope.operators.stats import export_stats, metrics_exposition
from jobscope.schemas import EXPORT_VERSION, NDJSON_BATCH


def _quoted(c: str) -> Column:
    """A string as a JSON string literal."""
    array = F.to_json(F.array(F.col(c)))
    return F.substr(array, F.lit(2), F.length(array) - 2)


def job_lines(jobs: DataFrame) -> DataFrame:
    """Canonical jobs as JSON text in a column ``value``.

    type, queue and args are always there; priority, scheduled_at and meta only when they have a value.
    The JSON of args and meta is taken over character by character.
    """

    def optional(name: str, text: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f',"{name}":'), text), F.lit(""))

    filled = jobs.withColumns({"type": F.coalesce("type", F.lit("")), "queue": F.coalesce("queue", F.lit(""))})
    line = F.concat(
        F.lit('{"type":'),
        _quoted("type"),
        F.lit(',"queue":'),
        _quoted("queue"),
        F.lit(',"args":'),
        F.coalesce("args", F.lit("null")),
        optional("priority", F.col("priority").cast("string")),
        optional("scheduled_at", F.when(F.col("scheduled_at") != "", _quoted("scheduled_at"))),
        optional("meta", F.nullif(F.col("meta"), F.lit("{}"))),
        F.lit("}"),
    )
    return filled.select(line.alias("value"))


def write_job_ndjson(jobs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    job_lines(jobs).write.mode(mode).text(path)


def write_export(jobs: DataFrame, path: str, source: dict[str, str], exported_at: str, mode: str = "errorifexists") -> None:
    """An export folder: ``jobs`` as JSON lines, ``header`` and ``stats`` as small files next to it."""
    spark = jobs.sparkSession
    jobs.write.mode(mode).json(f"{path}/jobs")
    # The jobs are read back for the statistics, so that they describe what was written.
    written = spark.read.schema("state string, queue string").json(f"{path}/jobs")
    export_stats(written).coalesce(1).write.mode(mode).json(f"{path}/stats")
    header = json.dumps({"version": EXPORT_VERSION, "source": source, "exported_at": exported_at})
    spark.range(1).select(F.lit(header).alias("value")).coalesce(1).write.mode(mode).text(f"{path}/header")


def write_export_documents(jobs: DataFrame, path: str, source: dict[str, str], exported_at: str, mode: str = "errorifexists") -> None:
    """Exports as single JSON documents, one per partition of ``jobs``, each written by one task as it reads its rows."""
    header = json.dumps({"version": EXPORT_VERSION, "source": source, "exported_at": exported_at})[:-1] + ', "jobs": ['

    def framed(batches):
        lead = ""
        yield pa.RecordBatch.from_pydict({"value": [header]})
        for batch in batches:
            if batch.num_rows:
                lines = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_pydict({"value": [lead + lines[0], *("," + x for x in lines[1:])]})
                lead = ","
        yield pa.RecordBatch.from_pydict({"value": ["]}"]})

    jobs.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(framed, "value string").write.mode(mode).text(path)


def write_metrics(metric_rows: DataFrame, path: str, prefix: str = "", mode: str = "overwrite") -> None:
    metrics_exposition(metric_rows, prefix).coalesce(1).write.mode(mode).text(path)


def send_in_batches(jobs: DataFrame, send: Callable[[list[dict]], None], size: int = NDJSON_BATCH) -> None:
    """Hand job rows to ``send`` in batches of ``size`` from each task; at-least-once after a lost task."""

    def run(rows) -> None:
        batch: list[dict] = []
        for row in rows:
            batch.append(row.asDict(recursive=True))
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    jobs.foreachPartition(run)


@dataclass
class Sent(WriterCommitMessage):
    """What one task handed over."""

    rows: int
    batches: int


def sending_source(send: Callable[[tuple[str, int, int], list[dict]], None], run: str, size: int = NDJSON_BATCH, finish: Callable[[bool, list[Sent]], None] | None = None) -> type[DataSource]:
    """A data source that hands rows to ``send`` from the tasks, for ``spark.dataSource.register`` and ``df.write``.

    ``send`` gets (run, task, number of the batch) with each batch.  A task that is tried again, or a run that is
    started again, gives the same batch the same key where the rows of a partition come in the same order, so a
    receiver that keeps one batch per key has no duplicates.  When all tasks have committed, ``finish`` is called
    once, in a Python process beside the driver, with True and what each has sent; with False when the write is given up.
    """

    class Writer(DataSourceWriter):
        def write(self, iterator) -> Sent:
            from pyspark import TaskContext

            task, rows, batches, batch = TaskContext.get().partitionId(), 0, 0, []
            for row in iterator:
                batch.append(row.asDict(recursive=True))
                if len(batch) == size:
                    send((run, task, batches), batch)
                    rows, batches, batch = rows + len(batch), batches + 1, []
            if batch:
                send((run, task, batches), batch)
                rows, batches = rows + len(batch), batches + 1
            return Sent(rows, batches)

        def commit(self, messages) -> None:
            if finish:
                finish(True, [m for m in messages if m is not None])

        def abort(self, messages) -> None:
            if finish:
                finish(False, [m for m in messages if m is not None])

    class JobSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "jobsink"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return Writer()

    return JobSink


def send_committed(jobs: DataFrame, send: Callable[[tuple[str, int, int], list[dict]], None], run: str, size: int = NDJSON_BATCH, finish: Callable[[bool, list[Sent]], None] | None = None) -> None:
    """Write job rows through :func:`sending_source`; raises if a task has failed for good."""
    jobs.sparkSession.dataSource.register(sending_source(send, run, size, finish))
    jobs.write.format("jobsink").mode("append").save()
