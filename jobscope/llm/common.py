"""What the operators share: reading tables, per-row Arrow columns, and intermediate tables."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from jobscope.operators.shape import estimated_bytes
from jobscope.session import cut_lineage, discard  # noqa: F401

#: Rows go to Python workers in batches of about this size, so that long texts do not add up.
BATCH_BYTES = "4m"
#: Tables whose files are at most this large are broadcast; larger ones are joined by a shuffle.
BROADCAST_FILE_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's size limit of Arrow batches, in which long texts would add up otherwise."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str):
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back; its size is then known."""
    bounded_batches(df.sparkSession)
    return cut_lineage(df, f"llm-{purpose}")


def small(df: DataFrame, limit: int = BROADCAST_FILE_BYTES) -> DataFrame:
    """A stored table with a broadcast hint if its files are within ``limit``, else unchanged (shuffled join)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def once_per_process(key: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept for later tasks of the same Python worker; for a few things that are costly to set up."""
    kept = sys.modules.setdefault("_kept_by_tasks", ModuleType("_kept_by_tasks"))
    if key not in kept.__dict__:
        kept.__dict__[key] = make()
    return kept.__dict__[key]


def map_text(
    df: DataFrame,
    fields: Sequence[T.StructField],
    start: Callable[[], Callable[[list], list]],
    text: str = "text",
    keep: Sequence[str] | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Columns computed from whole texts, one result per row.

    ``start`` runs once per task and returns a function from a list of texts (``bytes`` in UTF-8, or None) to one
    sequence per field; the values of ``extra`` follow the texts as further lists.  ``keep`` names the input columns that are passed on (all by default); an input column
    that has the name of a new field is dropped.
    """
    bounded_batches(df.sparkSession)
    new = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    # mapInArrow reads dots in names as paths, so columns travel under plain names.
    carried = [f"__c{i}" for i in range(len(kept))]
    data = df.select(
        *[col(f.name).alias(c) for f, c in zip(kept, carried)],
        col(text).cast("binary").alias("__text"),
        *[c.alias(f"__extra{i}") for i, c in enumerate(extra)],
    )
    types = [to_arrow_type(f.dataType) for f in fields]
    names = carried + new

    def run(batches):
        compute = start()
        for batch in batches:
            if not batch.num_rows:
                continue
            results = compute(*[batch.column(i).to_pylist() for i in range(len(kept), batch.num_columns)])
            arrays = [batch.column(i) for i in range(len(kept))]
            arrays += [pa.array(r, type=t) for r, t in zip(results, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType([T.StructField(c, f.dataType) for f, c in zip(kept, carried)] + list(fields))
    return data.mapInArrow(run, schema).toDF(*[f.name for f in kept], *new)
