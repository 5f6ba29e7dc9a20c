"""Output of a stream as a folder with one part per micro-batch.

Writing a part again replaces it, so a batch that is repeated after a failure leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobscope.session import work_dir


class EpochTable:
    """Rows of all micro-batches with their batch number in ``epoch``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def write(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def read(self, before: int | None = None) -> DataFrame:
        spark = self.spark
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        schema = f"{self.schema}, epoch bigint"
        if not exists:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(self.path)
        return rows if before is None else rows.filter(F.col("epoch") < before)

    def replace(self, df: DataFrame, epoch: int) -> None:
        """Write a batch that stands for all before it; of those only the last is kept, for readers at work."""
        self.write(df, epoch)
        spark = self.spark
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in system.listStatus(hadoop):
            name = status.getPath().getName()
            if name.startswith("epoch=") and int(name.removeprefix("epoch=")) < epoch - 1:
                system.delete(status.getPath(), True)

    def newest(self) -> DataFrame:
        """The rows of the newest batch."""
        rows = self.read()
        last = rows.agg(F.max("epoch").alias("_last"))
        return rows.join(F.broadcast(last), rows["epoch"] == last["_last"]).drop("epoch", "_last")

    def latest(self, keys: Sequence[str]) -> DataFrame:
        """The row of the latest batch per key (a key occurs at most once per batch)."""
        rows = self.read()
        others = [c for c in rows.columns if c not in (*keys, "epoch")]
        newest = F.max_by(F.struct(*others), F.col("epoch"))
        return rows.groupBy(*keys).agg(newest.alias("_last")).select(*keys, "_last.*")

    def compact(self, keys: Sequence[str], path: str) -> EpochTable:
        """The latest rows as a new table in ``path``, numbered as the last batch they include."""
        last = self.read().agg(F.max("epoch")).first()[0]
        target = EpochTable(self.spark, path, self.schema)
        if last is not None:
            target.write(self.latest(keys), last)
        return target


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Run ``write`` for every micro-batch; processes what is there and stops unless a trigger is given."""
    spark = stream.sparkSession
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or work_dir(spark, "stream"))
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def drain(query: StreamingQuery) -> None:
    """Wait until all available input is processed."""
    query.awaitTermination()
