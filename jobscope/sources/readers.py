"""Readers for job lines, export documents, configurations, source trees and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.operators.shape import broadcast_if_small, measured, once
from jobscope.schemas import EXPORT_DOCUMENT, EXPORT_VERSION, LIVE_JOB
from jobscope.sources.documents import read_elements


def read_job_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Job lines as (file, line, raw); blank lines are dropped but counted in the line numbers.

    Files are split for reading.  A line's number is its rank in its block plus the lines of the blocks
    before it, so numbering needs one row per block and no sort of the lines.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = scan.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.regexp_replace("value", "\r$", "").alias("raw"),
    )
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("file", "_block")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .select("file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    numbered = lines.join(broadcast_if_small(measured(blocks)), ["file", "_block"])
    return numbered.filter(F.col("raw") != "").select(
        "file", (F.col("_offset") + F.col("_id") - F.col("_first") + 1).alias("line"), "raw"
    )


def _versioned(column: str) -> Column:
    message = F.concat(F.lit("unsupported export version: "), F.coalesce("version", F.lit("")), F.lit(f" (expected {EXPORT_VERSION})"))
    return F.when(F.col("version") == EXPORT_VERSION, F.col(column)).otherwise(F.raise_error(message)).alias(column)


def read_export_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, jobs) of single-document exports, one document per file.

    A document of any size is read by many tasks (:mod:`jobscope.sources.documents`).  Any version but 1.0 fails
    when the jobs are read.
    """
    rest, elements = read_elements(spark, path, "jobs")
    kind = T.StructType.fromDDL(EXPORT_DOCUMENT)["jobs"].dataType.elementType
    documents = once(rest, d=F.from_json("raw", EXPORT_DOCUMENT)).select("file", "d.*")
    header = documents.select("version", "source", "exported_at", "options", "stats")
    versions = broadcast_if_small(measured(documents.select("file", _versioned("version").alias("_version"))))
    jobs = once(elements.join(versions, "file"), j=F.from_json("raw", kind)).where("_version is not null").select("j.*")
    return header, jobs


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, jobs) of an export folder with a header and job lines."""
    header = spark.read.schema("version string, source struct<backend:string,url:string,version:string>, exported_at string").json(f"{path}/header")
    missing = F.raise_error(F.lit("the export has no header")).cast("string")
    version = header.select(_versioned("version")).agg(F.coalesce(F.max("version"), missing).alias("version"))
    jobs = spark.read.schema(LIVE_JOB).json(f"{path}/jobs")
    # The check is part of the plan: reading jobs of another version fails.
    return header, jobs.filter(version.scalar() == EXPORT_VERSION)


def read_configs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content), one file per row."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_source_tree(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, content) of all files below ``root``; ``pattern`` is a file-name glob."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_event_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder of event text files as a stream of lines."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).withColumnRenamed("value", "raw")


def parse_event_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Data lines of an event stream; works on batch and streaming frames.

    Lines that do not start with ``data:`` are dropped, the prefix and outer blanks removed.  Text that is
    not a JSON object passes through with null fields.
    """
    kept = [c for c in lines.columns if c != raw]
    data = lines.filter(F.col(raw).startswith("data:")).select(*kept, F.trim(F.substr(raw, F.lit(6))).alias("data"))
    parsed = once(data, _v=F.try_parse_json("data"))
    fields = [F.try_variant_get("_v", f"$.{name}", "string").alias(name) for name in ("type", "event", "job_id", "queue")]
    return parsed.select(*kept, "data", F.col("_v").isNotNull().alias("is_json"), *fields)
