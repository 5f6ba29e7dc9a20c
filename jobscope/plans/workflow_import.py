"""Workflows from orchestration code: steps, edges, warnings, manifest rows.

Input rows are (path, content).  Results of both importers have the same columns, so their steps can be
unioned and turned into manifest rows together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.functions import function_to_type
from jobscope.operators.shape import once, spread

# Patterns of workflow code.
WORKFLOW = r"func\s+(\w+)\(ctx\s+workflow\.Context"
ACTIVITY = r"workflow\.ExecuteActivity\(\w+,\s*(\w+)"
CHILD = r"workflow\.ExecuteChildWorkflow\(ctx,\s*(\w+)"
GO = r"workflow\.Go\(ctx,\s*func"
SELECTOR = r"selector\.AddFuture"
DAG = r"""DAG\(\s*['"]([^'"]+)['"]"""
TASK = r"""(\w+)\s*=\s*(?:PythonOperator|BashOperator|KubernetesPodOperator|SimpleHttpOperator|EmailOperator)\(\s*\n?\s*task_id\s*=\s*['"]([^'"]+)['"]"""
# One operand of a dependency chain, with the next operand ahead so that a >> b >> c gives both edges.
EDGE = r"(\w+)(?=\s*>>\s*(\w+))"
LIST_EDGE = r"\[([^\]]+)\]\s*>>\s*(\w+)"
# Warnings that users read.
CHILD_WARNING = "child workflow '%s' — verify nesting structure manually"
PARALLEL_WARNING = "workflow '%s' uses goroutines/selectors — parallel steps may need manual review"
NO_ACTIVITY_WARNING = "workflow '%s' has no detected activities"
NO_TASK_WARNING = "DAG '%s' has no detected tasks"
# What a manifest row says besides its type.
DEFAULT_QUEUE = "default"
RETRY = {"max_attempts": 3, "backoff": "exponential", "initial_ms": 1000}


class Imported(NamedTuple):
    workflows: DataFrame
    steps: DataFrame
    edges: DataFrame
    warnings: DataFrame


def _find(c: Column | str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _steps(source: str, rows: DataFrame) -> DataFrame:
    return rows.select(
        "path", F.lit(source).alias("source"), "workflow", F.posexplode("steps").alias("position", "s")
    ).select("path", "source", "workflow", "position", "s.name", "s.kind", function_to_type("s.ref").alias("job_type"), F.lit(DEFAULT_QUEUE).alias("queue"))


def _step(name: Column, kind: str, ref: Column) -> Column:
    return F.struct(name.alias("name"), F.lit(kind).alias("kind"), ref.alias("ref"))


def extract_temporal(files: DataFrame, strict: bool = False) -> Imported:
    """Workflow functions with their activities and child workflows.

    Steps belong to the function they are written in, that is, to the text up to the next workflow
    function; ``strict`` gives every workflow the steps of the whole file.
    """
    scope = F.col("content") if strict else F.col("w.body")
    headers = _find("content", WORKFLOW, 1)
    # The text behind the k-th header is the (k+1)-th piece.
    bodies = F.slice(F.split("content", WORKFLOW), 2, F.size(headers))
    found = F.arrays_zip(headers.alias("name"), bodies.alias("body"))
    files = spread(files.filter(F.contains("content", F.lit("workflow.Context"))).select("path", "content"))
    rows = files.select("path", "content", F.explode(found).alias("w")).select(
        "path",
        F.col("w.name").alias("workflow"),
        F.concat(
            F.transform(_find(scope, ACTIVITY, 1), lambda n: _step(n, "task", n)),
            F.transform(_find(scope, CHILD, 1), lambda n: _step(n, "chain", n)),
        ).alias("steps"),
        (F.regexp_like(scope, F.lit(GO)) | F.regexp_like(scope, F.lit(SELECTOR))).alias("parallel"),
    )
    workflows = rows.select("path", F.lit("temporal").alias("source"), "workflow", F.size("steps").alias("step_count"), "parallel")
    child = F.transform(
        F.filter("steps", lambda s: s["kind"] == "chain"),
        lambda s: F.format_string(CHILD_WARNING, s["name"]),
    )
    notes = F.array_compact(
        F.array(
            F.when(F.col("parallel"), F.format_string(PARALLEL_WARNING, "workflow")),
            F.when(F.size("steps") == 0, F.format_string(NO_ACTIVITY_WARNING, "workflow")),
        )
    )
    warnings = rows.select("path", "workflow", F.explode(F.concat(child, notes)).alias("message"))
    # Steps run one after the other unless the function is parallel.
    chained = rows.filter(~F.col("parallel")).select(
        "path", "workflow", F.inline(F.arrays_zip(F.transform("steps", lambda s: s["name"]).alias("upstream"), F.transform(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), lambda s: s["name"]).alias("downstream")))
    )
    edges = chained.filter(F.col("downstream").isNotNull())
    return Imported(workflows, _steps("temporal", rows), edges, warnings)


def extract_airflow(files: DataFrame) -> Imported:
    """DAGs with their operator tasks and every ``>>`` edge, chains and lists included.

    An edge counts when its downstream name is a task of the file.
    """
    tasks = F.arrays_zip(_find("content", TASK, 1).alias("name"), _find("content", TASK, 2).alias("task_id"))
    files = spread(files.filter(F.contains("content", F.lit("DAG("))).select("path", "content"))
    rows = once(
        files.select("path", "content", F.explode(_find("content", DAG, 1)).alias("workflow")),
        steps=F.transform(tasks, lambda t: _step(t["name"], "task", t["task_id"])),
    )
    workflows = rows.select(
        "path", F.lit("airflow").alias("source"), "workflow", F.size("steps").alias("step_count"), F.lit(False).alias("parallel")
    )
    plain = F.arrays_zip(_find("content", EDGE, 1).alias("upstream"), _find("content", EDGE, 2).alias("downstream"))
    lists = F.arrays_zip(_find("content", LIST_EDGE, 1).alias("members"), _find("content", LIST_EDGE, 2).alias("downstream"))
    from_lists = F.flatten(
        F.transform(
            lists,
            lambda e: F.transform(
                F.split(e["members"], ","), lambda m: F.struct(F.trim(m).alias("upstream"), e["downstream"].alias("downstream"))
            ),
        )
    )
    names = F.transform("steps", lambda s: s["name"])
    edges = (
        rows.select("path", "workflow", names.alias("names"), F.explode(F.array_distinct(F.concat(plain, from_lists))).alias("e"))
        .filter(F.array_contains("names", F.col("e.downstream")))
        .select("path", "workflow", "e.upstream", "e.downstream")
    )
    warnings = rows.filter(F.size("steps") == 0).select(
        "path", "workflow", F.format_string(NO_TASK_WARNING, "workflow").alias("message")
    )
    return Imported(workflows, _steps("airflow", rows), edges, warnings)


def extract_workflows(files: DataFrame, source: str, strict: bool = False) -> Imported:
    if source == "temporal":
        return extract_temporal(files, strict)
    if source == "airflow":
        return extract_airflow(files)
    raise ValueError(f"unsupported workflow source: {source}")


def manifest_rows(steps: DataFrame) -> DataFrame:
    """One manifest row per job type; the step seen first gives the description.

    First means by path, workflow and position.  The aggregate keeps one row per type in every map task.
    """
    first = F.min_by(F.struct("source", "name", "queue"), F.struct("path", "workflow", "position"))
    return steps.groupBy("job_type").agg(first.alias("f")).select(
        F.col("job_type").alias("type"),
        F.concat(F.lit("Migrated from "), F.col("f.source"), F.lit(" ("), F.col("f.name"), F.lit(")")).alias("description"),
        F.col("f.queue").alias("queue"),
        *[F.lit(v).alias(k) for k, v in RETRY.items()],
    )


def workflow_kinds(workflows: DataFrame) -> DataFrame:
    """Workflows of at least two steps: type name and whether they are a chain or a group."""
    return workflows.filter(F.col("step_count") >= 2).select(
        "path", "source", function_to_type("workflow").alias("workflow_type"), F.when(F.col("parallel"), "group").otherwise("chain").alias("kind"), "step_count"
    )
