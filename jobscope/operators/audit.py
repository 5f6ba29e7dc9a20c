"""Audit scores and check roll-ups per server."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.functions import grade

# Points per check outcome; the greatest score per check.
POINTS = {"pass": 5, "warning": 3, "info": 4, "skip": 4, "critical": 0}
MAX_POINTS = 5


def audit_categories(checks: DataFrame) -> DataFrame:
    """Outcome counts per server and category."""
    severity = F.col("severity")
    return checks.groupBy("server", "category").agg(
        F.count_if(severity == "pass").alias("passed"),
        F.count_if(severity == "warning").alias("warnings"),
        F.count_if(severity == "critical").alias("critical"),
        F.count("*").alias("total"),
    )


def audit_report(checks: DataFrame) -> DataFrame:
    """Score, greatest possible score and grade per server."""
    points = F.lit(0)
    for severity, value in POINTS.items():
        points = F.when(F.col("severity") == severity, value).otherwise(points)
    scored = checks.groupBy("server").agg(F.sum(points).alias("score"), (F.count("*") * MAX_POINTS).alias("max_score"))
    return scored.withColumn("grade", grade(F.col("score"), F.col("max_score")))


def doctor_rollup(checks: DataFrame) -> DataFrame:
    """Passed, warned and failed checks per server and the verdict for production use.

    Checks that were skipped or only inform count in none of the three.
    """
    severity = F.col("severity")
    counts = checks.groupBy("server").agg(
        F.count_if(severity == "pass").alias("passed"),
        F.count_if(severity == "warning").alias("warned"),
        F.count_if(severity == "critical").alias("failed"),
    )
    verdict = F.when(F.col("failed") > 0, "FAIL").when(F.col("warned") > 0, "WARN").otherwise("PASS")
    return counts.withColumn("verdict", verdict)
