"""Session settings the jobs are written for. On a cluster, set the same keys in the submit command."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # vectors are wide: smaller Arrow batches keep a task's score block small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    # call-site capture costs a driver round trip per column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(app: str = "vecwatch", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
