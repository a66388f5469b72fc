"""Batches of conversion tasks: what became of each task, and the report of those that failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(tasks: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Adds status to tasks (batch, position, code): done, failed, or skipped after the first failure of its batch.

    A code other than zero (or null) is a failure. The first one is found by an aggregation, so no batch is sorted.
    """
    failed = F.coalesce(F.col("code"), F.lit(1)) != 0
    status = F.when(failed, "failed").otherwise("done")
    if not fail_fast:
        return tasks.withColumn("status", status)
    first = tasks.where(failed).groupBy("batch").agg(F.min("position").alias("__first"))
    return tasks.join(first, "batch", "left").withColumn("status", F.when(F.col("position") > F.col("__first"), "skipped").otherwise(status)).drop("__first")


def failure_report(judged: DataFrame) -> DataFrame:
    """batch, position and code of the tasks that failed; a batch without any is a success."""
    return judged.where("status = 'failed'").select("batch", "position", F.coalesce("code", F.lit(1)).alias("code"))


def summary(judged: DataFrame) -> DataFrame:
    """For each batch: how many tasks were done, failed and skipped, and exit_code, which is 1 if any failed."""
    count = lambda x: F.count_if(F.col("status") == x).alias(x)
    counted = judged.groupBy("batch").agg(count("done"), count("failed"), count("skipped"))
    return counted.withColumn("exit_code", F.when(F.col("failed") > 0, 1).otherwise(0))
