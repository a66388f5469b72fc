"""Queries about batches of tasks: users are batches, their events are tasks in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batch as B

CODE = "CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN event_id % 3 ELSE 0 END"


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select(F.col("user_id").alias("batch"), F.col("event_id").alias("position"), F.expr(CODE).cast("long").alias("code"))


def batch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return B.outcomes(_tasks(spark, sf), fail_fast=True).select("batch", "position", "status")


TASKS = f"t AS (SELECT user_id AS batch, event_id AS position, CAST({CODE} AS BIGINT) AS code FROM events)"
JUDGED = f"""{TASKS}, j AS (SELECT *, CASE WHEN position > min(CASE WHEN code <> 0 THEN position END) OVER (PARTITION BY batch) THEN 'skipped' WHEN code <> 0 THEN 'failed' ELSE 'done' END AS status FROM t)"""
OUTCOMES = f"WITH {JUDGED} SELECT batch, position, status FROM j"


def failure_report(spark: SparkSession, sf: str) -> DataFrame:
    return B.failure_report(B.outcomes(_tasks(spark, sf)))


FAILURES = f"WITH {TASKS} SELECT batch, position, code FROM t WHERE code <> 0"


def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return B.summary(B.outcomes(_tasks(spark, sf), fail_fast=True))


SUMMARY = f"WITH {JUDGED} SELECT batch, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, CAST(CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM j GROUP BY batch"

PATH = "'in/d' || (doc_id % 7) || '/a.b' || doc_id || '.pdf'"


def output_names(spark: SparkSession, sf: str) -> DataFrame:
    path, n = F.expr(PATH), F.col("doc_id") % 90 + 1
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", T.default_path(path, n, n + 9).alias("markdown"), T.image_name(n, F.lit(2)).alias("image"), T.png_name(path, n - 1).alias("png"))


NAMES = "SELECT doc_id, 'md/a.b' || doc_id || '.p' || (doc_id % 90 + 1) || '-' || (doc_id % 90 + 10) || '.md' AS markdown, 'page-' || (doc_id % 90 + 1) || '-image-2.png' AS image, 'a.b' || doc_id || '-' || (doc_id % 90) || '.png' AS png FROM documents"


def http_errors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.http_error(F.col("doc_id") % 100 + 500, F.col("text")).alias("error"))


ERRORS = "SELECT doc_id, 'HTTP ' || (doc_id % 100 + 500) || ': ' || left(coalesce(text, ''), 500) AS error FROM documents"

QUERIES = {
    "batch_outcomes": (batch_outcomes, OUTCOMES),
    "failure_report": (failure_report, FAILURES),
    "batch_summary": (batch_summary, SUMMARY),
    "output_names": (output_names, NAMES),
    "http_errors": (http_errors, ERRORS),
}
