"""What earlier runs have made, kept in a bucketed table, so that planning a run doesn't shuffle the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Buckets by output; a history that grows past a few GB a bucket is rewritten with more.
BUCKETS = 64


def save(done: DataFrame, table: str, mode: str = "append", buckets: int = BUCKETS) -> None:
    """Adds outputs to the history (a table of the catalog): output, and path where ``done`` has it. Null outputs are left out."""
    path = F.col("path") if "path" in done.columns else F.lit(None).cast("string")
    rows = done.where("output IS NOT NULL").select("output", path.alias("path")).repartition(buckets, "output")
    rows.write.mode(mode).format("parquet").bucketBy(buckets, "output").sortBy("output").saveAsTable(table)


def _in_step(files: DataFrame, table: str, out: str) -> tuple[DataFrame, DataFrame]:
    """New tasks, dealt as the history is, and the history."""
    spark: SparkSession = files.sparkSession
    known = spark.table(table)
    described = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    tasks = files.select("path", T.output_path(F.col("path"), out=out).alias("output"))
    return tasks.repartition(int(described.data_type), "output"), known


def plan(files: DataFrame, table: str, out: str = "md") -> DataFrame:
    """path and output of files whose output isn't in the history. Only the new files are shuffled."""
    tasks, known = _in_step(files, table, out)
    return tasks.join(known.select("output").hint("merge"), "output", "left_anti").select("path", "output")


def collisions(files: DataFrame, table: str, out: str = "md") -> DataFrame:
    """output, first_path, path: files whose output another path of the history, or an earlier one of these, has taken.

    Of these files, those come first whose lower-cased path does.
    """
    tasks, known = _in_step(files, table, out)
    order = Window.partitionBy("output").orderBy(F.lower("path"), "path")
    earlier = known.where("path IS NOT NULL").groupBy("output").agg(F.min("path").alias("taken"))
    named = tasks.join(earlier.hint("merge"), "output", "left").withColumn("first_path", F.coalesce("taken", F.first("path").over(order)))
    return named.where("first_path <> path").select("output", "first_path", "path")
