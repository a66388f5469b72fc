"""Incremental conversion: files that arrive are planned once; the checkpoint remembers which were."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, suffix: str = "pdf") -> DataFrame:
    """A stream of path, output and length; contents aren't kept."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).load(folder)
    return files.select("path", T.output_path(F.col("path")).alias("output"), "length")


def arriving_responses(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of page responses written as Parquet."""
    return spark.readStream.schema(schema).parquet(folder)


def append_to(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, once, appended to a Parquet table."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
