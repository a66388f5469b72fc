"""Documents kept up to date while pages arrive late, twice, or in any order.

Pages are stored by bucket of their document, one folder for each batch; so are the documents a batch touches, and only
those are written again. A batch that runs twice replaces its own folders. ``current`` takes each document's last state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.documents import assemble
from ..sources.files import file_system

#: Buckets of documents. A batch reads the stored pages of the buckets it touches.
BUCKETS = 64
PAGES = "bucket int, doc_id long, page_index int, markdown string, delivered timestamp, batch long"
DOCUMENTS = "bucket int, doc_id long, markdown string, batch long"


def bucket_of(doc: Column) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(BUCKETS)).cast("int").alias("bucket")


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    from pyarrow import fs

    system, base = file_system(folder)
    if system.get_file_info(base).type != fs.FileType.Directory:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)


def _rewrite(pages: DataFrame, batch: int, folder: str) -> None:
    """One batch: its pages are stored, and the documents they belong to assembled from all their pages."""
    spark = pages.sparkSession
    new = pages.select(bucket_of(F.col("doc_id")), "doc_id", "page_index", "markdown", "delivered")
    new.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/pages/batch={batch}")
    mine = _stored(spark, f"{folder}/pages", PAGES).where(F.col("batch") == batch).select("bucket", "doc_id").distinct()
    # Later batches than this one, from a run that failed, don't count yet.
    known = _stored(spark, f"{folder}/pages", PAGES).where(F.col("batch") <= batch)
    touched = known.join(mine, ["bucket", "doc_id"], "left_semi")
    # A page that came again after the watermark had passed: its last delivery holds.
    last = touched.groupBy("doc_id", "page_index").agg(F.max_by("markdown", F.struct("delivered", "batch")).alias("markdown"))
    made = assemble(last).select(bucket_of(F.col("doc_id")), "doc_id", "markdown")
    made.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/documents/batch={batch}")


def keep_up(pages: DataFrame, folder: str, delay: str = "1 hour") -> StreamingQuery:
    """A query that takes in all that has arrived of a stream of pages (doc_id, page_index, markdown, delivered).

    A page that comes twice within ``delay`` of its delivery is dropped by the stream's state, which then forgets it; one
    that comes again later replaces the earlier one. Pages without a document are dropped.
    """
    stream = pages.where("doc_id IS NOT NULL").withWatermark("delivered", delay).dropDuplicatesWithinWatermark(["doc_id", "page_index"])
    writer = stream.writeStream.foreachBatch(lambda df, batch: _rewrite(df, batch, folder)).option("checkpointLocation", f"{folder}/state")
    return writer.trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and markdown of every document, as its last batch left it."""
    return _stored(spark, f"{folder}/documents", DOCUMENTS).groupBy("doc_id").agg(F.max_by("markdown", "batch").alias("markdown"))
