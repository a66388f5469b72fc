"""Exact deduplication of a new batch against an immutable snapshot.

The snapshot's digests are dealt over shards by their leading bits; each shard has a static binary-fuse filter, made once
and stored. A batch is first grouped by digest on its own; one representative of each group is screened by the filter of
its shard. What the filter rejects is new and never meets the snapshot. Positives join the exact buckets of the snapshot,
where the normalised texts are compared byte by byte; only groups found equal there become one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse
from .common import normalised, settle, table

#: Digests of a shard, on average; digests are even, so this bounds a filter to about 0.1 MB.
SHARD_KEYS = 50_000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and text_sha256 of the normalised text (null: empty)."""
    return docs.select("doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))


def _key(shas) -> np.ndarray:
    return np.array([int(x[8:24], 16) for x in shas.to_pylist()], np.uint64)


def _build(group):
    import pyarrow as pa

    return pa.table({"shard": group.column("shard").slice(0, 1), "filter": pa.array([fuse.build(_key(group.column("sha")))], pa.binary())})


def _screen(batch, filters):
    import pyarrow as pa

    blobs = filters.column("filter").to_pylist()
    hit = fuse.contains(blobs[0], _key(batch.column("sha"))) if blobs and batch.num_rows else np.zeros(batch.num_rows, bool)
    return batch.select(["sha", "first", "n"]).append_column("maybe", pa.array(hit))


def _shard(shards: int):
    return (F.conv(F.substring("sha", 1, 8), 16, 10).cast("long") % shards).cast("int").alias("shard")


class Snapshot:
    """An immutable set of documents: its digests (a row for each different one) and the filters of its shards, as tables."""

    def __init__(self, docs: DataFrame, doc_digests: DataFrame | None = None):
        self.docs = docs
        self.digests = digests(docs) if doc_digests is None else doc_digests
        self.known = settle(_grouped(self.digests))
        self.shards = max(1, -(-self.known.count() // SHARD_KEYS))
        self.filters = settle(self.known.select(_shard(self.shards), "sha").groupBy("shard").applyInArrow(_build, "shard int, filter binary"))


def _grouped(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("text_sha256").alias("sha")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))


def ingest(snapshot: Snapshot, batch_docs: DataFrame, batch_digests: DataFrame | None = None) -> DataFrame:
    """One row per row of the snapshot and of the batch: doc_id, keep_id, group_size, kept, text_sha256.

    The snapshot must hold the smaller doc_ids. Of equal texts the row with the smallest doc_id stays; rows that repeat a
    doc_id and its text are one document and share its flag. Rows without doc_id come after all others: they stay only if
    no row of the group has one, and then keep_id is null. Either side may be empty. Other columns are ignored.
    """
    new = digests(batch_docs) if batch_digests is None else batch_digests
    fresh = settle(_grouped(new))
    # A batch may be far larger than the snapshot: its digests are dealt over copies of each filter, so that no group grows with it.
    copies = max(1, -(-fresh.count() // (snapshot.shards * SHARD_KEYS)))
    copy = (F.conv(F.substring("sha", 25, 8), 16, 10).cast("long") % copies).cast("int").alias("copy")
    filters = snapshot.filters.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    dealt = fresh.select(_shard(snapshot.shards), copy, "sha", "first", "n")
    screened = settle(dealt.groupBy("shard", "copy").cogroup(filters.groupBy("shard", "copy")).applyInArrow(_screen, "sha string, first long, n long, maybe boolean"))
    bucket = screened.where("maybe").join(snapshot.known.select("sha", F.col("first").alias("old_first"), F.col("n").alias("old_n")), "sha")
    # Rows without doc_id can't be found again: their digests decide. An id may have several texts; one equal pair is enough.
    text = lambda docs, key, name: docs.select(F.col("doc_id").alias(key), normalised(F.col("text")).alias(name)).distinct()
    wanted = lambda docs, key: docs.join(bucket.select(F.col(key).alias("doc_id")).distinct(), "doc_id", "left_semi")
    checked = bucket.join(text(wanted(batch_docs, "first"), "first", "new_text"), "first", "left").join(text(wanted(snapshot.docs, "old_first"), "old_first", "old_text"), "old_first", "left")
    same = F.max(F.coalesce(F.col("new_text") == F.col("old_text"), F.lit(True)))
    met = settle(checked.groupBy("sha", "first", "n", "old_first", "old_n").agg(same.alias("same")).where("same"))
    both = (F.coalesce(F.least("first", "old_first"), "first", "old_first").alias("keep_id"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"))
    joined = screened.select("sha", "first", "n").join(met.select("sha", "old_first", "old_n"), "sha", "left").select("sha", F.lit(1).alias("side"), *both)
    own = snapshot.known.select("sha", F.col("first").alias("old_first"), F.col("n").alias("old_n")).join(met.select("sha", "first", F.col("n").alias("new_n")), "sha", "left")
    own = own.withColumn("n", F.coalesce("new_n", F.lit(0))).select("sha", F.lit(0).alias("side"), *both)
    decided = own.unionByName(joined).select(F.col("sha").alias("text_sha256"), "side", "keep_id", "group_size")
    rows = snapshot.digests.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    return rows.join(decided, ["text_sha256", "side"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches: the lower half of the doc_ids is the snapshot, the upper half comes in."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    all_digests = settle(digests(docs))
    middle = all_digests.agg(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    low = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    return ingest(Snapshot(docs.where(low), all_digests.where(low)), docs.where(~low), all_digests.where(~low))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
