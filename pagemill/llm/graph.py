"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


#: Edges that a task holds at a time.
MOST = 1 << 22


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _contract(batches):
    """Stars around the least node of each component of the edges that a partition holds, ``MOST`` edges at a time."""
    import pyarrow as pa

    def stars(us, vs):
        node, which = np.unique(np.concatenate([*us, *vs]), return_inverse=True)
        u, v = np.split(which, 2)
        root = np.arange(len(node))
        while True:
            lower = root.copy()
            np.minimum.at(lower, root[u], root[v])
            np.minimum.at(lower, root[v], root[u])
            while (up := lower[lower]).tobytes() != lower.tobytes():
                lower = up
            if lower.tobytes() == root.tobytes():
                break
            root = lower
        own = np.flatnonzero(root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["u", "v"])

    us, vs, n = [], [], 0
    for batch in batches:
        us.append(batch.column("u").to_numpy(zero_copy_only=False))
        vs.append(batch.column("v").to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n >= MOST:
            yield stars(us, vs)
            us, vs, n = [], [], 0
    if n:
        yield stars(us, vs)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it reaches) for every node of ``edges`` (two long columns u, v).

    Each step first contracts what lies in one partition. Work per step is linear in the edges; hubs are aggregated before
    the shuffle, and skewed joins are split by AQE. As soon as fewer than ``MOST`` edges are left, which a task holds
    anyway, they are contracted together and nothing is left to do. Self-links and repeated edges are ignored. No edges:
    no rows.
    """
    step = lambda x: settle(x.mapInArrow(_contract, "u long, v long"))
    now = step(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while (mark := _signature(now)) != before and mark[0]:
        if mark[0] < MOST:
            now = step(now.coalesce(1))
            break
        before = mark
        now = step(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
