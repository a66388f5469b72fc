"""What the training-data operators share: reading, lineage cuts and small array helpers."""

from __future__ import annotations

import math
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word-based operator here: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the corpus, read by Spark alone, with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the folder in ``spark.checkpoint.dir``, which all executors share, and read back.

    Where that setting is missing, a temporary folder is used in local mode, and an error is raised on a cluster.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagemill-"))
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Most ranges that a table is cut into: their bounds (at most 2 MB) reach the driver and every task.
RANGES = 1 << 18


def ranges(docs: DataFrame, key: Column, total: int, size: int) -> np.ndarray:
    """Bounds that cut ``docs`` by key into ranges of about ``size`` bytes of text (``total`` bytes in all), three for each partition at least.

    A text counts by its length, so that long neighbours don't meet in one range. Beyond ``RANGES`` ranges, these grow.
    """
    n = min(RANGES, max(3 * parts(docs.sparkSession), math.ceil(total / size)))
    unit = max(1, total // (16 * n))
    weighed = docs.select(key.alias("key"), F.explode(F.array_repeat(F.lit(0), (1 + F.coalesce(F.octet_length("text"), F.lit(0)) / unit).cast("int"))))
    at = weighed.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0]
    return np.array(sorted(set(at or [])), np.int64)


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def binary(batch, name: str) -> list[bytes]:
    """A string column of an Arrow batch as bytes, null as empty."""
    import pyarrow as pa

    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
