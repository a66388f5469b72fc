"""Document fingerprints of closed syncmers.

A k-mer of bytes is a closed syncmer if the least of its inner s-mers (by hash) is its first or its last. Whether it is
depends on the k-mer alone, so an edit elsewhere never changes the choice. The anchors of a text are all its different
syncmers, each with its first position. Two texts are as similar as the anchors that they share in matching positions: at
the same place, or as far apart as the next shared anchor before or after, as in a passage that was moved. A
fingerprint is a digest of bounded size: the ``KEEP`` anchors with the least hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, ranges, table

K, S, KEEP = 24, 8, 64
#: Text of a chunk of neighbours.
CHUNK_BYTES = 16_000_000


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of the closed syncmers; a text shorter than k has one anchor, an empty one none."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if n < K:
        return (np.frombuffer(hashlib.sha256(text).digest()[:4], "<u4"), np.zeros(1, np.int64)) if n else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    # Eight shifted views give the s-mer at each place as one integer.
    wide = np.zeros(n - S + 1, np.uint64)
    for i in range(S):
        wide |= raw[i : n - S + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    order = wide * np.uint64(0x9E3779B97F4A7C15)
    order ^= order >> np.uint64(29)
    w = K - S + 1
    least, size = order, 1
    while size < w:  # the minimum over w places, by doubling
        step = min(size, w - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    at = np.flatnonzero((least == order[: n - K + 1]) | (least == order[w - 1 :]))
    h = mix64(wide[at] * np.uint64(3) + mix64(wide[at + 8] + np.uint64(1)) * np.uint64(5) + mix64(wide[at + 16] + np.uint64(2)))
    return (h >> np.uint64(32)).astype(np.uint32), at


def whole(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All different hashes in order, and the first position of each."""
    h, at = anchors(text)
    h, first = np.unique(h, return_index=True)
    return h, at[first]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Anchors shared in matching positions, as a share of all different anchors; 1 if both are empty.

    Equal texts have 1. An anchor that is shared alone, at another place, is taken for a coincidence.
    """
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    every = len(a[0]) + len(b[0]) - len(both)
    here, there = a[1][i], b[1][j]
    order = np.argsort(here)
    shift = (there - here)[order]
    like = shift[1:] == shift[:-1]
    held = (shift == 0) | np.concatenate([like, [False]]) | np.concatenate([[False], like]) if len(shift) else np.zeros(0, bool)
    return int(held.sum()) / every if every else 1.0


def sketch(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The least ``KEEP`` different hashes in order, and the first position of each."""
    h, at = anchors(text)
    if len(h) > 4 * KEEP:
        # Repeats could fill the first part, so it grows until it holds enough different ones.
        most = 4 * KEEP
        while most < len(h):
            bound = np.partition(h, most)[most]
            if len(np.unique(h[h <= bound])) >= KEEP:
                h, at = h[h <= bound], at[h <= bound]
                break
            most *= 4
    h, first = np.unique(h, return_index=True)
    return h[:KEEP], at[first[:KEEP]]


def bytes_of(found: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Four bytes of hash and four of position for each anchor; ``match`` takes their hex digits."""
    return np.stack([found[0].astype(">u4"), found[1].astype(">u4")], axis=1).astype(">u4").tobytes()


def text_of(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Eight hex digits of hash and eight of position for each anchor."""
    return bytes_of(found).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the sets behind two sketches; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:KEEP]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def match(a: str, b: str) -> list[tuple[int, int]]:
    """Positions in both texts of the anchors that two fingerprints, or two lists of all anchors, share."""
    of = lambda x: {x[i : i + 8]: int(x[i + 8 : i + 16], 16) for i in range(0, len(x), 16)}
    left, right = of(a), of(b)
    return sorted((left[h], right[h]) for h in left.keys() & right.keys())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text; null counts as empty."""
    from .common import binary

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([text_of(sketch(t)) for t in binary(batch, "text")], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


#: Sorts before every other id: documents without one come last in descending order.
NONE = -(1 << 63)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (chunk, extra, key, doc_id, text): documents in chunks of neighbours, each chunk in descending doc_id and followed
    by the first of the next one (extra), all chunks of a partition one after the other.

    Chunks are ranges of doc_id with about CHUNK_BYTES of text. Only the first document of each is sent twice, so texts are
    shuffled once. Rows that share a doc_id come in the order of their texts; rows without one come last.
    """
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(NONE).cast("long"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = ranges(docs, key, total, CHUNK_BYTES)

    @F.pandas_udf("int")
    def chunk(keys):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="left"))

    # One row for each chunk, of which there are not more than ``ranges`` allows.
    tops = sorted((r[0], r[1]) for r in docs.select(key.alias("key")).select(chunk("key").alias("chunk"), "key").groupBy("chunk").agg(F.max("key")).collect())
    # The first of each chunk also goes to the chunk above it; the first of all to the lowest chunk.
    heads = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    above = F.broadcast(spark.createDataFrame(heads, "key long, above int"))
    rows = docs.select(key.alias("key"), "doc_id", "text").withColumn("chunk", chunk("key")).join(above, "key", "left")
    own = F.struct(F.col("chunk").alias("chunk"), F.lit(False).alias("extra"))
    extra = F.struct(F.col("above").alias("chunk"), F.lit(True).alias("extra"))
    dealt = rows.select("key", "doc_id", "text", F.inline(F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, extra))))
    return dealt.select("chunk", "extra", "key", "doc_id", "text").repartition("chunk").sortWithinPartitions("chunk", "extra", F.desc("key"), "text")


def _compare(batches):
    """Each document that isn't extra with the one that follows it; one document is held at a time."""
    import pyarrow as pa

    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string()}
    kinds |= {"near_edited": pa.float64(), "near_next": pa.float64(), "anchors": pa.binary(), "edited_anchors": pa.binary()}
    least = lambda x: text_of((x[0][:KEEP], x[1][:KEEP]))
    held = None  # chunk, doc_id, text and anchors of the document that waits for the next one
    for batch in batches:
        rows = []
        for chunk, extra, doc_id, text in zip(*(batch.column(x).to_pylist() for x in ("chunk", "extra", "doc_id", "text"))):
            if extra and held is None:
                continue  # only the first extra document of a chunk counts
            text = text or ""
            found = whole(text.encode())
            if held is not None:
                if held[0] != chunk:
                    raise RuntimeError("a chunk lacks the document that follows it")
                _, own_id, own, anchors_ = held
                n = len(own)
                edited = (own[: n - n // 2] + text[: n // 2]).encode()
                other = whole(edited)
                rows.append((own_id, n, hashlib.sha256(edited).hexdigest(), least(anchors_), least(other), similarity(anchors_, other), similarity(anchors_, found), bytes_of(anchors_), bytes_of(other)))
            held = None if extra else (chunk, doc_id, text, found)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))
    if held is not None:
        raise RuntimeError("a chunk lacks the document that follows it")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors and fingerprints of all documents and of their texts with the last half replaced by the start of the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, anchors binary, edited_anchors binary"
    return with_next(table(spark, sf_dir, "documents", "doc_id", "text")).mapInArrow(_compare, schema)
