import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import exact, fuse


@given(st.integers(0, 3000), st.integers(0, 2**32))
@settings(max_examples=25, deadline=None)
def test_filter_holds_its_keys(n, seed):
    keys = np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)
    blob = fuse.build(keys)
    assert fuse.contains(blob, keys).all()
    other = np.random.default_rng(seed + 1).integers(0, 2**64, 5000, dtype=np.uint64)
    assert fuse.contains(blob, other).mean() < 0.03


def test_exact(spark, corpus, docs):
    full, empty = corpus
    got = exact.op5_exact_dedup(spark, full).collect()
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    rows = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    want = []
    for d, h in rows:
        same = [x for x, y in rows if y == h]
        want.append((d, min(same), len(same), d == min(same), h))
    assert sorted(map(tuple, got)) == sorted(want)
    assert exact.op5_exact_dedup(spark, empty).count() == 0


def test_a_batch_without_a_snapshot_and_nulls(spark):
    batch = spark.createDataFrame([(None, "a"), (3, "a"), (5, "b"), (None, "c")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.ingest(exact.Snapshot(batch.limit(0)), batch).collect()}
    assert got == {(None, 3, 2, False), (3, 3, 2, True), (5, 5, 1, True), (None, None, 1, True)}


def test_equal_digests_of_different_texts_stay_apart(spark):
    old, new = (spark.createDataFrame(x, "doc_id long, text string") for x in ([(1, "x")], [(2, "y")]))
    same = lambda d: d.selectExpr("doc_id", "repeat('0', 64) AS text_sha256")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact.ingest(exact.Snapshot(old, same(old)), new, same(new)).collect()}
    assert got == {(1, 1, 1), (2, 2, 1)}


def test_what_the_filter_rejects_never_meets_the_snapshot(spark):
    old, new = (spark.createDataFrame(x, "doc_id long, text string") for x in ([(1, "x"), (2, "y")], [(3, "x"), (4, "x"), (5, "z")]))
    snapshot = exact.Snapshot(old)
    result = lambda: {(r.doc_id, r.keep_id, r.group_size) for r in exact.ingest(snapshot, new).collect()}
    assert result() == {(1, 1, 3), (2, 2, 1), (3, 1, 3), (4, 1, 3), (5, 5, 1)}
    nothing = bytearray(fuse.build(np.zeros(0, np.uint64)))
    snapshot.filters = spark.createDataFrame([(0, nothing)], "shard int, filter binary")
    assert result() == {(1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 3, 2), (5, 5, 1)}


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "a", 0), (1, "b", 1), (1, "a", 2), (2, "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha long").withColumnsRenamed({"sha": "first"})
    got = sorted(map(tuple, exact.ingest(exact.Snapshot(docs.where("doc_id = 1")), docs.where("doc_id = 2")).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert got == [(1, 1, 2, True), (1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False)]


def test_a_first_batch_is_spread(spark, monkeypatch):
    """A batch far larger than its snapshot: no group of the screening holds more than a few shards' worth of digests."""
    monkeypatch.setattr(exact, "SHARD_KEYS", 50)
    seen, screen = spark.sparkContext.accumulator(0), exact._screen
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('t', id % 1500) AS text")
    for held in (0, 10):
        base = docs.where(f"doc_id < {held}")
        got = exact.ingest(exact.Snapshot(base), docs.where(f"doc_id >= {held}")).collect()
        want = {i: (i % 1500, 2 if i % 1500 < 500 else 1) for i in range(2000)}
        assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want

    def counted(batch, filters):
        seen.add(1)
        assert batch.num_rows <= 200
        return screen(batch, filters)

    monkeypatch.setattr(exact, "_screen", counted)
    exact.ingest(exact.Snapshot(docs.limit(0)), docs).count()
    assert seen.value >= 20
