import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import syncmers


def brute(text: bytes):
    """Positions of closed syncmers, from the definition."""
    if len(text) < syncmers.K:
        return [0] if text else []
    order = lambda s: (lambda x: x ^ x >> 29)(int.from_bytes(s, "little") * 0x9E3779B97F4A7C15 % 2**64)
    out = []
    for i in range(len(text) - syncmers.K + 1):
        inner = [order(text[i + j : i + j + syncmers.S]) for j in range(syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


@given(st.binary(max_size=300) | st.text("ab ", max_size=300).map(str.encode))
@settings(max_examples=100, deadline=None)
def test_choice(text):
    h, at = syncmers.anchors(text)
    assert at.tolist() == brute(text)
    full = {}
    for x, y in zip(h.tolist(), at.tolist()):
        full.setdefault(x, y)
    got = syncmers.sketch(text)
    assert list(zip(got[0].tolist(), got[1].tolist())) == sorted(full.items())[: syncmers.KEEP]


def test_likeness():
    a = np.arange(100, dtype=np.uint32)[:64]
    assert syncmers.likeness(a, a) == 1 and syncmers.likeness(a, a + 1000) == 0 and syncmers.likeness(a[:0], a[:0]) == 1 and syncmers.likeness(a, a[:0]) == 0
    x, y = "abc def " * 3 + "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog"
    shared = syncmers.match(*(syncmers.text_of(syncmers.sketch(t.encode())) for t in (x, y)))
    assert shared and all(p - q == 24 for p, q in shared)


def _like(a: bytes, b: bytes) -> float:
    """Similarity from the definition: positions of shared k-mers, and those of their neighbours."""
    first = [{}, {}]
    for text, at in zip((a, b), first):
        for i in brute(text):
            at.setdefault(text[i : i + syncmers.K], i)
    both = sorted((first[0][x], first[1][x]) for x in first[0].keys() & first[1].keys())
    shift = [y - x for x, y in both]
    held = sum(d == 0 or d in shift[max(0, i - 1) : i] + shift[i + 1 : i + 2] for i, d in enumerate(shift))
    every = len(first[0].keys() | first[1].keys())
    return held / every if every else 1.0


@given(st.lists(st.sampled_from([b"the quick brown fox jumps ", b"over a lazy dog near the ", b"0123456789" * 3, b"xy"]), max_size=8), st.integers(0, 60), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_similarity(parts, cut, move):
    a = b"".join(parts)
    b = a[cut:] + a[:move]
    assert syncmers.similarity(syncmers.whole(a), syncmers.whole(b)) == _like(a, b)
    assert syncmers.similarity(syncmers.whole(a), syncmers.whole(a)) == 1


def test_op9_in_small_chunks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 100, n))) for n in rng.integers(0, 90, 60)]
    rows = [(None if i == 7 else i // 2 * 3, None if i == 9 else t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, chunk string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(syncmers, "CHUNK_BYTES", 300)
    got = sorted(map(tuple, syncmers.op9_fingerprints(spark, str(tmp_path)).select("doc_id", "n_chars", "near_edited", "near_next").collect()), key=str)
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else syncmers.NONE), r[1] or ""))
    want = []
    for i, (d, t, _) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((d, len(t), _like(t.encode(), edited.encode()), _like(t.encode(), nxt.encode())))
    assert got == sorted(want, key=str)


def test_op9(spark, corpus, docs):
    full, empty = corpus
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (-r.doc_id, r.text or ""))
    got = syncmers.op9_fingerprints(spark, full).collect()
    assert len(got) == len(rows)
    want = []
    for i, r in enumerate(rows):
        t, nxt = r.text or "", rows[(i + 1) % len(rows)].text or ""
        edited = (t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()
        want.append((r.doc_id, len(t), hashlib.sha256(edited).hexdigest(), syncmers.text_of(syncmers.sketch(t.encode())), syncmers.text_of(syncmers.sketch(edited))))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert syncmers.op9_fingerprints(spark, empty).count() == 0
    assert sorted(map(tuple, syncmers.fingerprints(docs).collect())) == sorted((w[0], w[3]) for w in want)


def test_corpus(spark):
    got = syncmers.op9_fingerprints(spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 1000 and got.near_edited.mean() > 0.25 and got.near_next.mean() < 0.15


def test_a_passage_shared_by_long_texts_is_found(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    passage, a, b, c, d = words(50), *(words(8000) for _ in range(4))
    docs = [(1, f"{a} {passage} {b}"), (2, f"{c} {passage} {d}")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in syncmers.op9_fingerprints(spark, str(tmp_path)).collect()}
    for i, t in docs:
        h, at = syncmers.anchors(t.encode())
        assert len(got[i].anchors) == 8 * len(set(h.tolist())) and len(h) > 10_000
    shift = docs[0][1].index(passage) - docs[1][1].index(passage)
    assert sum(p - q == shift for p, q in syncmers.match(got[1].anchors.hex(), got[2].anchors.hex())) >= 20
