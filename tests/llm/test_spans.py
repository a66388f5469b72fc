import hashlib
import random
import re

import numpy as np
import pytest

from pagemill.llm import automaton, rindex, spans


def brute(rows, split, join, w):
    """rows: (doc_id, text); what stays without windows that came before."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0], (r[1] or "").encode())):
        x = split((t or "").encode())
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            win = tuple(x[i : i + w])
            if win in seen:
                gone[i : i + w] = [True] * w
            seen.add(win)
        n_spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), sum(gone), n_spans, join([c for c, g in zip(x, gone) if not g])))
    return sorted(out)


WORDS = (automaton.dedup_passages, lambda b: re.findall(rb"[^\x20\x09-\x0D]+", b), b" ".join, 20)
BYTES = (rindex.dedup_bytes, list, bytes, 100)


def _texts(seed, n=60):
    """Texts that share pieces of all lengths, repeat themselves, and are copies or nearly so."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "aa", "ab", "the", "of", "é", "naïve", "テスト", "xyz", "q"])
    pieces = [" ".join(word() for _ in range(rng.randrange(1, 120))) for _ in range(15)] + ["a " * 150, "b" * 400, "ab" * 130]
    out = []
    for _ in range(n):
        t = rng.choice([" ", "\n", "  "]).join(rng.choice(pieces) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6)))
        if out and rng.random() < 0.3:
            t = rng.choice(out)
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", "x", " new "]) + t[at + rng.randrange(2) :]
        out.append(t)
    return out


@pytest.mark.parametrize("op", [WORDS, BYTES], ids=["words", "bytes"])
@pytest.mark.parametrize("seed", [0, 1])
def test_like_brute_force(spark, op, seed, monkeypatch):
    run, split, join, w = op
    monkeypatch.setattr(spans, "CHUNK_BYTES", 5000 if seed else 4_000_000)
    rows = [(i * 3 - 20, t) for i, t in enumerate(_texts(seed, 40))] + [(500, None), (501, ""), (7, "twice " * 30), (7, "twice " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, r.n, r.n_removed, r.n_spans, bytes(r.kept)) for r in run(df).collect())
    assert got == brute(rows, split, join, w)


@pytest.mark.parametrize("op", [(spans.Words, automaton.Automaton, WORDS), (spans.Bytes, rindex.RunIndex, BYTES)], ids=["words", "bytes"])
def test_within_one_chunk(op, monkeypatch):
    kind, matcher, (_, split, join, w) = op
    for block in (1 << 20, 2000):  # small blocks cut long texts
        monkeypatch.setattr(spans, "BLOCK", block)
        for seed in range(2, 4):
            rows = list(enumerate(_texts(seed, 20)))
            unit, masks = spans.removed(kind, matcher, [t.encode() for _, t in rows], [])
            got = [(i, len(m), int(m.sum()), unit.kept(i, ~m)) for i, m in enumerate(masks)]
            assert got == [(a, b, c, e) for a, b, c, _, e in brute(rows, split, join, w)]


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([rng.integers(0, 3 + seed * 80, 300), np.full(50, 1), np.tile([1, 2], 30), [0]]).astype(np.uint16)
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert rindex.suffix_array(text).tolist() == want


def test_matching_statistics():
    rng = random.Random(1)
    passages = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(100, 300))) for _ in range(6)]
    index = rindex.RunIndex(spans.Bytes(passages))
    text = b"".join(p[: rng.randrange(len(p))] for p in passages) + bytes(rng.choice(b"abc") for _ in range(300))
    sizes = np.array([400, 250, len(text) - 650])
    sizes[::-1].sort()
    base = np.cumsum(sizes) - sizes
    got = np.full(len(text), -1)
    for at, length in index.statistics(np.frombuffer(text, np.uint8).astype(np.uint16) + 1, base, sizes):
        got[at] = length
    for b, n in zip(base.tolist(), sizes.tolist()):
        for i in range(b, b + n):
            assert got[i] == next(m for m in range(min(100, b + n - i), -1, -1) if any(text[i : i + m] in p for p in passages))


@pytest.mark.parametrize("op", [WORDS, BYTES], ids=["words", "bytes"])
def test_clashing_hashes_lose_nothing(spark, op, monkeypatch):
    """Anchors that share a hash, and buckets that are dealt out twice."""
    run, split, join, w = op
    rows = list(enumerate(_texts(5, 40)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(spans, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(spans, "FAN", 2)
    got = sorted((r.doc_id, r.n, r.n_removed, r.n_spans, bytes(r.kept)) for r in run(df, route=4).collect())
    assert got == brute(rows, split, join, w)


def test_automaton():
    passages = spans.Words([b"a b c a b d", b"b c a b", b"x y"])
    passages.window = 3
    index = automaton.Automaton(passages)
    unit = spans.Words([b"b c a b d x y a b c"])
    index.add(0, 0, 7)
    assert list(index.matches(unit)) == [(0, 0, 2), (0, 7, 7)]


@pytest.mark.parametrize("name", ["op2", "op3"])
def test_queries(spark, corpus, docs, name):
    full, empty = corpus
    query, (_, split, join, w) = (automaton.op2_substring_dedup, WORDS) if name == "op2" else (rindex.op3_suffix_array_dedup, BYTES)
    want = [(d, n, g, s, hashlib.sha256(k).hexdigest()) for d, n, g, s, k in brute([(r.doc_id, r.text) for r in docs.collect()], split, join, w)]
    if name == "op2":
        want = [(d, n, g, h) for d, n, g, _, h in want]
    assert sorted(map(tuple, query(spark, full).collect())) == sorted(want)
    assert query(spark, empty).count() == 0


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n]


def test_words_that_clash_under_any_polynomial(spark, tmp_path):
    """The Thue-Morse word of 1,024 letters and its complement have equal polynomials modulo 2**64, whatever the base."""
    from pagemill.llm import automaton, simhash

    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(19))
    docs = [(1, f"{word} {tail}"), (2, f"{other} {tail}"), (3, f"{word} {tail}")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in automaton.op2_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    short = "a" * 40 + "b"
    for a, b in ((word, other), (thue_morse(64), thue_morse(64).translate(str.maketrans("ab", "ba"))), (short, short[::-1]), ("ab", "ba"), ("a", "a\0"), ("x" * 64, "x" * 65)):
        one, two = simhash.shingle_sets([a.encode(), b.encode()])
        assert set(one.tolist()) != set(two.tolist())
