import hashlib
import random
import zlib

import pytest

from pagemill.llm import merkle, ranks

H = lambda t: hashlib.sha256(t.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, at):
    """The siblings before and after on each level."""
    for nodes in tree[:-1]:
        first = at // 3 * 3
        yield nodes[first:at], nodes[at + 1 : first + 3]
        at //= 3


def brute(rows):
    """Tuples of doc_id and so on, from (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in sources[s]])
    top = levels([trees[s][-1][0] for s in names])
    for no, s in enumerate(names):
        for at, r in enumerate(sources[s]):
            path = [*way(trees[s], at), *way(top, no)]
            false = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            digest = leaf((*r[:4], r[4].replace("\n", ""))) if false else leaf(r)
            for before, after in path:
                digest = H("".join([*before, digest, *after]))
            yield (r[0], leaf(r), trees[s][-1][0], top[-1][0], H("".join("".join(b + a) for b, a in path)), digest, digest == top[-1][0])


def rows(n, seed=1):
    rng = random.Random(seed)
    out = [(i, rng.choice(["hot"] * 4 + ["b", "ü", None, "", f"own{i}"]), rng.choice(["en", None]), rng.choice([0, 7, None]), rng.choice(["a\nb", "", None, "x", "\n", "テ\n" * 9])) for i in range(n)]
    return out + out[:3] + [(None, "b", None, None, None), (None, "b", None, None, "q\n"), (5, "b", None, None, "x" * 100_000 + "\n"), (5, "hot", "en", 1, "tie")]


DDL = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n,sent", [(0, 1 << 20), (40, 0), (700, 0), (2500, 1 << 20)])
def test_op11(spark, tmp_path, monkeypatch, n, sent):
    monkeypatch.setattr(merkle, "SENT", sent)
    made = rows(n)
    spark.createDataFrame([(*r, 1, "x") for r in made], DDL + ", pos int, segment string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(brute(made), key=str)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("made", [[], [(1, None, None, None, None)], [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "x\n")], [(i, "a", "en", 1, "t\n") for i in range(4)]])
def test_few(spark, made):
    docs = spark.createDataFrame(made, DDL)
    proofs, root = merkle.manifest(docs)
    got = sorted(map(tuple, merkle.verify(proofs, root).collect()), key=str)
    want = [(*r[:5], r[3], True) for r in brute(made)]
    assert got == sorted(want, key=str)


def test_any_change_is_seen(spark):
    from pyspark.sql import functions as F

    made = rows(60)
    proofs, root = merkle.manifest(spark.createDataFrame(made, DDL), F.when(F.col("doc_id") == 7, F.unhex(F.sha2(F.lit("other"), 256))))
    assert {r.doc_id for r in merkle.verify(proofs, root).where("NOT verified").collect()} == {7}


def test_numbered(spark):
    rng = random.Random(2)
    keys = [rng.choice(["a"] * 30 + ["b", "c", None, "d"]) for _ in range(3000)]
    df = spark.createDataFrame([(k, rng.randrange(50)) for k in keys], "k string, v int")
    placed = ranks.numbered(df, ["k"], ["v"])
    got = [tuple(r) for r in placed.rows.collect()]
    assert placed.largest == keys.count("a")
    begun = 0
    for k in sorted(set(keys), key=lambda k: (k is not None, k or "")):
        own = sorted((r for r in got if r[0] == k), key=lambda r: r[3])
        assert [r[3] for r in own] == list(range(keys.count(k))) and {r[2] for r in own} == {begun}
        assert [r[1] for r in own] == sorted(r[1] for r in own) and [r[4] for r in own] == [False] * (len(own) - 1) + [True]
        begun += len(own)
    with pytest.raises(ValueError):
        ranks.numbered(df.withColumn("last", df.v), ["k"], ["v"])
