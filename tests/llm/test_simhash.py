import random
import re

import pytest
import xxhash

from pagemill.llm import graph, simhash


def brute_print(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, distance=4):
    """rows: (doc_id, fingerprint); the least doc_id that each reaches."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, f, least[find(i)]) for i, (d, f) in enumerate(rows))


def test_op6(spark, corpus, docs):
    full, empty = corpus
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op6_simhash(spark, full).collect())
    assert got == brute_components([(r.doc_id, brute_print(r.text)) for r in docs.collect()])
    assert simhash.op6_simhash(spark, empty).count() == 0


def _cloud(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        f = rng.getrandbits(64) if i % 5 == 0 else rows[rng.randrange(len(rows))][1]
        for _ in range(rng.randrange(8)):
            f ^= 1 << rng.randrange(64)
        rows.append((i, f))
    return rows


def test_links_are_whole(spark, monkeypatch):
    rows = _cloud(1500, 7)
    df = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id long, fp long")
    for hot in (8192, 6, 2):  # the lower, the more keys go to the finer cuts
        monkeypatch.setattr(simhash, "HOT", hot)
        got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.link(df).collect())
        assert got == brute_components(rows)


@pytest.mark.parametrize("most", [1 << 22, 50])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MOST", most)  # few edges at a time: by steps
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(500, x) for x in range(501, 700)] + [(x, x + 1) for x in range(800, 860)] + [(1, 1)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {}
    for u, v in edges:
        if u != v:
            a, b = want.setdefault(u, {u}), want.setdefault(v, {v})
            a |= b
            for x in b:
                want[x] = a
            want[v] = a
    assert got == {u: min(s) for u, s in want.items()}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_groups(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [[word() for _ in range(300)] for _ in range(40)]
    near = [[*t[:100], word(), *t[101:200], word(), *t[201:]] for t in texts[:20]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + near)]
    got = dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {i: i if i < 40 else i - 40 for i in range(60)}


def _brute_groups(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 9 >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {d: rows[r][0] for (d, _), r in zip(rows, root)}


def _around_the_threshold(seed, pairs, sizes=(5, 9, 20, 60, 300)):
    """Texts, each with one that shares 0.76 to 0.86 of the shingles, cut at the end."""
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for _ in range(pairs):
        n, j = rng.choice(sizes), rng.uniform(0.76, 0.86)
        text, m = [word() for _ in range(n + 4)], max(1, round(n * (1 - j) / (1 + j)))
        rows += [" ".join(text), " ".join([*text[:-m], *(word() for _ in range(m))])]
    return list(enumerate(rows))


def test_near_groups_are_whole_at_the_threshold(spark):
    rows = _around_the_threshold(11, 150)
    want = _brute_groups(rows)
    assert 30 < sum(d != c for d, c in want.items()) < 120
    assert dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_near_groups_with_crowded_keys(spark, monkeypatch):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(104)], []
    for i in range(60):  # a chain of copies, each changed at another place, and some that only look alike
        text = list(base)
        for at in rng.sample(range(104), rng.choice((1, 2, 3, 4))):
            text[at] = word()
        rows.append((i, " ".join(text)))
    rows += [(60 + i, t) for i, t in _around_the_threshold(18, 30, (20,))]
    want = _brute_groups(rows)
    for crowd, docs, shown in ((7, 2048, 16), (3, 5, 2), (3, 9, 0)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "TILE_DOCS", docs)
        monkeypatch.setattr(simhash, "REPRESENTATIVES", shown)
        assert dict(simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_tiles_of_one_component_are_dealt_apart(spark):
    tiled = spark.range(64).selectExpr("id div 64 AS root", "id AS node", "id % 8 AS tile", "'a b c d e ' || id AS text", "false AS odd", "id AS label")
    joined = tiled.join(tiled.select("root").distinct().hint("merge"), "root")
    plan = lambda edges: edges._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(root#\d+L, tile#\d+L", plan(joined.groupBy("root", "tile").applyInArrow(simhash._verify, "u long, v long")))
    assert re.search(r"hashpartitioning\(root#\d+L, tile#\d+L", plan(simhash._verified(joined, "root", "tile")))


def test_near_groups_with_odd_rows(spark, docs):
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7), (8, 7), (9, 9)} <= got
    assert simhash.near_groups(docs).count() == docs.count() and simhash.near_groups(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a b"), (3, "a b"), (None, "c d")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_groups(none).collect()), key=str) == [(3, 3), (None, 3), (None, None)]
