import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from pagemill.llm import lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, threshold, least):
    """rows: (place, text); what stays of each text."""
    every = sorted((place, no, x) for place, t in rows if t is not None for no, x in enumerate(t.split("\n")) if len(x) >= least)
    out = []
    for place, t in rows:
        left = None if t is None else [x for no, x in enumerate(t.split("\n")) if len(x) < least or not any((p, n) < (place, no) and abs(len(x) - len(y)) <= threshold and edits(x, y) <= threshold for p, n, y in every)]
        out.append((place, None if t is None else "\n".join(left), 0 if t is None else len(t.split("\n")), 0 if t is None else len(t.split("\n")) - len(left)))
    return out


@pytest.mark.parametrize("threshold", [0, 1, 2, 3])
def test_like_brute_force(spark, threshold):
    rng = random.Random(threshold)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randrange(3, 14))) for _ in range(12)]

    def line():
        x = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "é"])
        return "".join(x)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for i in range(40)] + [(40, None), (41, ""), (42, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(df, threshold, 4).collect())
    assert got == brute(rows, threshold, 4)


@pytest.mark.parametrize("threshold", [1, 2])
def test_crowded_keys(spark, monkeypatch, threshold):
    rng = random.Random(threshold)
    monkeypatch.setattr(lines, "TILE", 2)
    starts = ["the common start of many lines ", "the common start of many line "]
    texts = [rng.choice(starts) + str(rng.randrange(40)) * rng.randrange(1, 3) + rng.choice(["", "a", "é", "aé"]) + " and the common end" for _ in range(70)]
    texts += ["x" * rng.randrange(20, 24) for _ in range(8)] + ["ab" * rng.randrange(10, 14) + rng.choice(["", "a", "c"]) for _ in range(20)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(df, threshold).collect()) == brute(rows, threshold, 20)


def test_a_common_half_line(spark):
    """10,000 lines share their first half: no work for each pair."""
    rng = random.Random(1)
    rows = [(i, "the first half of every line is just the same: " + "".join(rng.choices("abcdefghij ", k=47))) for i in range(10_000)]
    rows += [(10_000 + i, rows[i][1][:-1] + "z") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines.dedup_lines(df.limit(10)).count()
    began = time.time()
    gone = {r.doc_id for r in lines.dedup_lines(df).collect() if r.n_removed}
    assert gone == set(range(10_000, 10_050)) and time.time() - began < 40


def test_any_other_column_stays(spark):
    names = ("k", "th", "nos", "lines", "left", "rest", "at", "a.b")
    df = spark.createDataFrame([(1, "x" * 30, *range(8)), (2, "x" * 30, *range(8))], f"doc_id long, text string, {', '.join(f'`{c}` int' for c in names)}")
    got = sorted(map(tuple, lines.dedup_lines(df).collect()))
    assert got == [(1, "x" * 30, *range(8), 1, 0), (2, "", *range(8), 1, 1)]


def test_op4(spark, corpus, docs):
    full, empty = corpus
    rows = docs.select("doc_id", "text").collect()
    got = sorted(map(tuple, lines.op4_line_dedup(spark, full).collect()))
    want = []
    seen = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        gone = r.text is not None and len(r.text) >= 20 and seen.setdefault(r.text, r.doc_id) != r.doc_id
        want.append((r.doc_id, 0 if r.text is None else 1, int(gone), hashlib.sha256(("" if gone else r.text or "").encode()).hexdigest()))
    # Document 11 holds a line feed in none of its separators, and 2 and 10 differ from 1 by more than one edit.
    assert got == sorted(want)
    assert lines.op4_line_dedup(spark, empty).count() == 0
    kept = lines.dedup_lines(docs)
    assert kept.columns == [*docs.columns, "n_lines", "n_removed"] and kept.count() == docs.count()


def test_native(spark, docs):
    plan = lines.dedup_lines(docs).select(F.sha2("text", 256))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_short_repeats_go_in_the_pipeline(spark):
    import corpus_pipeline

    rows = [(1, "ab\n\na line of some length, first\nab"), (2, "abc\nab\n\na line of some length, First"), (3, "ab")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {1: "ab\n\na line of some length, first", 2: "abc\n", 3: ""}


def test_text_moves_once(spark):
    """Lines that share no key with another aren't shuffled to be compared: only what the output needs moves."""
    rng = random.Random(5)
    rows = [(i, "\n".join("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(400)) for _ in range(10))) for i in range(800)]
    rows.append((800, rows[7][1].split("\n")[3][:-1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        executors = store.executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    df = df.localCheckpoint()
    before = written()
    assert [r.doc_id for r in lines.dedup_lines(df).collect() if r.n_removed] == [800]
    assert written() - before < 1.5 * sum(len(t.encode()) for _, t in rows)
