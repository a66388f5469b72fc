import collections
import math
import random
import re

from pagemill.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The five counts, from their definitions."""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_rules():
    rng = random.Random(1)
    texts = ["", " ", "\n\n", "one", "a b", "a b c", "a a a a", "x y z x y z", "l\nl\n \nl ", "\x1c\x85 ü テスト 🎉", "a#b <c>\x0bd|e", "#*$%&|<>" * 3]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))).replace(" b", "\nb") for _ in range(200)]
    for text in texts:
        assert quality.rules(text.encode()) == brute(text), text


def grams(text):
    code = [ord(c) for c in f" {text} "]
    return [((a * 65599 + b) * 65599 + c) % 65521 for a, b, c in zip(code, code[1:], code[2:])]


CLEAN = "the river runs past old mills and quiet towns where people trade grain wool and stories before winter comes again to these hills while children learn songs of ships that once sailed far beyond every map"
JUNK = "ZXQ!! ###BUY$$$ %%NOW%% &&& QQQ!! *** WWW|| <<>> VVV@@"


def rows(seed=3, n=120):
    rng = random.Random(seed)
    make = lambda text: " ".join(rng.choice(text.split()) for _ in range(rng.randrange(80, 200)))
    docs = [(i, make(JUNK if i % 6 == 0 else CLEAN)) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "short"), (n + 3, make(CLEAN) * 3), (n + 3, docs[1][1]), (None, docs[1][1]), (n + 4, "퟿🎉 " * 60)]
    return docs, [(i, int(i % 6 != 0), 0) for i in range(0, n, 2)] + [(1, 1, 1), (None, 1, 0), (6, None, None), (2, 1, 0), (2, 0, None)]


def test_op13(spark, tmp_path):
    docs, labels = rows()
    spark.createDataFrame([(*d, 1.0, "k") for d in docs], "doc_id long, text string, llr double, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = collections.Counter(tuple(r)[:-1] + (None if r.llr is None else round(r.llr, 9),) for r in quality.op13_quality_rules(spark, str(tmp_path)).collect())
    good = {i for i, q, t in labels if q == 1 and not t and i is not None}
    raw, extra = collections.Counter(), collections.Counter()
    for i, text in docs:
        own = grams(text or "") if text else grams("")
        raw.update(own)
        if i in good:
            extra.update(own)
    n, m = sum(raw.values()), sum(extra.values())
    w = {b: round((math.log((extra[b] + 0.5) / (m + 0.5 * 65521)) - math.log((raw[b] + 0.5) / (n + 0.5 * 65521))) * 2**20) for b in raw}
    want = collections.Counter()
    for i, text in docs:
        five = brute(text or "")
        failed = five[0] < 50 or 100 * five[4] > 50 * five[0]
        own = grams(text or "")
        llr = sum(w[b] for b in own) / (2**20 * len(own)) if own else None
        want[(i, *five, failed, not failed and llr is not None and llr >= -0.5, None if llr is None else round(llr, 9))] += 1
    assert got == want
    kept = {r[0]: r[7] for r in want}
    assert not any(kept[i] for i in range(0, 120, 6)) and sum(kept[i] for i in range(120) if i % 6) > 90


def test_nothing_trusted_or_empty(spark):
    docs = spark.createDataFrame(rows()[0], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, quality.trusted_of(none)) is None
    got = quality.judge(docs, None).collect()
    assert len(got) == docs.count() and all(r.llr is None and r.kept != r.base_failed for r in got)
    weight = quality.fit(docs.limit(0), quality.trusted_of(none))
    assert quality.judge(docs.limit(0), weight).count() == 0


def test_held_out_quality(spark):
    """Documents whose labels aren't learned from: those called good stay, the others go."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    learned, asked = labels.where("crc32(cast(cast(doc_id AS string) AS binary)) % 2 = 0"), labels.where("crc32(cast(cast(doc_id AS string) AS binary)) % 2 = 1")
    judged = quality.judge(docs, quality.fit(docs, quality.trusted_of(learned))).where("NOT base_failed").join(asked, "doc_id")
    share = {r.quality: (r.n, r.kept) for r in judged.groupBy("quality").agg({"*": "count", "kept": "max"}).selectExpr("quality", "`count(1)` AS n", "`max(kept)` AS kept").collect()}
    wrong = judged.where("kept <> (quality = 1)").count()
    assert set(share) == {0, 1} and wrong <= 0.002 * sum(n for n, _ in share.values())
