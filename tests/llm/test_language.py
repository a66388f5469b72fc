import numpy as np
import zlib

from pagemill.llm import language


def test_op7(spark, corpus, docs):
    full, empty = corpus
    got = language.op7_language_id(spark, full).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (3, 4, 5)] == ["und"] * 3 and {by[i] for i in (1, 2, 6, 7, 9)} <= {"en", "de", "fr", "es"}
    assert language.op7_language_id(spark, empty).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").selectExpr("avg(int(lang = lang_pred))").first()[0]
    assert right > 0.97


def test_like_brute_force(spark):
    docs = spark.createDataFrame([("aab", "x"), ("abb", "x"), ("cdc", "y"), (None, "y"), ("zz", None)], "text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["x", "y"]
    import numpy as np

    counts = np.full((language.BUCKETS, 2), 0.5)
    for t, i in (("aab", 0), ("abb", 0), ("cdc", 1)):
        np.add.at(counts[:, i], language.grams(t), 1)
    want = np.log(counts / counts.sum(axis=0))[language.grams("abc")].sum(axis=0)
    (lang, *_), (score, *_) = model.score(["abc", None, "12"])
    assert lang == "x" and abs(score - 1 / (1 + np.exp(want[1] - want[0]))) < 1e-4


def test_no_labels(spark, docs):
    model = language.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, model).collect()} == {("und", 0.0)}


def test_a_batch_is_scored_like_each_text(monkeypatch):
    rng = np.random.default_rng(2)
    model = language.Model(["x", "y", "z"], np.log(rng.random((language.BUCKETS, 3))).astype(np.float32))
    texts = ["abc " * 300, None, "", "42", "é", *("".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 400, 30))]
    want = [model.score([t]) for t in texts]
    monkeypatch.setattr(language, "BLOCK", 100)
    names, scores = model.score(texts)
    assert names == [w[0][0] for w in want] and np.allclose(scores, [w[1][0] for w in want])
    assert names[1:4] == ["und"] * 3 and model.score([])[0] == []


def test_columns_of_its_own_are_refused(spark):
    import pytest

    model = language.Model(["x"], np.zeros((language.BUCKETS, 1), np.float32))
    df = spark.createDataFrame([("a", "b", 1)], "text string, score string, n int")
    with pytest.raises(ValueError):
        language.predict(df, model)
    twice = df.drop("score").union(df.drop("score"))
    assert language.predict(twice, model).collect()[0] == language.predict(twice, model).collect()[1]
