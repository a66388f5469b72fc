import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            if i == 0:
                assert out.count() >= 0.97 * docs.count()
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert out.count() == docs.count() and out.where("NOT round_trip").count() == 0


def test_edges(spark, docs, corpus):
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, corpus[0])
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == [1, 3, 6, 7, 9, 9, 11]  # 9 of the 11 shingles of 1 and 10 are shared
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), corpus[1]).count() == 0
        assert stage(spark, docs, corpus[0]).count() > 0


def test_the_mix_reaches_the_result(spark, docs):
    from pagemill.llm import mixing

    texts = docs.where("doc_id <> 7 AND doc_id <> 8 AND doc_id <> 9")
    mixed = corpus_pipeline.tokens(spark, corpus_pipeline.mix_sources(spark, texts, ""), "")
    want = sorted((r.doc_id, r.mix_slot, r.mix_position) for r in mixing.mix(texts, resolution=None).collect())
    assert sorted((r.doc_id, r.mix_slot, r.mix_position) for r in mixed.collect()) == want
    assert mixed.columns != corpus_pipeline.tokens(spark, texts, "").columns


def test_columns_of_any_name(spark, docs):
    """Columns named like those that stages make, with dots, and a source that is a struct come through every stage unchanged."""
    from pyspark.sql import functions as F

    odd = ("score", "lang_pred", "n_lines", "mix_slot", "a.b", "rest_", "ids")
    given = docs.select("doc_id", "text", "lang", F.struct(F.col("source").alias("name")).alias("source"), "n_chars", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in odd))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, "")
        assert out.columns == given.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in odd), name
    assert corpus_pipeline.tokens(spark, given, "").count() == given.count()
