import random

from pyspark.sql import functions as F

from pagemill.operators import documents as D
from pagemill.plans import assembly
from pagemill.streaming import documents as S

DDL = "doc_id long, page_index int, markdown string, delivered timestamp"
SF = "/root/testdata/sf0.001"


def deliveries(spark):
    return assembly.pages(spark, SF).select("doc_id", "page_index", "markdown", F.timestamp_seconds(1_700_000_000 + F.col("page_index")).alias("delivered"))


def deliver(spark, rows, folder):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    S.keep_up(spark.readStream.schema(DDL).parquet(f"{folder}/in"), f"{folder}/out").awaitTermination()


def test_any_order(spark, tmp_path):
    rows, want = [tuple(r) for r in deliveries(spark).collect()], sorted(map(tuple, assembly.assemble_document(spark, SF).collect()))
    for seed in (1, 2):
        folder, own = f"{tmp_path}/{seed}", rows + rows[:20]
        random.Random(seed).shuffle(own)
        cut = len(own) // 3 * seed
        deliver(spark, own[:cut], folder)
        deliver(spark, own[cut:], folder)
        assert sorted(map(tuple, S.current(spark, f"{folder}/out").collect())) == want


def test_only_touched_documents_are_written(spark, tmp_path):
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    deliver(spark, [(d, 0, f"first {d}", at(d)) for d in range(9)] + [(None, 0, "lost", at(1))], tmp_path)
    deliver(spark, [(4, 1, "late", at(20)), (4, 1, "late", at(20)), (11, 0, "new", at(21))], tmp_path)
    out = f"{tmp_path}/out"
    written = spark.read.parquet(f"{out}/documents").groupBy("batch").agg(F.array_sort(F.collect_list("doc_id")).alias("d")).orderBy("batch").collect()
    assert [w.d for w in written][-1] == [4, 11] and sum(len(w.d) for w in written) == 11
    assert {r.doc_id: r.markdown for r in S.current(spark, out).collect()} == {**{d: f"first {d}\n" for d in range(9)}, 4: "first 4\n\nlate\n", 11: "new\n"}
    # A batch that runs again leaves the same tables.
    again = spark.createDataFrame([(4, 1, "late", at(20)), (11, 0, "new", at(21))], DDL)
    S._rewrite(again, max(w.batch for w in written), out)
    assert D.assemble(spark.createDataFrame([(4, 0, "first 4"), (4, 1, "late")], "doc_id long, page_index int, markdown string")).first().markdown == S.current(spark, out).where("doc_id = 4").first().markdown
