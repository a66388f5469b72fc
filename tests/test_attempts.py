import random
import time

from pagemill.operators import documents as D
from pagemill.plans import assembly
from pagemill.streaming import attempts as A

DDL = "doc_id long, page_index int, at long, seq long, outcome string, correction int, error string, prompt_tokens long, completion_tokens long"


def log(seed, pages=40):
    rng, rows = random.Random(seed), []
    for p in range(pages):
        for k in range(rng.choice([1, 2, 5, 12])):
            outcome = rng.choice(["invalid", "error", "error", "invalid", "valid" if k else "error", "fatal" if k > 2 else "error"])
            rows.append((p, p % 3, 10 * k + p, len(rows), outcome, rng.choice([0, 90, 180, 270, None]), f"e{k}" if outcome in ("error", "fatal") else None, rng.choice([None, 5, 7]), k))
    return sorted(rows, key=lambda r: r[2])


def reduced(spark, rows, most=8):
    """By the batch operator."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc_id", "page_index").orderBy("at", "seq")
    return sorted(map(tuple, D.reduce_attempts(spark.createDataFrame(rows, DDL).withColumn("attempt", F.row_number().over(order)), most).collect()))


def test_batches_and_restart(spark, tmp_path):
    rows, folder = log(1), f"{tmp_path}/in"
    for part in (rows[:40], rows[40:80]):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(folder)
    first = A.drain(stream, f"{tmp_path}/out")
    assert sorted(map(tuple, A.latest(first).collect())) == reduced(spark, rows[:80])
    # Another run takes up the state of the first.
    spark.createDataFrame(rows[80:], DDL).coalesce(1).write.mode("append").parquet(folder)
    second = A.drain(spark.readStream.schema(DDL).parquet(folder), f"{tmp_path}/out")
    assert sorted(map(tuple, A.latest(second).collect())) == reduced(spark, rows)


def test_timers(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    add = lambda *rows: spark.createDataFrame(list(rows), DDL).coalesce(1).write.mode("append").parquet(folder)
    add((1, 0, 0, 0, "invalid", 90, None, 1, 1), (2, 0, 0, 0, "valid", 0, None, 1, 1), (3, 0, 0, 0, "error", 0, "e", 1, 1))
    stream = spark.readStream.schema(DDL).parquet(folder)
    A.drain(stream, out)
    time.sleep(1.2)
    add((3, 0, 1, 1, "fatal", 0, "f", 4, 2))
    got = A.drain(stream, out)
    asked = {(r.doc_id, r.next_attempt, r.next_rotation) for r in A.due(got).collect()}
    assert (1, 2, 90) in asked and not {d for d, _, _ in asked} & {2, 3}


def test_retries_while_nothing_arrives(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, 0, 0, 0, "error", 0, "e", 1, 1)], DDL).coalesce(1).write.parquet(folder)
    query = A.follow(spark.readStream.schema(DDL).parquet(folder), out, every="0 seconds")
    try:
        until = time.time() + 60
        while time.time() < until and not any(p.batchId > 0 and p.sink.numOutputRows != 0 for p in query.recentProgress):
            time.sleep(0.5)
        time.sleep(2)
    finally:
        query.stop()
    got = spark.read.schema(A.RESULT).parquet(f"{out}/rows")
    assert [(r.doc_id, r.next_attempt) for r in A.due(got).collect()] == [(1, 2)]


def test_registered_stream(spark):
    sf = "/root/testdata/sf0.001"
    assert sorted(map(tuple, assembly.reduce_attempts_stream(spark, sf).collect())) == sorted(map(tuple, assembly.reduce_attempts(spark, sf).collect()))
