import random

from pagemill.functions import procedural as P
from pagemill.operators import planning, sizes
from pagemill.sources import history


def test_block_sizes(spark):
    rng = random.Random(4)
    rows = [(i, float(rng.choice([3, 28, 500, 1632, 4000, 20_000])), float(rng.choice([5, 29, 700, 2112, 3000, 9000])), rng.choice([28, 32, 14]), rng.choice([None, 50176]), rng.choice([None, 6291456, 784 * 3])) for i in range(120)]
    rows += [(200, 0.0, 5.0, 28, 1, 2), (201, 9.0, -1.0, 28, None, None), (202, 60.0, 900.0, 28, None, 784 * 9), (203, 60.0, 900.0, 28, None, 784 * 9)]
    df = spark.createDataFrame(rows, "id long, w double, h double, factor long, least long, most long")
    got = {r.id: (r.width, r.height) for r in sizes.block_sizes(df).collect()}
    assert got == {i: P.bounded_blocks(int(w), int(h), f, a, b) for i, w, h, f, a, b in rows}
    plan = sizes.block_sizes(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sizes.block_sizes(df.limit(0)).count() == 0


def test_history_is_not_shuffled(spark):
    files = spark.createDataFrame([(f"in/{i}/F{i}.pdf",) for i in range(50)] + [("other/F3.pdf",), ("x/new.PDF",)], "path string")
    done = planning.plan(files).where("path LIKE 'in/%'").limit(200).where("length(output) < 9")
    history.save(done, "history_a", buckets=8)
    got = history.plan(files, "history_a")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, planning.plan(files, done).collect()))
    plan = history.plan(files, "history_a")._jdf.queryExecution().executedPlan().toString()
    # One exchange, that of the new files.
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, plan
    met = {tuple(r) for r in history.collisions(files, "history_a").collect()}
    assert met == {("md/F3.md", "in/3/F3.pdf", "other/F3.pdf")}
    # What a run made is added, and skipped from then on.
    history.save(got, "history_a", buckets=8)
    assert history.plan(files, "history_a").count() == 0
    spark.sql("DROP TABLE history_a")


def test_resize_by_profile(spark):
    import pytest

    ddl = "id int, w double, h double, strategy string, resize_factor long, min_pixels long, max_pixels long, pixel_count_factor long"
    rows = [(1, 1632.0, 2112.0, "blocks", 28, 50176, 6291456, 1), (2, 100.0, 60.0, "smart", None, None, None, 1), (3, 1000.0, 700.0, "smart", 28, 12544, 1003520, 2)]
    got = {r.id: (r.width, r.height) for r in sizes.resize(spark.createDataFrame(rows, ddl)).collect()}
    assert got[1] == P.bounded_blocks(1632, 2112, 28, 50176, 6291456) and got[2] == (100, 60) and got[3][0] % 28 == got[3][1] % 28 == 0
    for bad in [(4, 9.0, 9.0, "other", None, None, None, 1), (5, 9.0, 9.0, "smart", None, 4, None, 1)]:
        with pytest.raises(Exception, match="unknown strategy|need a factor"):
            sizes.resize(spark.createDataFrame([bad], ddl)).collect()
