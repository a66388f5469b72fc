import random
import time

import pytest

from pagemill.operators import images as I


def by_pairs(rows, tolerance):
    kept = []
    for i, (*box, digest, xref) in enumerate(rows):
        same = lambda j: ((digest is not None and digest == rows[j][4]) or ((xref or 0) > 0 and xref == rows[j][5])) and all(a is not None and b is not None and abs(a - b) <= tolerance for a, b in zip(box, rows[j][:4]))
        if not any(same(j) for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("tolerance", [0.0, 0.5, 1.0, 3.0])
def test_against_all_pairs(tolerance):
    rng = random.Random(tolerance)
    for _ in range(60):
        rows = [(*(rng.choice([rng.randrange(6), rng.random() * 5, -rng.random(), None if rng.random() < 0.03 else 1.0]) for _ in range(4)), rng.choice([None, "a", "b"]), rng.choice([None, 0, 1, 2])) for _ in range(60)]
        assert I.kept_of(rows, tolerance) == by_pairs(rows, tolerance)


def test_many_on_one_page(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page_index"), F.col("id").alias("listing_pos"), (F.col("id") % 3).cast("int").alias("xref"), F.lit("d").alias("digest"), *((F.col("id") * k % 997).cast("double").alias(c) for c, k in (("x0", 3), ("y0", 7), ("x1", 11), ("y1", 13))))
    began = time.time()
    got = I.distinct_images(df)
    n = got.count()
    assert 0 < n <= 997 and time.time() - began < 30
    assert sorted(r.image_index for r in got.collect()) == list(range(1, n + 1))
