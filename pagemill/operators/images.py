"""Images placed on pages: masks, size filter, reading order, and one of each picture placed twice."""

from __future__ import annotations

from itertools import product
from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = ["y0", "x0", "y1", "x1", "listing_pos"]


def with_masks(placements: DataFrame, listed: DataFrame) -> DataFrame:
    """Adds smask from the image listing (doc_id, page_index, xref, smask), 0 where there is none."""
    known = listed.where("xref > 0 AND smask > 0").groupBy("doc_id", "page_index", "xref").agg(F.max_by("smask", "listing_pos").alias("smask"))
    return placements.join(known, ["doc_id", "page_index", "xref"], "left").withColumn("smask", F.coalesce("smask", F.lit(0)))


def large_enough(placements: DataFrame, min_width: int = 32, min_height: int = 32) -> DataFrame:
    return placements.where((F.coalesce("width", F.lit(0)) >= min_width) & (F.coalesce("height", F.lit(0)) >= min_height))


def reading_order(placements: DataFrame) -> DataFrame:
    """Adds image_index, from 1 in each page: by top, left, bottom and right; ties keep the order of the listing."""
    page = Window.partitionBy("doc_id", "page_index").orderBy(*ORDER)
    return placements.withColumn("image_index", F.row_number().over(page))


def kept_of(rows: list[tuple], tolerance: float) -> list[int]:
    """The places of rows (x0, y0, x1, y1, digest, xref) that repeat none kept before them.

    Kept ones lie in a grid over all four coordinates and the source, whose cells are as wide as the tolerance: two in one cell
    are the same, so a cell holds one, and whatever a row could repeat lies in the cells next to its own.
    """
    grid: dict[tuple, tuple] = {}
    kept = []
    for i, (*box, digest, xref) in enumerate(rows):
        sources = [s for s in ((0, digest) if digest is not None else None, (1, xref) if (xref or 0) > 0 else None) if s]
        if None in box or any(x != x for x in box):
            kept.append(i)  # never within any tolerance
            continue
        cell = [floor(x / tolerance) if tolerance > 0 else x for x in box]
        beside = [(c - 1, c, c + 1) if tolerance > 0 else (c,) for c in cell]
        if any((other := grid.get((source, *at))) and all(abs(a - b) <= tolerance for a, b in zip(box, other)) for source in sources for at in product(*beside)):
            continue
        kept.append(i)
        for source in sources:
            grid[source, *cell] = box
    return kept


def distinct_images(placements: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The placements that repeat none kept before them in reading order, and their image_index.

    Two are the same if they share a digest or a positive xref, and all four coordinates are within the tolerance. As
    only kept ones count, the order matters: a page's placements are taken in turn, against a grid of those kept, so the
    work grows with their number and not with its square. A placement without a coordinate repeats none.
    """
    columns = placements.columns
    item = F.struct(*(F.col(c) for c in ORDER), *(F.col(c) for c in columns if c not in ORDER + ["doc_id", "page_index"]))
    pages = placements.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(item)).alias("all"))

    @F.pandas_udf("array<int>")
    def chosen(x0, y0, x1, y1, digest, xref):
        import pandas as pd

        return pd.Series([kept_of(list(zip(*(list(c) for c in page))), tolerance) for page in zip(x0, y0, x1, y1, digest, xref)], dtype=object)

    fields = [F.col(f"all.{c}").cast("array<double>") for c in ("x0", "y0", "x1", "y1")]
    picked = pages.withColumn("kept", chosen(*fields, F.col("all.digest"), F.col("all.xref").cast("array<long>")))
    one = picked.select("doc_id", "page_index", F.posexplode(F.transform("kept", lambda i: F.get("all", i))).alias("n", "p")).select("doc_id", "page_index", "p.*", (F.col("n") + 1).alias("image_index"))
    return one.select(*columns, "image_index")
