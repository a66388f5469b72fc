"""Image sizes in whole blocks within bounds of pixels, by a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import smart_size

KEYS = ("w", "h", "factor", "least", "most")

#: Blocks near the scaled sides; while there are too many, one row or column of blocks goes, whichever leaves the aspect nearer.
#: A single row or column is cut at once.
QUERY = """
WITH RECURSIVE scaled AS (
  SELECT *, CASE WHEN most IS NOT NULL AND w * h > most THEN sqrt(most / (w * h)) WHEN least IS NOT NULL AND w * h < least THEN sqrt(least / (w * h)) ELSE 1.0D END AS scale FROM {sizes}),
steps (w, h, factor, least, most, x, y) AS (
  SELECT w, h, factor, least, most, greatest(1, bigint(rint(w * scale / factor))), greatest(1, bigint(rint(h * scale / factor))) FROM scaled
  UNION ALL
  SELECT w, h, factor, least, most,
    CASE WHEN y = 1 THEN greatest(1, most div (factor * factor)) WHEN x = 1 OR NOT narrower THEN x ELSE x - 1 END,
    CASE WHEN x = 1 THEN greatest(1, most div (factor * factor)) WHEN y = 1 OR narrower THEN y ELSE y - 1 END
  FROM (SELECT *, y > 1 AND abs((x - 1) / double(y) - w / h) < abs(x / double(y - 1) - w / h) AS narrower FROM steps WHERE most IS NOT NULL AND x * y * factor * factor > most AND (x > 1 OR y > 1)))
SELECT w, h, factor, least, most, int(min_by(x, x * y) * factor) AS width, int(min_by(y, x * y) * factor) AS height FROM steps GROUP BY ALL
"""


def block_sizes(rows: DataFrame) -> DataFrame:
    """``rows`` (w, h, factor, and bounds least and most, which may be null) with width and height in multiples of factor.

    Each different size is worked out once. Sides that aren't positive stay as they are; a null side or factor has no size.
    """
    spark = rows.sparkSession
    wanted = rows.select(F.col("w").cast("double"), F.col("h").cast("double"), *(F.col(c).cast("long") for c in KEYS[2:])).where("w > 0 AND h > 0 AND factor > 0").distinct()
    for name in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
        spark.conf.set(name, "-1")  # every level makes one block less, so it ends
    found = spark.sql(QUERY, sizes=wanted).select(*(F.col(c).alias(f"{c}_") for c in KEYS), "width", "height")
    same = [rows[c].cast("double" if c in ("w", "h") else "long").eqNullSafe(found[f"{c}_"]) for c in KEYS]
    joined = rows.join(found, same, "left").drop(*(f"{c}_" for c in KEYS))
    unscaled = F.expr("w <= 0 OR h <= 0")
    return joined.withColumns({c: F.when(unscaled, F.col(k).cast("int")).otherwise(F.col(c)) for c, k in (("width", "w"), ("height", "h"))})


def resize(rows: DataFrame) -> DataFrame:
    """``rows`` (w, h and the columns of a render profile) with width and height, each by the strategy of its profile.

    ``smart`` rounds to the factor within the bounds of pixels, ``blocks`` gives up blocks one by one; any other strategy raises, and so do bounds without
    a factor. Without both, sizes stay as they are.
    """
    bounded = F.col("resize_factor").isNull() & (F.col("min_pixels").isNotNull() | F.col("max_pixels").isNotNull())
    rows = rows.withColumn("resize_factor", F.when(bounded, F.raise_error(F.lit("bounds of pixels need a factor")).cast("long")).otherwise(F.col("resize_factor")))
    smart = rows.where("strategy = 'smart'").withColumn("s", smart_size(F.col("w"), F.col("h"), {c: F.col(c) for c in rows.columns}))
    smart = smart.withColumns({"width": F.col("s.width"), "height": F.col("s.height")}).drop("s")
    blocks = rows.where("strategy = 'blocks'").withColumnsRenamed({"resize_factor": "factor", "min_pixels": "least", "max_pixels": "most"})
    blocks = block_sizes(blocks).withColumnsRenamed({"factor": "resize_factor", "least": "min_pixels", "most": "max_pixels"})
    unknown = rows.where("strategy IS NULL OR strategy NOT IN ('smart', 'blocks')").withColumns({c: F.raise_error(F.concat(F.lit("unknown strategy: "), F.coalesce("strategy", F.lit("none")))).cast("long") for c in ("width", "height")})
    cast = lambda df: df.withColumns({c: F.col(c).cast("long") for c in ("width", "height")})
    return cast(smart).unionByName(cast(blocks)).unionByName(unknown)
