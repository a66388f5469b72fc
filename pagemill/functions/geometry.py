"""Render scales and image sizes, as Column builders. Rounding is half to even, as in the models' own preprocessing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def render_scale(width: Column, height: Column, p: dict[str, Column]) -> Column:
    """Pixels for each point: by resolution or longest side, raised to the shortest side wanted, then capped; null if a side isn't positive or nothing is set."""
    longest, shortest = F.greatest(width, height), F.least(width, height)
    base = F.coalesce(p["render_dpi"] / 72.0, p["target_longest_dim"] / longest)
    raised = F.when(shortest * base < p["min_shortest_dim"], p["min_shortest_dim"] / shortest).otherwise(base)
    capped = F.when(longest * raised > p["max_longest_dim"], p["max_longest_dim"] / longest).otherwise(raised)
    return F.when((width > 0) & (height > 0), capped)


def smart_size(width: Column, height: Column, p: dict[str, Column]) -> Column:
    """A struct of width and height in multiples of the factor, within the pixel bounds; unchanged without a factor."""
    f, least, most, n = p["resize_factor"], p["min_pixels"], p["max_pixels"], p["pixel_count_factor"]
    floored = lambda x: F.greatest(f, (F.floor(x / f) * f).cast("long"))
    near = lambda x: F.greatest(f, (F.rint(x / f) * f).cast("long"))
    w, h = near(width), near(height)
    shrink = F.sqrt(n * width * height / most)
    grow = F.sqrt(least / (n * width * height))
    gw, gh = ((F.ceil(x * grow / f) * f).cast("long") for x in (width, height))
    again = F.sqrt(n * gw * gh / most)
    over, under, still = n * w * h > most, n * w * h < least, n * gw * gh > most
    pick = lambda x, near_, grown: F.when(f.isNull(), x.cast("long")).when(over, floored(x / shrink)).when(under, F.when(still, floored(grown / again)).otherwise(grown)).otherwise(near_)
    return F.struct(pick(width, w, gw).alias("width"), pick(height, h, gh).alias("height"))
