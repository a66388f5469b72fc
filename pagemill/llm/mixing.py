"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks. A source with weight w (a share of 1) gives its j-th block (from 0) the release time
floor(j / w) and the deadline ceil((j + 1) / w); in every slot the released block with the earliest deadline runs. After
any number of slots each source then has received its share to within less than one block.

Weights are taken as they are, as whole numbers over a common denominator, so the bound holds against the target weights
at every length. One task, which holds a row for each source, simulates the schedule and puts out a row for each block.
With a ``resolution``, weights are instead rounded to that many whole units: the driver then simulates one period and
every block finds its slot by arithmetic, but shares drift from the targets by the rounding.
When a source runs out, a new phase begins in which the others share its weight in proportion, so every row is placed
exactly once.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, table

BLOCK_ROWS = 64
RESOLUTION = 1000
#: Blocks that the simulation hands on at a time.
STEP = 65_536
#: Target weight of a source unless given: its number of rows to this power (flatter than in proportion).
TEMPERATURE = 0.5


def units(weights: dict[str, float], resolution: int = RESOLUTION) -> dict[str, int]:
    """Whole units that add up to ``resolution``, at least one each, by largest remainder."""
    if not weights:
        return {}
    if len(weights) > resolution:
        raise ValueError(f"{len(weights)} sources need a resolution of at least as many units")
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("every weight must be a positive number")
    total, spare = sum(weights.values()), resolution - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: resolution - sum(out.values())]:
        out[s] += 1
    return out


def period(shares: dict[str, int]) -> list[str]:
    """The source of each slot of one period, earliest deadline first among released blocks."""
    n = sum(shares.values())
    waiting = [(0, s, 0) for s in shares]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(n):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * n // shares[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append(s)
        if j + 1 < shares[s]:
            heapq.heappush(waiting, ((j + 1) * n // shares[s], s, j + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], resolution: int = RESOLUTION) -> tuple[list[tuple], list[tuple]]:
    """Two small tables: (source, phase, first block, blocks, first slot, period, units) and (source, phase, j, slot in period)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    spans, cycles, slot, phase = [], [], 0, 0
    while left:
        shares = units({s: weights[s] for s in left}, resolution)
        cycle = period(shares)
        rounds = min(left[s] // shares[s] for s in left)
        taken = {s: rounds * shares[s] for s in left}
        length = rounds * len(cycle)
        if all(taken[s] < left[s] for s in left):
            for s in cycle:
                taken[s] += 1
                length += 1
                if taken[s] == left[s]:
                    break
        seen = dict.fromkeys(left, 0)
        for at, s in enumerate(cycle):
            cycles.append((s, phase, seen[s], at))
            seen[s] += 1
        spans += [(s, phase, done[s], taken[s], slot, len(cycle), shares[s]) for s in left if taken[s]]
        slot += length
        phase += 1
        for s in list(left):
            done[s] += taken[s]
            left[s] -= taken[s]
            if not left[s]:
                del left[s]
    return spans, cycles


def schedule(blocks: dict[str, int], weights: dict[str, float]):
    """Yields (source, block) of each slot in turn: earliest deadline first on the exact weights, a new phase whenever a source runs out."""
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("every weight must be a positive number")
    ratios = {s: Fraction(weights[s]) for s, n in blocks.items() if n > 0}
    scale = math.lcm(*(r.denominator for r in ratios.values()))
    left = {s: int(r * scale) for s, r in ratios.items()}
    done = dict.fromkeys(left, 0)
    while left:
        total, first, t = sum(left.values()), dict(done), 0
        waiting = [(0, s) for s in left]
        heapq.heapify(waiting)
        ready: list[tuple[int, str]] = []
        while True:
            while waiting and waiting[0][0] <= t:
                s = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (-(-(done[s] - first[s] + 1) * total // left[s]), s))
            s = heapq.heappop(ready)[1]
            yield s, done[s]
            done[s] += 1
            t += 1
            if done[s] == blocks[s]:
                del left[s]
                break
            heapq.heappush(waiting, ((done[s] - first[s]) * total // left[s], s))


def _slots(given: dict[str, float], block_rows: int):
    def run(batches):
        import pandas as pd

        rows: dict[str, int] = {}
        for batch in batches:
            rows.update(zip(batch["s"], batch["count"].astype(int).tolist()))
        total, slot = sum(rows.values()), 0
        goal = {s: given.get(s, n**TEMPERATURE if not given else n / total) for s, n in rows.items()}
        turns = schedule({s: -(-n // block_rows) for s, n in rows.items()}, goal)
        while some := list(islice(turns, STEP)):
            yield pd.DataFrame({"s": [s for s, _ in some], "mix_block": [b for _, b in some], "mix_slot": range(slot, slot + len(some))})
            slot += len(some)

    return run


def mix(
    df: DataFrame, weights: dict[str, float] | None = None, *, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS, resolution: int | None = RESOLUTION, group_rows: int = 2000
) -> DataFrame:
    """``df`` with mix_rank (place within its source), mix_block, mix_slot and mix_position (order of the mix).

    weights: target weight by source, in any unit; sources that it leaves out, and all if it is None, get their number
    of rows to the power 0.5 (as a share of all, where mixed with given weights). A null source is a source of its own.
    resolution: None for the exact weights, else the units that weights are rounded to (and the most sources there may be).
    Rows of a source are taken in the order of a hash of ``key`` (ties: by ``key``; repeated rows are alike). The place
    within a source is an offset of its hash range plus a row number inside the range, so no source is sorted by one task.
    Positions leave gaps after blocks that aren't full. An empty table gives an empty table. Other columns stay as they are,
    whatever their names and nulls; only the four above are refused.
    """
    spark = df.sparkSession
    if clash := {"mix_rank", "mix_block", "mix_slot", "mix_position"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are the operator's own")
    name = F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    given = {f"={k}": v for k, v in (weights or {}).items()}
    if resolution is None:
        counted = settle(df.groupBy(name.alias("s")).count())
        total = counted.agg(F.sum("count")).first()[0] or 0
        slots = settle(counted.repartition(1).mapInPandas(_slots(given, block_rows), "s string, mix_block long, mix_slot long"))
    else:
        counted = df.groupBy(name.alias("s")).count().limit(resolution + 1).collect()  # a row for each source, not more than the resolution
        rows = {r["s"]: r["count"] for r in counted}
        if len(rows) > resolution:
            raise ValueError(f"more than {resolution} sources: raise the resolution")
        total = sum(rows.values())
        goal = {s: given.get(s, n**TEMPERATURE if not given else n / total) for s, n in rows.items()}
        spans, cycles = phases({s: -(-n // block_rows) for s, n in rows.items()}, goal, resolution)

    bits = max(1, min(30, math.ceil(math.log2(max(2, total / group_rows)))))
    # The columns travel in one of their own, so that no name can clash.
    packed = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)))
    h = F.xxhash64(F.col(key).cast("string"))
    dealt = df.select(packed.alias("row"), name.alias("s"), h.alias("h"), F.shiftrightunsigned(h, 64 - bits).alias("g"), F.col(key).alias("key"))
    before = Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("s", "g").agg(F.count(F.lit(1)).alias("n")).withColumn("o", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("s", "g").orderBy("h", "key")) - 1
    ranked = dealt.withColumn("i", inside).join(offsets, ["s", "g"]).withColumn("mix_rank", (F.col("i") + F.col("o")).cast("long"))
    ranked = ranked.withColumn("mix_block", F.expr(f"mix_rank div {block_rows}"))
    if resolution is None:
        placed = ranked.join(slots, ["s", "mix_block"])
    else:
        # Both tables have at most resolution * resolution rows, whatever the corpus holds.
        span = F.broadcast(spark.createDataFrame(spans, "s string, phase int, first long, len long, slot long, period long, units long"))
        cycle = F.broadcast(spark.createDataFrame(cycles, "s string, phase int, j long, place long"))
        placed = ranked.join(span, ["s"]).where("mix_block >= first and mix_block < first + len")
        placed = placed.withColumn("j", F.expr("(mix_block - first) % units")).join(cycle, ["s", "phase", "j"])
        placed = placed.withColumn("mix_slot", F.expr("slot + ((mix_block - first) div units) * period + place"))
    position = F.expr(f"mix_slot * {block_rows} + mix_rank % {block_rows}").alias("mix_position")
    return placed.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)), "mix_rank", "mix_block", "mix_slot", position)


def mixed_order(df: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of ``df``, with its columns, stored in the order of the mix."""
    return mix(df, weights, **options).repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*df.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mix of all sources (weights: rows to the power 0.5)."""
    return mix(table(spark, sf_dir, "documents", "doc_id", "source"), resolution=None)
