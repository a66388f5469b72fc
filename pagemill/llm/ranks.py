"""Positions of rows within groups of any size, without a window: a hot group is spread over many tasks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import parts, settle

#: What ``numbered`` adds.
ADDED = ("group_start", "position", "last")


class Numbered(NamedTuple):
    rows: DataFrame
    #: Rows of the largest group, and of all.
    largest: int
    total: int


def _keys(batch, group: list[str]) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in group))) if group else [()] * batch.num_rows


def _summary(group: list[str]):
    def run(batches):
        import pyarrow as pa

        n, first, before, start, longest, head, part = 0, None, None, 0, 0, 0, 0
        for batch in batches:
            part = batch.column("part_")[0].as_py() if batch.num_rows else part
            for key in _keys(batch, group):
                if n == 0:
                    first = key
                elif key != before:
                    longest, start, head = max(longest, n - start), n, head or n
                before = key
                n += 1
        if n:
            kind = pa.struct([*(batch.schema.field(c) for c in group), pa.field("pagemill", pa.int64())])
            ends = [pa.array([dict(zip(group, k)) | {"pagemill": 0}], kind) for k in (first, before)]
            numbers = [pa.array([x], pa.int64()) for x in (part, n, start, max(longest, n - start), head or n)]
            yield pa.RecordBatch.from_arrays([*numbers, *ends], ["part", "n", "start", "longest", "head", "first", "final"])

    return run


def numbered(df: DataFrame, group: list[str], order: list[str]) -> Numbered:
    """Every row of ``df`` with group_start, position and last.

    Rows are sorted by group and order, nulls first; position counts from 0 within the group, last marks a group's last
    row, and group_start, the number of rows in all groups before it, names the group. Rows equal in all of these columns
    are ordered at will, and may be spread over partitions. An empty table gives an empty one. Columns named like the three
    are refused. What reaches the driver, and each task, is one row for each partition.
    """
    if clash := {*ADDED, "tie_", "part_"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are the operator's own")
    columns = [F.col(f"`{c}`") for c in [*group, *order]]
    tied = df.withColumn("tie_", F.monotonically_increasing_id())
    sort = [*columns, F.col("tie_")]
    dealt = settle(tied.repartitionByRange(parts(df.sparkSession), *sort).sortWithinPartitions(*sort).drop("tie_").withColumn("part_", F.spark_partition_id()))
    key = StructType([*(dealt.schema[c] for c in group), StructField("pagemill", LongType())])
    found = StructType([*(StructField(c, LongType()) for c in ("part", "n", "start", "longest", "head")), StructField("first", key), StructField("final", key)])
    known = sorted(dealt.select(*columns[: len(group)], "part_").mapInArrow(_summary(group), found).collect(), key=lambda p: p.part)

    # Where each partition begins, where its first group begins, and whether its last group goes on in the next one.
    places, offset, current, largest = {}, 0, 0, 0
    for i, p in enumerate(known):
        goes_on = i > 0 and known[i - 1].final == p.first
        begin = current if goes_on else offset
        current = offset + p.start if p.start else begin
        places[p.part] = (offset, begin, i + 1 < len(known) and known[i + 1].first == p.final)
        largest = max(largest, p.longest, offset + p.head - begin)
        offset += p.n

    def run(batches):
        import pyarrow as pa

        waiting, before, at, start, goes_on = None, None, 0, 0, False

        def out(batch, starts, positions, final):
            batch = batch.drop_columns(["part_"])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64()), pa.array(positions, pa.int64()), pa.array([*final], pa.bool_())], [*batch.schema.names, *ADDED])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(batch, group)
            if waiting:
                yield out(*waiting[:3], [*waiting[3], keys[0] != before])
            else:
                # The partition is told by its rows: within a union a task has another number.
                at, start, goes_on = places[batch.column("part_")[0].as_py()]
            starts, positions, final = [], [], []
            for i, key in enumerate(keys):
                if (i or waiting) and key != before:
                    start = at
                if i:
                    final.append(key != before)
                starts.append(start)
                positions.append(at - start)
                before = key
                at += 1
            waiting = (batch, starts, positions, final)
        if waiting:
            yield out(*waiting[:3], [*waiting[3], not goes_on])

    schema = StructType([*dealt.drop("part_").schema.fields, StructField("group_start", LongType()), StructField("position", LongType()), StructField("last", BooleanType())])
    return Numbered(dealt.mapInArrow(run, schema), largest, offset)
