"""Saved listings of models on a hub: one file, or pages with bounds in their names that a data source skips by."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

from .files import file_system, write_files

#: Models are found under this address.
SITE = "https://huggingface.co/"
SCHEMA = "id string, createdAt string, downloads long, likes long"
FORMAT = "hub_listing"
#: Models of a saved page.
PAGE = 1000
_NAME = re.compile(r"page-\d+-\d+\.downloads-(\d+)\.likes-(\d+)\.json")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """A saved listing (JSON), with only the fields that are used."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def save_pages(listing: DataFrame, folder: str, size: int = PAGE) -> None:
    """A listing as pages of ``size`` models, those with most downloads first; the most of a page stand in its name.

    Missing numbers count as zero there, and stay missing inside. Rows are dealt by ranges, so no task sorts them all.
    """

    def pages(batches):
        import pandas as pd
        from pyspark import TaskContext

        part, n, waiting = TaskContext.get().partitionId(), 0, []

        def page(models):
            most = [max(int(m[c] or 0) for m in models) for c in ("downloads", "likes")]
            return f"page-{part:06}-{n:06}.downloads-{most[0]}.likes-{most[1]}.json", json.dumps(models)

        for batch in batches:
            for row in json.loads(batch.to_json(orient="records")):
                waiting.append(row)
                if len(waiting) == size:
                    yield pd.DataFrame([page(waiting)], columns=["output", "content"])
                    n, waiting = n + 1, []
        if waiting:
            yield pd.DataFrame([page(waiting)], columns=["output", "content"])

    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    # Numbers travel as text: a missing one would make doubles of its column.
    rows = listing.select(*columns).repartitionByRange(F.desc("downloads"), "id").sortWithinPartitions(F.desc("downloads"), "id")
    rows = rows.select("id", "createdAt", *(F.col(c).cast("string") for c in ("downloads", "likes")))
    write_files(rows.mapInPandas(pages, "output string, content string"), folder)


@dataclass
class PageOfListing(InputPartition):
    path: str


class ListingReader(DataSourceReader):
    """A partition for each page that can hold what the filters want; fields beyond the schema are never made into columns."""

    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema, self.least, self.equal = folder, schema, {"downloads": None, "likes": None}, {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and column in self.least:
                bound = f.value + isinstance(f, GreaterThan)
                self.least[column] = bound if self.least[column] is None else max(bound, self.least[column])
            elif isinstance(f, EqualTo) and column == "id":
                self.equal[column] = f.value
            else:
                yield f  # Spark's own

    def partitions(self):
        from pyarrow import fs

        system, base = file_system(self.folder)
        kept = []
        for info in system.get_file_info(fs.FileSelector(base)):
            if name := _NAME.fullmatch(info.base_name):
                most = {"downloads": int(name[1]), "likes": int(name[2])}
                if all(least is None or most[c] >= least for c, least in self.least.items()):
                    kept.append(info.path)
        return [PageOfListing(path) for path in sorted(kept)]

    def read(self, partition: PageOfListing):
        import pyarrow as pa

        system, _ = file_system(self.folder)
        with system.open_input_stream(partition.path) as page:
            models = json.loads(page.read())
        whole = lambda m, c: None if m.get(c) is None else int(m[c])
        kept = [m for m in models if all(least is None or (whole(m, c) is not None and whole(m, c) >= least) for c, least in self.least.items()) and all(m.get(c) == v for c, v in self.equal.items())]
        columns = [pa.array([whole(m, f.name) for m in kept], pa.int64()) if f.name in self.least else pa.array([m.get(f.name) for m in kept], pa.string()) for f in self.schema.fields]
        yield pa.RecordBatch.from_arrays(columns, [f.name for f in self.schema.fields])


class HubListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options["path"].rstrip("/"), schema)


def read_pages(spark: SparkSession, folder: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A listing saved by ``save_pages``, with only the columns named. Least downloads and likes, and an id, are pushed to the pages.

    Models without an id are left out. That filter makes Spark ask the source anew in each query: without any, it would go
    on with what an earlier query over the same DataFrame had pushed.
    """
    spark.dataSource.register(HubListing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = ", ".join(c for c in SCHEMA.split(", ") if columns is None or c.split()[0] in {"id", *columns})
    return spark.read.format(FORMAT).schema(schema).option("path", folder).load().where("id IS NOT NULL")


def filter_models(listing: DataFrame, min_downloads: int = 1000, min_likes: int = 50) -> DataFrame:
    """Models with enough downloads and likes (none given: 0), newest first."""
    for column, least in (("downloads", min_downloads), ("likes", min_likes)):
        # A plain comparison can be pushed to a source; it leaves out models without a number, as a positive bound does.
        listing = listing.where((F.col(column) if least > 0 else F.coalesce(column, F.lit(0))) >= least)
    rows = listing.select(F.col("id").alias("model_id"), F.col("createdAt").alias("created_at"), "downloads", "likes", F.concat(F.lit(SITE), "id").alias("url"))
    return rows.orderBy(F.desc("created_at"), "model_id")
