"""What to convert: listings, page ranges and selectors, output paths, collisions, and what is done already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def list_files(spark: SparkSession, path: str, *, recursive: bool = False, suffix: str = "pdf") -> DataFrame:
    """path, length and modificationTime of files by suffix in any case, in the order of their lower-cased paths.

    Contents aren't read: only these columns are asked of the scan.
    """
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", "modificationTime").orderBy(F.lower("path"), "path")


def page_range(total: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The last page (zero-based, all pages if null) and what is wrong, if anything: the first of six checks that fails."""
    last = F.coalesce(end, total - 1)
    wrong = (
        F.when(total <= 0, "no pages").when(start < 0, "negative start").when(last < 0, "negative end").when(start > last, "start after end").when(start >= total, "start out of bounds").when(last >= total, "end out of bounds")
    )
    return last, wrong


def page_tasks(documents: DataFrame) -> DataFrame:
    """One row for each page from start_page to end_page of the documents without an error."""
    return documents.where("error IS NULL").withColumn("page_index", F.explode(F.sequence("start_page", "end_page")))


def select_pages(selectors: DataFrame) -> DataFrame:
    """Adds pages (zero-based, in the order named, each once) and error, from spec, total_pages and zero_based.

    A spec is a list of ``N``, ``A-B``, ``A-`` and ``-B``. The first selector that is wrong gives the error.
    """
    low = F.when(F.col("zero_based"), 0).otherwise(1)
    high = F.when(F.col("zero_based"), F.col("total_pages") - 1).otherwise(F.col("total_pages"))
    tokens = F.filter(F.transform(F.split("spec", ",", -1), T.strip), lambda t: t != "")
    named = selectors.withColumn("__low", low).withColumn("__high", high).withColumn("__tokens", tokens)

    def read(t: Column) -> Column:
        is_range = F.contains(t, F.lit("-"))
        a, b = T.strip(F.substring_index(t, "-", 1)), T.strip(F.substring(t, F.instr(t, "-") + 1, F.length(t)))
        number = lambda x: F.when(x.rlike(r"\A[0-9]{1,9}\z"), F.try_to_number(x, F.lit("999999999")).cast("int"))
        first = F.when(is_range & (a == ""), F.col("__low")).otherwise(number(a))
        last = F.when(~is_range, number(a)).when(b == "", F.col("__high")).otherwise(number(b))
        bad = (
            F.when(is_range & (a == "") & (b == ""), "empty range").when(first.isNull() | last.isNull(), "not a number").when(first > last, "start after end")
            .when((first < F.col("__low")) | (last > F.col("__high")), "out of bounds")
        )
        return F.struct(first.alias("first"), last.alias("last"), bad.alias("error"))

    parsed = named.withColumn("__ranges", F.transform("__tokens", read))
    wrong = F.get(F.filter(F.transform("__ranges", lambda r: r["error"]), lambda e: e.isNotNull()), 0)
    error = F.when(F.col("total_pages") <= 0, "no pages").when(F.size("__tokens") == 0, "no selectors").otherwise(wrong)
    pages = F.array_distinct(F.flatten(F.transform("__ranges", lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda p: p - F.col("__low")))))
    return parsed.withColumn("error", error).withColumn("pages", F.when(F.col("error").isNull(), pages)).select(*selectors.columns, "pages", "error")


def plan(files: DataFrame, done: DataFrame | None = None, out: str = "md") -> DataFrame:
    """path and output of what is to do: all files, without those whose output is among ``done`` (a column output)."""
    tasks = files.select("path", T.output_path(F.col("path"), out=out).alias("output"))
    return tasks if done is None else tasks.join(done.select("output"), "output", "left_anti").select("path", "output")


def collisions(files: DataFrame, out: str = "md") -> DataFrame:
    """output, first_path, path: every file whose output an earlier one (in the order of lower-cased paths) has taken."""
    order = Window.partitionBy("output").orderBy(F.lower("path"), "path")
    named = plan(files, out=out).withColumn("first_path", F.first("path").over(order)).withColumn("n", F.row_number().over(order))
    return named.where("n > 1").select("output", "first_path", "path")


def collision_report(files: DataFrame, shown: int = 10, out: str = "md") -> DataFrame:
    """The first collisions in order, and one line that counts the rest."""
    found = collisions(files, out)
    first = found.orderBy("output", "path").limit(shown).select(F.concat_ws(" ", "output", "first_path", "path").alias("line"))
    rest = found.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shown).select(F.concat(F.lit("... and "), (F.col("n") - shown).cast("string"), F.lit(" more")).alias("line"))
    return first.unionByName(rest)


def drop_empty_entries(metadata: Column) -> Column:
    """A map without empty or null values."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull() & (v != ""))


def source_metadata(rows: DataFrame, key: str, **fields: Column) -> DataFrame:
    """key and metadata, a map of what is known of a source: every value as text, without those that are null or empty."""
    entries = [x for name, value in fields.items() for x in (F.lit(name), value.cast("string"))]
    return rows.select(key, drop_empty_entries(F.create_map(*entries)).alias("metadata"))
