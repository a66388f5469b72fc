"""From page rows to documents: assembly, counts, failures and attempt logs. One shuffle, on the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

NAMESPACE = "pagemill"


def _body(markers: bool, namespace: str) -> tuple[Column, Column]:
    """The aggregate that holds a document's pages, and its text from column ``listed``."""
    md = F.coalesce("markdown", F.lit(""))
    if markers:
        md = T.rstrip(F.concat(T.page_marker(F.col("page_index"), namespace), F.lit("\n\n"), md))
    listed = F.array_sort(F.collect_list(F.when(T.strip(md) != "", F.struct("page_index", md.alias("md"))))).alias("listed")
    body = T.strip(F.array_join(F.transform("listed", lambda p: p["md"]), "\n\n"))
    return listed, F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def assemble(pages: DataFrame, *, markers: bool = False, namespace: str = NAMESPACE) -> DataFrame:
    """doc_id and markdown: the non-blank pages in order, between blank lines, with one line feed at the end (or empty)."""
    listed, text = _body(markers, namespace)
    return pages.groupBy("doc_id").agg(listed).select("doc_id", text.alias("markdown"))


def assemble_with_stats(pages: DataFrame, *, markers: bool = False, namespace: str = NAMESPACE) -> DataFrame:
    """``assemble`` and ``stats`` side by side, from one pass over the pages and one shuffle."""
    listed, text = _body(markers, namespace)
    made = pages.groupBy("doc_id").agg(listed, *_counts()).withColumn("markdown", text)
    return made.select("doc_id", "markdown", "pages", "failed_pages", "prompt_tokens", "completion_tokens", "extracted_images", F.length("markdown").cast("long").alias("chars"))


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed_pages"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("n_images").alias("extracted_images"),
    ]


def assemble_compact(pages: DataFrame) -> DataFrame:
    """The variant: null pages are skipped, blank ones kept, right-stripped and joined by single line feeds."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("markdown").isNotNull(), F.struct("page_index", T.rstrip(F.col("markdown")).alias("md")))))
    body = pages.groupBy("doc_id").agg(ordered.alias("pages")).select("doc_id", T.strip(F.array_join(F.transform("pages", lambda p: p["md"]), "\n")).alias("body"))
    return body.select("doc_id", F.concat("body", F.lit("\n")).alias("markdown"))


def stats(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts by document: pages, failed pages, characters of the final text, tokens and images."""
    counted = pages.groupBy("doc_id").agg(*_counts())
    return counted.join(documents.select("doc_id", F.length("markdown").cast("long").alias("chars")), "doc_id")


def failed_pages(pages: DataFrame) -> DataFrame:
    """The failed pages of each document that has some, joined by commas in page order."""
    failed = pages.where(F.col("error").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list("page_index")).alias("p"))
    return failed.select("doc_id", F.array_join(F.transform("p", lambda x: x.cast("string")), ", ").alias("failed_pages"))


def attach_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """pages with the array of their images' paths in order; pages without images, failed ones too, get an empty array."""
    listed = images.groupBy("doc_id", "page_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("image_index", "path"))), lambda x: x["path"]).alias("images"))
    return pages.join(listed, ["doc_id", "page_index"], "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def backoff(attempt: Column) -> Column:
    """Seconds to wait after an attempt: 1, 2, 4, then 8."""
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(8.0)).cast("long")


def with_rotation(attempts: DataFrame) -> DataFrame:
    """Adds rotation: the turn an attempt is made with, which is the sum of the corrections of earlier invalid attempts."""
    before = Window.partitionBy("doc_id", "page_index").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    turned = F.sum(F.when(F.col("outcome") == "invalid", F.col("correction")).otherwise(0)).over(before)
    return attempts.withColumn("rotation", F.pmod(F.coalesce(turned, F.lit(0)), F.lit(360)).cast("int"))


def reduce_attempts(attempts: DataFrame, max_attempts: int = 8, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each page from its attempt log (outcome: valid, invalid, error or fatal).

    The first valid attempt wins; else the last one of wrong rotation, with its own number; else the page failed: attempts
    then counts all tries, error is the last one's, and tokens are those of a fatal response. Nothing counts after a valid
    or fatal attempt, or beyond ``max_attempts``. Columns that are ``carried`` come from the attempt that was kept (failed: null).
    """
    page = Window.partitionBy("doc_id", "page_index")
    ends = F.when(F.col("outcome").isin("valid", "fatal"), F.col("attempt")).otherwise(max_attempts)
    rotated = with_rotation(attempts)
    seen = rotated.withColumn("stop", F.min(ends).over(page)).where(F.col("attempt") <= F.col("stop"))
    fields = F.struct("attempt", "outcome", "rotation", "error", "prompt_tokens", "completion_tokens", *carried)
    best = lambda outcome: F.max_by(F.when(F.col("outcome") == outcome, fields), F.when(F.col("outcome") == outcome, F.col("attempt")))
    r = seen.groupBy("doc_id", "page_index").agg(best("valid").alias("v"), best("invalid").alias("i"), best("fatal").alias("f"), F.max_by("error", "attempt").alias("last"), F.max("attempt").alias("tries"))
    kept = F.coalesce("v", "i")
    return r.select(
        "doc_id", "page_index",
        F.when(F.col("v").isNotNull(), "valid").when(F.col("i").isNotNull(), "retained").otherwise("failed").alias("status"),
        F.coalesce(kept["attempt"], "tries").alias("attempts"), F.coalesce(kept["rotation"], F.lit(0)).alias("applied_rotation"),
        F.when(kept.isNull(), F.col("last")).alias("error"),
        F.coalesce(F.when(kept.isNull(), F.col("f.prompt_tokens")).otherwise(kept["prompt_tokens"]), F.lit(0)).cast("long").alias("prompt_tokens"),
        F.coalesce(F.when(kept.isNull(), F.col("f.completion_tokens")).otherwise(kept["completion_tokens"]), F.lit(0)).cast("long").alias("completion_tokens"),
        *(kept[c].alias(c) for c in carried),
    )
