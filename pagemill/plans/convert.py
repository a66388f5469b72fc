"""From captured page responses to documents: parse, reduce attempts, place images, assemble, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import pages as P
from ..sources.profiles import MODELS
from .config import Conversion


def page_results(responses: DataFrame, config: Conversion = Conversion()) -> DataFrame:  # noqa: B008
    """One row for each page from attempts (doc_id, page_index, attempt, parser, raw_response, error, fatal, tokens).

    A response is parsed once; its rotation flag makes it valid or invalid, and the log of attempts is reduced. A page
    that failed holds a comment, or the job stops if failures aren't allowed.
    """
    parser = tuple(m[2] for m in MODELS if m[0] == config.service)  # a service has one parser
    answered = P.parse(responses.where("error IS NULL").select("doc_id", "page_index", "attempt", "parser", "raw_response", "prompt_tokens", "completion_tokens"), parser)
    said = answered.select("doc_id", "page_index", "attempt", "markdown", "metadata", "prompt_tokens", "completion_tokens", F.when(F.col("metadata.is_rotation_valid"), "valid").otherwise("invalid").alias("outcome"), F.col("metadata.rotation_correction").alias("correction"), F.lit(None).cast("string").alias("error"))
    failed = responses.where("error IS NOT NULL").select("doc_id", "page_index", "attempt", "prompt_tokens", "completion_tokens", F.when(F.coalesce("fatal", F.lit(False)), "fatal").otherwise("error").alias("outcome"), F.lit(0).alias("correction"), "error")
    log = said.unionByName(failed, allowMissingColumns=True)
    pages = D.reduce_attempts(log, config.max_page_attempts, carried=("markdown", "metadata"))
    lost = _lost_page(config)
    return pages.withColumn("markdown", F.when(F.col("status") == "failed", lost).otherwise(F.col("markdown"))).withColumn("metadata", F.coalesce("metadata", T.metadata(F.lit(None).cast("string"))))


def _lost_page(config: Conversion):
    comment = T.failed_page(F.col("page_index"), F.col("attempts"), F.coalesce("error", F.lit("unknown error")), config.namespace)
    return comment if config.allow_page_failures else F.raise_error(F.concat(F.lit("page failed: "), F.col("page_index").cast("string"), F.lit(" "), F.coalesce("error", F.lit("")))).cast("string")


def convert_all(responses: DataFrame, images: DataFrame | None = None, config: Conversion = Conversion()) -> DataFrame:  # noqa: B008
    """Documents (doc_id, markdown) with their statistics, from one pass over the responses."""
    pages = page_results(responses, config)
    if images is not None:
        placed = D.attach_images(pages, images)
        # Failed pages, too: their images follow the comment.
        pages = placed.withColumn("markdown", T.resolve_images(F.col("markdown"), F.col("page_index"), F.col("images")))
        pages = pages.withColumn("n_images", F.size("images").cast("long"))
    else:
        pages = pages.withColumn("n_images", F.lit(0).cast("long"))
    return D.assemble_with_stats(pages, markers=config.include_page_numbers, namespace=config.namespace)


def convert(responses: DataFrame, images: DataFrame | None = None, config: Conversion = Conversion()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Documents (doc_id, markdown) and their statistics. Where both are wanted, ``convert_all`` does the work once."""
    made = convert_all(responses, images, config)
    return made.select("doc_id", "markdown"), made.drop("markdown")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as pages of a Markdown parser: the first try of every fourth page fails, and system turns fail for good."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), "role", "text", F.length("text").cast("long").alias("prompt_tokens"), F.lit(3).cast("long").alias("completion_tokens"))
    tries = rows.withColumn("attempt", F.explode(F.when(F.col("role") == "system", F.array(F.lit(1), F.lit(2))).when(F.col("page_index") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    bad = (F.col("role") == "system") | ((F.col("page_index") % 4 == 0) & (F.col("attempt") == 1))
    return tries.select("doc_id", "page_index", "attempt", F.lit("markdown").alias("parser"), F.concat(F.lit("---\nis_table: yes\n---\n"), "text").alias("raw_response"), F.when(bad, "HTTPError: busy").alias("error"), ((F.col("role") == "system") & (F.col("attempt") == 2)).alias("fatal"), "prompt_tokens", "completion_tokens")


def convert_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way, with the statistics beside the text."""
    return convert_all(_log(spark, sf))


SQL = r"""WITH p AS (SELECT conv_id AS doc_id, turn, role = 'system' AS lost, length(text) AS tokens,
  CASE WHEN role = 'system' THEN '<!-- pagemill: page_index=' || turn || ' pdf_page=' || (turn + 1) || ' conversion_failed_after_attempts=2 error=HTTPError: busy -->' ELSE regexp_replace(text, '\A[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+\z', '', 'g') END AS md FROM conversations),
d AS (SELECT doc_id, coalesce(string_agg(md, chr(10) || chr(10) ORDER BY turn) FILTER (md <> ''), '') AS body, count(*) AS pages, count(*) FILTER (lost) AS failed_pages, CAST(sum(tokens) AS BIGINT) AS prompt_tokens, count(*) * 3 AS completion_tokens FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN body = '' THEN '' ELSE body || chr(10) END AS markdown, pages, failed_pages, prompt_tokens, completion_tokens, CAST(0 AS BIGINT) AS extracted_images, CAST(CASE WHEN body = '' THEN 0 ELSE length(body) + 1 END AS BIGINT) AS chars FROM d"""

QUERIES = {"convert_documents": (convert_documents, SQL)}
