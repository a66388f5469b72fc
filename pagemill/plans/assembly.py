"""Queries that build documents from pages. Conversations stand in for documents, their turns for pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from .sql import rstrip, strip


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every third system turn is blank, every other one failed."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return rows.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"),
        F.when((F.col("role") == "system") & (F.col("conv_id") % 3 == 0), " \n ").otherwise(F.concat(F.lit("\n"), "text", F.lit(" \n"))).alias("markdown"),
        F.when((F.col("role") == "system") & (F.col("conv_id") % 2 == 0), F.lit("timeout--of\n the page")).alias("error"),
        F.length("text").cast("long").alias("prompt_tokens"), (F.length("text") % 7).cast("long").alias("completion_tokens"), (F.col("turn") % 3).cast("long").alias("n_images"),
    )


PAGES = """p AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_index,
  CASE WHEN role = 'system' AND conv_id % 3 = 0 THEN ' ' || chr(10) || ' ' ELSE chr(10) || text || ' ' || chr(10) END AS markdown,
  CASE WHEN role = 'system' AND conv_id % 2 = 0 THEN 'timeout--of' || chr(10) || ' the page' END AS error,
  length(text) AS prompt_tokens, length(text) % 7 AS completion_tokens, turn % 3 AS n_images FROM conversations)"""

BODY = f"""{PAGES}, b AS (SELECT doc_id, coalesce({strip("string_agg(markdown, chr(10) || chr(10) ORDER BY page_index) FILTER (%s <> '')" % strip("markdown"))}, '') AS body FROM p GROUP BY doc_id)"""


def assemble_document(spark: SparkSession, sf: str) -> DataFrame:
    return D.assemble(pages(spark, sf))


ASSEMBLE = f"WITH {BODY} SELECT doc_id, CASE WHEN body = '' THEN '' ELSE body || chr(10) END AS markdown FROM b"


def assemble_document_marked(spark: SparkSession, sf: str) -> DataFrame:
    return D.assemble(pages(spark, sf), markers=True)


MARKED = f"""WITH {PAGES}, m AS (SELECT doc_id, page_index,
  {rstrip(f"'<!-- {D.NAMESPACE}: page_index=' || page_index || ' pdf_page=' || (page_index + 1) || ' -->' || chr(10) || chr(10) || markdown")} AS md FROM p)
SELECT doc_id, {strip("string_agg(md, chr(10) || chr(10) ORDER BY page_index)")} || chr(10) AS markdown FROM m GROUP BY doc_id"""


def assemble_document_compact(spark: SparkSession, sf: str) -> DataFrame:
    return D.assemble_compact(pages(spark, sf))


COMPACT = f"WITH {PAGES} SELECT doc_id, {strip('string_agg(%s, chr(10) ORDER BY page_index)' % rstrip('markdown'))} || chr(10) AS markdown FROM p GROUP BY doc_id"


def document_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf)
    return D.stats(p, D.assemble(p))


STATS = f"""WITH {BODY} SELECT doc_id, count(*) AS pages, count(error) AS failed_pages, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(n_images) AS BIGINT) AS extracted_images,
  CAST(any_value(CASE WHEN body = '' THEN 0 ELSE length(body) + 1 END) AS BIGINT) AS chars FROM p JOIN b USING (doc_id) GROUP BY doc_id"""


def failed_page_list(spark: SparkSession, sf: str) -> DataFrame:
    return D.failed_pages(pages(spark, sf))


FAILED = f"WITH {PAGES} SELECT doc_id, string_agg(CAST(page_index AS VARCHAR), ', ' ORDER BY page_index) AS failed_pages FROM p WHERE error IS NOT NULL GROUP BY doc_id"


def failed_page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf).where("error IS NOT NULL")
    said = T.error_text(F.when(F.col("doc_id") % 4 == 0, F.lit("HTTPError")).otherwise(F.lit("")), F.col("error"))
    return p.select("doc_id", "page_index", T.failed_page(F.col("page_index"), F.lit(8), said, D.NAMESPACE).alias("markdown"))


FAILED_MD = f"""WITH {PAGES} SELECT doc_id, page_index, '<!-- {D.NAMESPACE}: page_index=' || page_index || ' pdf_page=' || (page_index + 1) || ' conversion_failed_after_attempts=8 error='
  || CASE WHEN doc_id % 4 = 0 THEN 'HTTPError: timeout- -of the page' ELSE 'unknown error' END || ' -->' AS markdown FROM p WHERE error IS NOT NULL"""


def markdown_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as one Markdown file each, and read back."""
    from ..sources import files
    from ..sources.places import shared_folder

    folder = shared_folder(spark, "markdown")
    documents = D.assemble(pages(spark, sf)).select(F.concat(F.lit("md/"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("output"), "markdown")
    files.write_files(documents, folder)
    return files.read_files(spark, folder).select("output", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


FILES = f"""WITH {BODY}, d AS (SELECT 'md/' || (doc_id % 7) || '/' || doc_id || '.md' AS output, CASE WHEN body = '' THEN '' ELSE body || chr(10) END AS markdown FROM b)
SELECT output, CAST(octet_length(encode(markdown)) AS BIGINT) AS bytes, sha256(markdown) AS sha256 FROM d"""


def attach_page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Images with their numbers in the page, for turns that have some."""
    p = pages(spark, sf)
    images = p.select("doc_id", "page_index", F.explode(F.expr("transform(sequence(1, greatest(int(n_images), 1)), i -> struct(i AS image_index, n_images >= i AS has))")).alias("i")).where("i.has")
    named = images.select("doc_id", "page_index", F.col("i.image_index").alias("image_index"), F.concat(F.lit("page-"), (F.col("page_index") + 1).cast("string"), F.lit("-image-"), F.col("i.image_index").cast("string"), F.lit(".png")).alias("path"))
    out = D.attach_images(p.select("doc_id", "page_index", "error"), named)
    return out.select("doc_id", "page_index", F.size("images").cast("long").alias("n_images"), F.array_join("images", "|").alias("images"))


ATTACH = f"""WITH {PAGES} SELECT doc_id, page_index, CAST(n_images AS BIGINT) AS n_images,
  coalesce(list_aggregate(list_transform(range(1, n_images + 1), lambda i: 'page-' || (page_index + 1) || '-image-' || i || '.png'), 'string_agg', '|'), '') AS images FROM p"""


LOG = ("outcome", "correction", "error", "prompt_tokens", "completion_tokens")


def _outcomes(events: DataFrame) -> DataFrame:
    """Events as outcomes of attempts."""
    kind = F.expr("CASE event_type WHEN 'view' THEN 'invalid' WHEN 'signup' THEN 'valid' WHEN 'purchase' THEN 'fatal' ELSE IF(event_id % 3 = 0, 'invalid', 'error') END")
    return events.withColumns({
        "outcome": kind, "correction": ((F.col("event_id") % 4) * 90).cast("int"), "error": F.when(kind.isin("error", "fatal"), F.concat(F.lit("e"), F.col("event_id").cast("string"))),
        "prompt_tokens": F.col("event_id") % 100, "completion_tokens": F.col("event_id") % 11,
    })


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user, in their order, are the attempts at one page."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _outcomes(spark.read.parquet(f"{sf}/events.parquet")).withColumn("attempt", F.row_number().over(order))
    return rows.select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page_index"), "attempt", *LOG)


def reduce_attempts_stream(spark: SparkSession, sf: str) -> DataFrame:
    """As ``reduce_attempts``, from the events as a stream whose state is kept for each page."""
    from ..sources.places import shared_folder
    from ..streaming import attempts as S

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")  # a pattern may be one file
    rows = _outcomes(arriving).select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page_index"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), *LOG)
    return S.latest(S.drain(rows, shared_folder(spark, "attempts")))


ATTEMPTS = """a AS (SELECT doc_id, 0 AS page_index, attempt, outcome, correction, CASE WHEN outcome IN ('error', 'fatal') THEN 'e' || event_id END AS error, event_id % 100 AS prompt_tokens, event_id % 11 AS completion_tokens FROM (
  SELECT user_id AS doc_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt, CAST(event_id % 4 * 90 AS INTEGER) AS correction,
    CASE event_type WHEN 'view' THEN 'invalid' WHEN 'signup' THEN 'valid' WHEN 'purchase' THEN 'fatal' ELSE CASE WHEN event_id % 3 = 0 THEN 'invalid' ELSE 'error' END END AS outcome FROM events)),
r AS (SELECT *, CAST(coalesce(sum(CASE WHEN outcome = 'invalid' THEN correction ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 360 AS INTEGER) AS rotation FROM a)"""


def cumulative_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Every attempt."""
    return D.with_rotation(attempts(spark, sf)).select("doc_id", "attempt", "rotation", D.backoff(F.col("attempt")).alias("wait"))


ROTATION = f"WITH {ATTEMPTS} SELECT doc_id, attempt, rotation, CAST(CASE WHEN attempt > 3 THEN 8 ELSE pow(2, attempt - 1) END AS BIGINT) AS wait FROM r"


def reduce_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return D.reduce_attempts(attempts(spark, sf))


REDUCE = f"""WITH {ATTEMPTS}, s AS (SELECT r.* FROM r JOIN (SELECT doc_id, min(CASE WHEN outcome IN ('valid', 'fatal') THEN attempt ELSE 8 END) AS stop FROM r GROUP BY doc_id) USING (doc_id) WHERE attempt <= stop),
best AS (SELECT doc_id, coalesce(max(attempt) FILTER (outcome = 'valid'), max(attempt) FILTER (outcome = 'invalid')) AS k, max(attempt) AS tries, arg_max(error, attempt) AS last FROM s GROUP BY doc_id)
SELECT b.doc_id, 0 AS page_index, CASE WHEN s.outcome = 'valid' THEN 'valid' WHEN k IS NOT NULL THEN 'retained' ELSE 'failed' END AS status, coalesce(k, tries) AS attempts,
  CASE WHEN k IS NULL THEN 0 ELSE s.rotation END AS applied_rotation, CASE WHEN k IS NULL THEN last END AS error,
  CASE WHEN k IS NOT NULL OR s.outcome = 'fatal' THEN s.prompt_tokens ELSE 0 END AS prompt_tokens, CASE WHEN k IS NOT NULL OR s.outcome = 'fatal' THEN s.completion_tokens ELSE 0 END AS completion_tokens
FROM best b JOIN s ON s.doc_id = b.doc_id AND s.attempt = coalesce(k, tries)"""

QUERIES = {
    "assemble_document": (assemble_document, ASSEMBLE),
    "assemble_document_marked": (assemble_document_marked, MARKED),
    "assemble_document_compact": (assemble_document_compact, COMPACT),
    "document_stats": (document_stats, STATS),
    "failed_page_list": (failed_page_list, FAILED),
    "failed_page_markdown": (failed_page_markdown, FAILED_MD),
    "markdown_files": (markdown_files, FILES),
    "attach_page_images": (attach_page_images, ATTACH),
    "cumulative_rotation": (cumulative_rotation, ROTATION),
    "reduce_attempts": (reduce_attempts, REDUCE),
    "reduce_attempts_stream": (reduce_attempts_stream, REDUCE),
}
