"""Queries that parse page responses. Responses are made from documents, as the tables hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .sql import rstrip, strip


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


FENCE_IN = "CASE doc_id % 4 WHEN 0 THEN '```markdown\n' || text || '\n```\n' WHEN 1 THEN ' ' || text || ' ' WHEN 2 THEN '```' ELSE ' Null ' END"
FENCE_SQL = FENCE_IN.replace("\n", "' || chr(10) || '")


def strip_code_fence(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(FENCE_IN.replace("\n", "\\n"))
    return _docs(spark, sf).select("doc_id", T.strip_outer_code_fence(raw).alias("unfenced"), T.normalised_body(raw).alias("body"))


STRIP_FENCE = f"""WITH r AS (SELECT doc_id, text, {FENCE_SQL} AS raw FROM documents),
u AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE raw END AS unfenced FROM r)
SELECT doc_id, unfenced, CASE WHEN lower({strip('unfenced')}) = 'null' THEN '' ELSE {strip('unfenced')} END AS body FROM u"""

HEADER_IN = (
    "'---\nprimary_language: ' || CASE doc_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '\"' || lang || '\"' WHEN 2 THEN 'abcdefghijklmnopqrst' ELSE lang END || '\n# a comment: here\nis_rotation_valid: ' "
    "|| CASE doc_id % 3 WHEN 0 THEN 'False' WHEN 1 THEN 'maybe' ELSE 'yes' END || '\nrotation_correction: ' || CASE doc_id % 7 WHEN 0 THEN '-90' WHEN 1 THEN '450' WHEN 2 THEN '45' WHEN 3 THEN 'x' ELSE '180' END "
    "|| '\nis_table: no\nis_table: ' || CASE doc_id % 2 WHEN 0 THEN 'yes' ELSE 'null' END || '\nno value here\n---\n' || text"
)


def parse_front_matter(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("---\n---\n"), "text")).otherwise(F.expr(HEADER_IN.replace("\n", "\\n")))
    header, body = T.front_matter(raw)
    return _docs(spark, sf).withColumn("m", T.metadata(header)).select("doc_id", "m.*", T.normalised_body(body).alias("markdown"))


FRONT = rf"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '---' || chr(10) || '---' || chr(10) || text ELSE {HEADER_IN.replace(chr(10), "' || chr(10) || '")} END AS raw FROM documents),
h AS (SELECT doc_id, raw, regexp_matches(raw, '(?s)\A\s*---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)(.*)\z') AS has,
  regexp_extract(raw, '(?s)\A\s*---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)(.*)\z', 1) AS header, regexp_extract(raw, '(?s)\A\s*---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)(.*)\z', 2) AS body FROM r),
v AS (SELECT doc_id, has, CASE WHEN has THEN body ELSE raw END AS body,
  trim(regexp_extract(header, '(?:^|\n)primary_language: ([^\n]*)', 1), '"''') AS l, lower(regexp_extract(header, '(?:^|\n)is_rotation_valid: ([^\n]*)', 1)) AS v,
  regexp_extract(regexp_extract(header, '(?:^|\n)rotation_correction: ([^\n]*)', 1), '[0-9]+') AS c, lower(regexp_extract(header, '(?s).*\nis_table: ([^\n]*)', 1)) AS t FROM h)
SELECT doc_id, CASE WHEN NOT has OR lower(l) IN ('', 'null', 'none', 'false') THEN NULL ELSE left(l, 16) END AS primary_language,
  CASE WHEN has AND v IN ('false', 'no', '0', 'null', 'none') THEN false ELSE true END AS is_rotation_valid,
  CAST(CASE WHEN has AND c <> '' AND CAST(c AS BIGINT) % 360 IN (90, 180, 270) THEN CAST(c AS BIGINT) % 360 ELSE 0 END AS INTEGER) AS rotation_correction,
  coalesce(has AND t IN ('true', 'yes', '1'), false) AS is_table, false AS is_diagram, CASE WHEN lower({strip('body')}) = 'null' THEN '' ELSE {strip('body')} END AS markdown FROM v"""


STRICT_IN = (
    "CASE doc_id % 9 WHEN 0 THEN text WHEN 1 THEN 'Null' WHEN 2 THEN ' ' ELSE '---\nprimary_language: ' || lang || '\nis_rotation_valid: ' || CASE doc_id % 4 WHEN 0 THEN 'maybe' WHEN 1 THEN 'no' ELSE 'True' END "
    "|| '\nrotation_correction: ' || CASE doc_id % 5 WHEN 0 THEN '45' ELSE '90' END || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '\nis_table: yes' END || '\nis_diagram: off\n---\n' || CASE WHEN doc_id % 9 = 3 THEN ' NULL ' ELSE text END END"
)


def strict_front_matter(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by the strict reading of their headers, where a page without text is null."""
    meta, said = T.nullable_page(F.expr(STRICT_IN.replace("\n", "\\n")))
    return _docs(spark, sf).select("doc_id", meta.alias("m"), said.alias("markdown")).select("doc_id", "m.*", "markdown")


STRICT = rf"""WITH r AS (SELECT doc_id, lang, text, doc_id % 9 > 2 AND doc_id % 4 > 0 AND doc_id % 5 > 0 AND doc_id % 7 > 0 AS ok,
  {strip("CASE doc_id % 9 WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '' ELSE text END")} AS said FROM documents)
SELECT doc_id, CASE WHEN ok AND lower({strip('lang')}) NOT IN ('', 'null', 'none', 'false') THEN left({strip('lang')}, 16) END AS primary_language, NOT (ok AND doc_id % 4 = 1) AS is_rotation_valid, CAST(CASE WHEN ok THEN 90 ELSE 0 END AS INTEGER) AS rotation_correction,
  ok AS is_table, false AS is_diagram, CASE WHEN said <> '' AND lower(said) <> 'null' THEN said END AS markdown FROM r"""


def clean_grounding_refs(spark: SparkSession, sf: str) -> DataFrame:
    label = F.expr("CASE doc_id % 3 WHEN 0 THEN ' Image ' WHEN 1 THEN 'title' ELSE 'image' END")
    raw = F.concat(F.lit("<|ref|>"), label, F.lit("<|/ref|><|det|>[[1, 2,\n3, 4]]<|/det|>\n# "), "text", F.lit("\n\n\n\n<|ref|>a\nb<|/ref|><|det|>[[1]]<|/det|> x \\coloneqq y \\eqqcolon z" + T.END_OF_SENTENCE))
    return _docs(spark, sf).select("doc_id", T.clean_grounding(raw).alias("markdown"))


GROUNDING = rf"""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN '' ELSE chr(10) || '![Picture](image.png)' || chr(10) END || chr(10) || '# ' || text || repeat(chr(10), 4) || ' x := y =: z' AS t FROM documents)
SELECT doc_id, {strip(r"regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')")} AS markdown FROM r"""


def format_formula(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(r"CASE doc_id % 7 WHEN 0 THEN '$$x$$' WHEN 1 THEN concat('\\[ ', lang, ' \\]') WHEN 2 THEN 'a $x$ \\b' WHEN 3 THEN concat('\\frac{1}{', source, '}') WHEN 4 THEN '`$y$`' WHEN 5 THEN ' x+1 ' ELSE NULL END")
    return _docs(spark, sf).select("doc_id", T.formula(raw).alias("formula"), T.cell_text(raw).alias("cell"))


FORMULA = r"""SELECT doc_id,
  CASE doc_id % 7 WHEN 0 THEN '$$x$$' WHEN 1 THEN '$$' || chr(10) || lang || chr(10) || '$$' WHEN 2 THEN 'a $x$ \b' WHEN 3 THEN '$$' || chr(10) || '\frac{1}{' || source || '}' || chr(10) || '$$' WHEN 4 THEN '$y$' WHEN 5 THEN 'x+1' ELSE '' END AS formula,
  CASE doc_id % 7 WHEN 0 THEN '$$x$$' WHEN 1 THEN '\[ ' || lang || ' \]' WHEN 2 THEN 'a $x$ \b' WHEN 3 THEN '\frac{1}{' || source || '}' WHEN 4 THEN '$y$' WHEN 5 THEN 'x+1' ELSE '' END AS cell FROM documents"""


def picture_placeholder(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    box = F.when(F.col("l_linenumber") == 7, F.array(F.lit(1.0))).otherwise(F.array(F.col("l_quantity") - 10.5, F.col("l_tax") * 100, F.col("l_extendedprice") / 100, F.col("l_discount") * 1000))
    return rows.select("l_orderkey", "l_linenumber", T.picture(box).alias("placeholder"))


PICTURE = """WITH b AS (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity - 10.5) AS BIGINT) AS x1, CAST(trunc(l_tax * 100) AS BIGINT) AS y1, CAST(trunc(l_extendedprice / 100) AS BIGINT) AS x2, CAST(trunc(l_discount * 1000) AS BIGINT) AS y2 FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN '![Picture](image.png)' ELSE '![Picture](page_' || x1 || '_' || y1 || '_' || greatest(x2 - x1, 0) || '_' || greatest(y2 - y1, 0) || '.png)' END AS placeholder FROM b"""


def resolve_page_images(spark: SparkSession, sf: str) -> DataFrame:
    """Three placeholders, and one real image, around the text; a page has none to four images."""
    raw = F.concat(F.lit("A ![Picture](image.png) "), "text", F.lit(" ![x](http://h/i.png) ![Chart](page_1_2_3_4.png) ![]( )\n"))
    paths = F.expr("transform(filter(sequence(0, 4), i -> i > 0 AND i <= doc_id % 5), i -> concat('d/', i, '.png'))")
    page = (F.col("doc_id") % 9).cast("int")
    return _docs(spark, sf).select("doc_id", T.resolve_images(raw, page, paths).alias("markdown"), T.without_placeholders(raw).alias("without"))


IMAGES = f"""WITH r AS (SELECT doc_id, text, doc_id % 5 AS n, 'Page ' || (doc_id % 9 + 1) || ' image ' AS alt FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN {rstrip("'A  ' || text || ' ![x](http://h/i.png)  '")} ELSE {strip("'A ![' || alt || '1](d/1.png) ' || text || ' ![x](http://h/i.png) ' || CASE WHEN n > 1 THEN '![Chart](d/2.png)' ELSE '' END || ' ' || CASE WHEN n > 2 THEN '![' || alt || '3](d/3.png)' ELSE '' END")}
  || CASE WHEN n > 3 THEN chr(10) || chr(10) || '![' || alt || '4](d/4.png)' ELSE '' END END AS markdown, {rstrip("'A  ' || text || ' ![x](http://h/i.png)  '")} AS without FROM r"""

QUERIES = {
    "strip_code_fence": (strip_code_fence, STRIP_FENCE),
    "parse_front_matter": (parse_front_matter, FRONT),
    "strict_front_matter": (strict_front_matter, STRICT),
    "clean_grounding_refs": (clean_grounding_refs, GROUNDING),
    "format_formula": (format_formula, FORMULA),
    "picture_placeholder": (picture_placeholder, PICTURE),
    "resolve_page_images": (resolve_page_images, IMAGES),
}
