"""Page responses to page results: one branch for each parser, all in one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import procedural as P
from ..functions import text as T

#: Marks that open a block; the second form also fits ordinary prose, which is then cut the same way.
MARK = r"(?s)\A<\|det\|>([^<\s]+)(?:\s*\[[^\]]*\])?\s*<\|/det\|>\s*(.*)\z"
BARE_MARK = r"(?s)\A([^\s\[]+)\s+\[[^\]]*\]\s*;?\s*(.*)\z"
PICTURES = ("image", "figure", "picture")
PARSERS = ("markdown", "dots_layout_json", "infinity_layout_json", "deepseek_markdown", "unlimited_ocr", "svg", "chandra_html")


def segmented(c: Column) -> Column:
    """Lines cut into blocks at marks, without the marks and without blocks of pictures. One pass over the lines of a row."""

    def line(raw):
        form = lambda x, i: F.when(x.rlike(MARK), F.regexp_extract(x, MARK, i)).when(x.rlike(BARE_MARK), F.regexp_extract(x, BARE_MARK, i))
        return F.struct(F.lower(form(raw, 1)).alias("mark"), F.coalesce(T.strip(form(raw, 2)), raw).alias("text"))

    lines = F.transform(F.filter(F.transform(F.split(c, "\n", -1), T.rstrip), lambda x: x != ""), line)
    start = F.struct(F.lit(None).cast("string").alias("text"), F.lit(False).alias("skip"))

    def step(so_far, x):
        opens = x["mark"].isNotNull()
        skip = F.when(opens, x["mark"].isin(*PICTURES)).otherwise(so_far["skip"])
        gap = F.when(so_far["text"].isNull(), F.lit("")).when(opens, F.lit("\n\n")).otherwise(F.lit("\n"))
        return F.struct(F.when(skip, so_far["text"]).otherwise(F.concat(F.coalesce(so_far["text"], F.lit("")), gap, x["text"])).alias("text"), skip.alias("skip"))

    body = F.coalesce(F.aggregate(lines, start, step)["text"], F.lit(""))
    return T.strip(T.collapse_blank_lines(F.replace(T.strip(body), F.lit(T.END_OF_SENTENCE), F.lit(""))))


def segment_blocks(responses: DataFrame, key: list[str], column: str = "raw_response") -> DataFrame:
    """key and markdown of each row, also where rows share a key; a null response is empty."""
    return responses.select(*key, segmented(F.coalesce(F.col(column), F.lit(""))).alias("markdown"))


def parse(responses: DataFrame, parsers: tuple[str, ...] = PARSERS) -> DataFrame:
    """Adds metadata (a struct) and markdown to rows with doc_id, page_index, parser and raw_response.

    Each parser's branch sees only its own rows, so Python runs for the layouts and HTML only. A job that uses few parsers
    names them, and has no other branches in its plan; a response for any other parser raises.
    """
    defaults = T.metadata(F.lit(None).cast("string"))
    raw = F.coalesce("raw_response", F.lit(""))
    given = responses.withColumn("__raw", raw)
    of = lambda *names: given.where(F.col("parser").isin(*names))
    header, body = T.front_matter(F.col("__raw"))
    plain = of("markdown").withColumn("metadata", T.metadata(header)).withColumn("markdown", T.normalised_body(body))
    grounded = of("deepseek_markdown").withColumn("metadata", defaults).withColumn("markdown", T.clean_grounding(F.col("__raw")))
    svg = of("svg").withColumn("metadata", defaults).withColumn("markdown", F.coalesce(P.recover_svg("__raw"), T.normalised_body(F.col("__raw"))))
    cells = of("dots_layout_json", "infinity_layout_json").withColumn("__cells", F.from_json(P.recover_cells("__raw", F.col("parser") == "infinity_layout_json"), L.CELL))
    lower = F.col("parser") == "infinity_layout_json"
    flags = F.when(lower, L.metadata(F.col("__cells"), "lower")).otherwise(L.metadata(F.col("__cells")))
    said = F.when(lower, L.filtered_markdown(F.col("__cells"))).otherwise(L.markdown(F.col("__cells")))
    flagged = lambda c: defaults.withField("is_table", F.coalesce(c["is_table"], F.lit(False))).withField("is_diagram", F.coalesce(c["is_diagram"], F.lit(False)))
    laid = cells.withColumn("metadata", flagged(flags)).withColumn("markdown", F.coalesce(said, T.normalised_body(F.col("__raw")))).drop("__cells")
    html = of("chandra_html").withColumn("__page", P.convert_html("__raw"))
    html = html.withColumn("metadata", flagged(F.col("__page"))).withColumn("markdown", F.col("__page.markdown")).drop("__page")
    blocks = of("unlimited_ocr").withColumn("metadata", defaults).withColumn("markdown", segmented(F.col("__raw")))
    known = F.coalesce(F.col("parser").isin(*parsers), F.lit(False))
    other = given.where(~known).withColumn("metadata", defaults).withColumn("markdown", F.raise_error(F.concat(F.lit("unknown parser: "), F.coalesce("parser", F.lit("none")))).cast("string"))
    branches = {("markdown",): plain, ("deepseek_markdown",): grounded, ("svg",): svg, ("dots_layout_json", "infinity_layout_json"): laid, ("chandra_html",): html, ("unlimited_ocr",): blocks}
    out = other
    for names, branch in branches.items():
        if {*names} & {*parsers}:
            out = out.unionByName(branch)
    return out.drop("__raw")
