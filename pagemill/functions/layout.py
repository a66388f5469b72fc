"""Layout cells (category, bbox, text) to Markdown and page metadata, as Column builders over JSON read as variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

CELL = "array<struct<category: string, bbox: array<double>, text: string, svg: string>>"


def cells(json: Column) -> Column:
    """The cells of a clean JSON array of objects; null for anything else.

    Whether the key ``text`` is there decides, not whether it has a value: a null text hides ``content``.
    """
    items = F.try_parse_json(json).try_cast("array<variant>")
    get = F.try_variant_get

    def cell(v: Column) -> Column:
        said = F.when(F.variant_get(v, "$.text", "variant").isNotNull(), get(v, "$.text", "string")).otherwise(get(v, "$.content", "string"))
        return F.struct(
            T.strip(F.coalesce(get(v, "$.category", "string"), F.lit(""))).alias("category"), get(v, "$.bbox", "array<double>").alias("bbox"),
            F.coalesce(said, F.lit("")).alias("text"), F.lit(None).cast("string").alias("svg"),
        )

    return F.transform(items, cell)


def markdown(cells: Column) -> Column:
    """All cells in order: pictures as SVG or placeholders, formulas as display math, other text as it is."""

    def chunk(c: Column) -> Column:
        said = T.cell_text(c["text"])
        return F.when(c["category"] == "Picture", F.coalesce(c["svg"], T.picture(c["bbox"]))).when((c["category"] == "Formula") & (said != ""), T.formula(said)).otherwise(said)

    return T.strip(F.array_join(F.filter(F.transform(cells, chunk), lambda x: x != ""), "\n\n"))


#: Cells that are no content of a page, by the family of categories.
OUTSIDE = {"plain": ("Page-header", "Page-footer"), "lower": ("header", "footer", "page_footnote")}


def filtered_markdown(cells: Column) -> Column:
    """The other family: lower-case categories, without headers, footers and footnotes; pictures only by their text."""

    def chunk(c: Column) -> Column:
        said = T.cell_text(c["text"])
        return F.when((F.lower(c["category"]) == "formula") & (said != ""), T.formula(said)).otherwise(said)

    inside = F.filter(cells, lambda c: ~F.lower(c["category"]).isin(*OUTSIDE["lower"]))
    return T.strip(F.array_join(F.filter(F.transform(inside, chunk), lambda x: x != ""), "\n\n"))


def metadata(cells: Column, family: str = "plain") -> Column:
    """is_table and is_diagram: at least half (rounded down, one at least) of the content cells are tables, or pictures."""
    table, diagram = ("Table", "Picture") if family == "plain" else ("table", "figure")
    names = F.transform(cells, lambda c: c["category"] if family == "plain" else F.lower(c["category"]))
    names = F.filter(names, lambda x: (x != "") & ~x.isin(*OUTSIDE[family]))
    least = F.greatest(F.lit(1), F.floor(F.size(names) / 2))
    most = lambda name: F.size(F.filter(names, lambda x: x == name)) >= least
    return F.struct(most(table).alias("is_table"), most(diagram).alias("is_diagram"))
