"""Text functions of the conversion engine, as Column builders.

White space is one explicit class everywhere (space, tab, CR, LF, FF, VT), so that results don't depend on a regex engine.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\r\n\f\x0B]"
FENCE = "```"


#: The same class as characters, for the trimming functions.
BLANK = " \t\r\n\f\x0B"
#: Ends of lines, as Python's ``splitlines`` has them.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def let(value: Column, use) -> Column:
    """``use(value)`` with value worked out once, however often it is used, also by those who take fields of the result."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANK))


def strip_outer_code_fence(c: Column) -> Column:
    """The inner lines of a text that is one fenced block, joined by line feeds; any other text as it is, not even stripped."""

    def inner(lines):
        fenced = (F.size(lines) >= 2) & (strip(F.element_at(lines, -1)) == FENCE)
        return F.when(fenced, F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 2), "\n")).otherwise(c)

    return let(strip(c), lambda s: F.when(F.startswith(s, F.lit(FENCE)), let(F.split(s, LINE_END, -1), inner)).otherwise(c))


def normalised_body(c: Column) -> Column:
    """Without an outer fence, stripped; the word null means nothing."""
    return let(c, lambda x: let(strip(strip_outer_code_fence(x)), lambda body: F.when(F.lower(F.substring(body, 1, 5)) == "null", F.lit("")).otherwise(body)))


#: A fenced header at the start; the header needs a line of its own before its end mark.
FRONT_MATTER = rf"(?s)\A{SPACES}*---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def front_matter(c: Column) -> tuple[Column, Column]:
    """Header (null if there is none) and body. Only the header is captured; the body is what comes after it."""
    whole = F.regexp_extract(c, FRONT_MATTER, 0)
    header = F.when(F.startswith(F.ltrim(c, F.lit(BLANK)), F.lit("---")) & c.rlike(FRONT_MATTER), F.regexp_extract(c, FRONT_MATTER, 1))
    return header, let(F.length(whole), lambda n: F.when(n > 0, F.substring(c, n + 1, F.length(c))).otherwise(c))


def mapping(header: Column) -> Column:
    """key and value (unquoted) of the ``key: value`` lines of a header, without comments."""
    lines = F.filter(F.transform(F.split(header, "\n", -1), strip), lambda x: ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit(":")))
    value = lambda x: F.regexp_replace(strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))), r"\A['\"]+|['\"]+\z", "")
    return F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), value(x).alias("value")))


def mapping_value(pairs: Column, key: str) -> Column:
    """The value of a key among ``mapping``'s pairs; of repeated keys the last counts."""
    return F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(-1))["value"]


def language(c: Column) -> Column:
    value = strip(c)
    return F.when(F.lower(value).isin("", "null", "none", "false"), F.lit(None)).otherwise(F.substring(value, 1, 16))


def flag(c: Column, default: bool) -> Column:
    value = F.lower(strip(c))
    return F.when(value.isin("true", "yes", "1"), True).when(value.isin("false", "no", "0", "null", "none"), False).otherwise(default)


def rotation(c: Column) -> Column:
    # Digits beyond the 36th can't be held; angles have a few.
    digits = F.regexp_extract(c, r"(\d{1,36})", 1)
    turn = F.coalesce(F.nullif(digits, F.lit("")).cast("decimal(36,0)"), F.lit(0).cast("decimal(36,0)")) % 360
    return F.when(turn.isin(0, 90, 180, 270), turn).otherwise(0).cast("int")


def metadata(header: Column) -> Column:
    """language, rotation_valid, rotation_correction, is_table, is_diagram from a header; a null header gives the defaults."""

    def fields(pairs):
        of = lambda key: mapping_value(pairs, key)
        return F.struct(
            language(of("primary_language")).alias("primary_language"),
            flag(of("is_rotation_valid"), True).alias("is_rotation_valid"),
            F.coalesce(rotation(of("rotation_correction")), F.lit(0)).alias("rotation_correction"),
            flag(of("is_table"), False).alias("is_table"),
            flag(of("is_diagram"), False).alias("is_diagram"),
        )

    return let(mapping(header), fields)


def strict_metadata(header: Column) -> Column:
    """The same fields if the header has all five and each is what it should be; else null.

    Truth is one of YAML's words for it, a rotation one of 0, 90, 180 and 270.
    """

    def fields(pairs):
        of = lambda key: mapping_value(pairs, key)
        truth = lambda key: F.when(F.lower(of(key)).isin("true", "yes", "on"), True).when(F.lower(of(key)).isin("false", "no", "off"), False)
        turned = F.when(of("rotation_correction").isin("0", "90", "180", "270"), of("rotation_correction").cast("int"))
        made = F.struct(
            language(of("primary_language")).alias("primary_language"), truth("is_rotation_valid").alias("is_rotation_valid"), turned.alias("rotation_correction"),
            truth("is_table").alias("is_table"), truth("is_diagram").alias("is_diagram"),
        )
        known = [of("primary_language"), truth("is_rotation_valid"), turned, truth("is_table"), truth("is_diagram")]
        return F.when(reduce(and_, (x.isNotNull() for x in known)), made)

    return let(mapping(header), fields)


def nullable_page(c: Column) -> tuple[Column, Column]:
    """metadata and markdown by the strict reading: a header that isn't right counts as none, and a page that says nothing, or null, is null."""
    header, body = front_matter(c)
    said = strip(F.when(header.isNotNull(), body).otherwise(c))
    return F.coalesce(strict_metadata(header), metadata(F.lit(None).cast("string"))), let(said, lambda x: F.when((x != "") & (F.lower(x) != "null"), x))


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


#: Marks of grounding-tagged responses.
END_OF_SENTENCE = "<｜end▁of▁sentence｜>"
PICTURE = "![Picture](image.png)"


def clean_grounding(c: Column) -> Column:
    """Markdown without reference and detection tags; those of images leave a placeholder."""
    det = r"<\|/ref\|><\|det\|>(?s:.*?)<\|/det\|>"
    c = F.replace(c, F.lit(END_OF_SENTENCE), F.lit(""))
    c = F.regexp_replace(c, rf"<\|ref\|>{SPACES}*(?i:image){SPACES}*{det}", "\n" + PICTURE.replace("[", r"\[").replace("]", r"\]") + "\n")
    c = F.regexp_replace(c, rf"<\|ref\|>(?s:.*?){det}", "")
    c = F.replace(F.replace(c, F.lit(r"\coloneqq"), F.lit(":=")), F.lit(r"\eqqcolon"), F.lit("=:"))
    return strip(collapse_blank_lines(c))


def cell_text(c: Column) -> Column:
    """Stripped; back-ticks around a formula in dollars go; null is empty."""
    value = strip(F.coalesce(c, F.lit("")))
    quoted = F.startswith(value, F.lit("`$")) & F.endswith(value, F.lit("$`"))
    return F.when(quoted, F.substring(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))).otherwise(value)


def formula(c: Column) -> Column:
    """A formula as display math, unless it is already marked as math."""
    v = cell_text(c)
    inner = lambda x: F.substring(x, F.lit(3), F.greatest(F.length(x) - 4, F.lit(0)))
    wrapped = lambda x: F.concat(F.lit("$$\n"), x, F.lit("\n$$"))
    return (
        F.when(v == "", v)
        .when(F.startswith(v, F.lit("$$")) & F.endswith(v, F.lit("$$")), v)
        .when(F.startswith(v, F.lit("\\[")) & F.endswith(v, F.lit("\\]")), wrapped(strip(inner(v))))
        .when(v.rlike(r"\$[^$]+\$") | v.rlike(r"(?s)\\\(.*?\\\)"), v)
        .when(F.contains(v, F.lit("\\")), wrapped(v))
        .otherwise(v)
    )


def picture(bbox: Column) -> Column:
    """A placeholder named after a box of four numbers (truncated towards zero); null or another size: the plain one."""
    at = lambda i: F.get(bbox, i).cast("double")
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")
    x1, y1, x2, y2 = (whole(at(i)) for i in range(4))
    known = (F.size(bbox) == 4) & ~F.exists(bbox, lambda v: v.isNull() | F.isnan(v.cast("double")))
    name = F.concat_ws("_", F.lit("page"), *(x.cast("string") for x in (x1, y1, F.greatest(x2 - x1, F.lit(0)), F.greatest(y2 - y1, F.lit(0)))))
    return F.when(known, F.concat(F.lit("![Picture]("), name, F.lit(".png)"))).otherwise(F.lit(PICTURE))


#: A Markdown image whose target a model invented: empty, image.png or page_*.png.
PLACEHOLDER = r"!\[([^\]]*)\]\(([ \t\r\n\f\x0B]*(?:image\.png|page_[^)]*?\.png)?[ \t\r\n\f\x0B]*)\)"


def without_placeholders(c: Column) -> Column:
    return rstrip(F.regexp_replace(c, PLACEHOLDER, ""))


def image_alt(alt: Column, page: Column, nth: Column) -> Column:
    """The given alt text, unless it says nothing; nth counts from 1, pages are zero-based."""
    value = strip(alt)
    return F.when(F.lower(value).isin("", "picture", "image"), F.concat(F.lit("Page "), (page + 1).cast("string"), F.lit(" image "), nth.cast("string"))).otherwise(value)


def resolve_images(c: Column, page: Column, paths: Column) -> Column:
    """Placeholders replaced by a page's images in order; what is left over goes, images left over are appended."""
    link = lambda alt, i: F.concat(F.lit("!["), image_alt(alt, page, i + 1), F.lit("]("), F.get(paths, i), F.lit(")"))
    parts = lambda body: F.struct(F.split(body, PLACEHOLDER, -1).alias("pieces"), F.regexp_extract_all(body, F.lit(PLACEHOLDER), F.lit(1)).alias("alts"))

    def placed(x):
        found = F.size(x["alts"])
        filled = F.array_join(F.transform(x["pieces"], lambda p, i: F.concat(p, F.when(i < F.least(found, F.size(paths)), link(F.get(x["alts"], i), i)).otherwise(F.lit("")))), "")
        rest = F.transform(F.slice(paths, found + 1, F.greatest(F.size(paths) - found, F.lit(0))), lambda p, i: link(F.lit(""), i + found))
        return strip(F.concat_ws("\n\n", rstrip(filled), F.when(F.size(rest) > 0, F.array_join(rest, "\n\n"))))

    return F.when(F.coalesce(F.size(paths), F.lit(0)) <= 0, without_placeholders(c)).otherwise(let(rstrip(c), lambda body: let(parts(body), placed)))


def page_marker(page: Column, namespace: str) -> Column:
    return F.concat(F.lit(f"<!-- {namespace}: page_index="), page.cast("string"), F.lit(" pdf_page="), (page + 1).cast("string"), F.lit(" -->"))


def failed_page(page: Column, attempts: Column, error: Column, namespace: str) -> Column:
    """A comment in place of a page that could not be converted."""
    said = F.replace(strip(F.regexp_replace(error, rf"{SPACES}+", " ")), F.lit("--"), F.lit("- -"))
    return F.concat(
        F.lit(f"<!-- {namespace}: page_index="), page.cast("string"), F.lit(" pdf_page="), (page + 1).cast("string"),
        F.lit(" conversion_failed_after_attempts="), attempts.cast("string"), F.lit(" error="), said, F.lit(" -->"),
    )


def error_text(kind: Column, message: Column) -> Column:
    """``kind: message``, ``kind`` without a message, or "unknown error"."""
    return F.when(F.coalesce(kind, F.lit("")) == "", F.lit("unknown error")).when(F.coalesce(message, F.lit("")) == "", kind).otherwise(F.concat(kind, F.lit(": "), message))


def prompt(template: Column, width: Column, height: Column, prefix: Column) -> Column:
    """The template with its sizes filled in, behind a prefix that is left as it is."""
    return F.concat(F.coalesce(prefix, F.lit("")), F.replace(F.replace(template, F.lit("{width}"), width.cast("string")), F.lit("{height}"), height.cast("string")))


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def output_path(path: Column, root: Column | None = None, base: str | None = None, out: str = "md") -> Column:
    """out/stem.md, or with the folders below ``base`` kept."""
    relative = F.regexp_replace(path, r"\A.*/", "") if base is None else F.when(F.startswith(path, F.lit(base.rstrip("/") + "/")), F.substring(path, F.lit(len(base.rstrip("/")) + 2), F.length(path))).otherwise(F.regexp_replace(path, r"\A.*/", ""))
    return F.concat(root if root is not None else F.lit(out), F.lit("/"), F.regexp_replace(relative, r"\.[^./]+\z", ""), F.lit(".md"))


def default_path(path: Column, first: Column, last: Column, out: str = "md") -> Column:
    """out/stem.p1-9.md for the pages from first to last, counted from 1."""
    return F.concat(F.lit(f"{out}/"), stem(path), F.lit(".p"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(".md"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\A.*/", ""), r"\.[^./]+\z", "")


def image_name(page: Column, image: Column) -> Column:
    """The name of an image that a page holds; both numbers count from 1."""
    return F.concat(F.lit("page-"), page.cast("string"), F.lit("-image-"), image.cast("string"), F.lit(".png"))


def png_name(path: Column, index: Column) -> Column:
    """The name of a rendered page; the index counts from 0."""
    return F.concat(stem(path), F.lit("-"), index.cast("string"), F.lit(".png"))


#: What an error says of a response's body, in code points.
BODY_SHOWN = 500


def http_error(status: Column, body: Column) -> Column:
    """``HTTP status: body``; only the start of a long body is shown, a null one is empty."""
    return F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), F.substring(F.coalesce(body, F.lit("")), 1, BODY_SHOWN))


def page_name(page: Column, total: Column) -> Column:
    """p0001, with as many digits as the largest page number needs, four at least."""
    digits = F.greatest(F.lit(4), F.length(total.cast("string")), F.length(page.cast("string")))
    return F.concat(F.lit("p"), F.lpad(page.cast("string"), digits, F.lit("0")))
