"""Vectors worked out by hand, one for each rule."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import layout, text
from pagemill.functions import procedural as P


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'int'}" for n, v in zip(names, values)))
    return df.select(make(*(F.col(n) for n in names)).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "body", "meta"),
    [
        ("---\nprimary_language: en\nis_rotation_valid: False\nrotation_correction: 90\nis_table: yes\nis_diagram: 0\n---\n# T\n", "# T", ("en", False, 90, True, False)),
        ("---\n---\nX", "---\n---\nX", (None, True, 0, False, False)),
        ("  Null ", "", (None, True, 0, False, False)),
        ("```markdown\n# A\n```", "# A", (None, True, 0, False, False)),
        ("```", "```", (None, True, 0, False, False)),
    ],
)
def test_front_matter(spark, given, body, meta):
    header, rest = text.front_matter(F.col("c0"))
    row = spark.createDataFrame([(given,)], "c0 string").select(text.normalised_body(rest).alias("b"), text.metadata(header).alias("m")).first()
    assert row.b == body and tuple(row.m) == meta


@pytest.mark.parametrize(("given", "want"), [("-90", 90), ("450", 90), ("45", 0), ("x", 0), ("180 or 90", 180)])
def test_rotation(spark, given, want):
    assert one(spark, text.rotation, given) == want


@pytest.mark.parametrize(("given", "want"), [("null", None), ("en", "en"), ("abcdefghijklmnopqrst", "abcdefghijklmnop"), ("", None)])
def test_language(spark, given, want):
    assert one(spark, text.language, given) == want


@pytest.mark.parametrize(("given", "want"), [("$$x$$", "$$x$$"), ("\\[ x \\]", "$$\nx\n$$"), ("a $x$ \\b", "a $x$ \\b"), ("\\frac{1}{2}", "$$\n\\frac{1}{2}\n$$"), ("x+1", "x+1"), (" ", "")])
def test_formula(spark, given, want):
    assert one(spark, text.formula, given) == want


def test_cell_text(spark):
    assert [one(spark, text.cell_text, x) for x in ("`$x$`", "`$`", None)] == ["$x$", "$", ""]


def test_grounding(spark):
    given = "<|ref|>title<|/ref|><|det|>[[1,2,3,4]]<|/det|>\n# T\n<|ref|>Image<|/ref|><|det|>[[1]]<|/det|>\n\n\n\nx \\coloneqq y"
    assert one(spark, text.clean_grounding, given) == "# T\n\n![Picture](image.png)\n\nx := y"


CELLS = r'[{"category":"Page-header","bbox":[0,0,1,1],"text":"H"},{"category":"Picture","bbox":[10,20,110,70.9]},{"category":"Formula","text":"\\alpha"},{"category":"Text","text":"T"}]'


def test_layout(spark):
    made = layout.cells(F.col("c0"))
    row = spark.createDataFrame([(CELLS,)], "c0 string").select(layout.markdown(made).alias("md"), layout.metadata(made).alias("m")).first()
    assert row.md == "H\n\n![Picture](page_10_20_100_50.png)\n\n$$\n\\alpha\n$$\n\nT" and tuple(row.m) == (False, True)
    assert one(spark, lambda c: layout.markdown(layout.cells(c)), '[{"text":null,"content":"x"}]') == ""


PLACED = "A ![Picture](image.png) B ![x](http://h/i.png) ![Chart](page_1_2_3_4.png) ![]()"


@pytest.mark.parametrize(
    ("given", "paths", "want"),
    [
        (PLACED, ["d/page-1-image-1.png", "d/page-1-image-2.png"], "A ![Page 1 image 1](d/page-1-image-1.png) B ![x](http://h/i.png) ![Chart](d/page-1-image-2.png)"),
        (PLACED, [], "A  B ![x](http://h/i.png)"),
        ("A", ["d/1.png", "d/2.png"], "A\n\n![Page 1 image 1](d/1.png)\n\n![Page 1 image 2](d/2.png)"),
    ],
)
def test_images(spark, given, paths, want):
    assert one(spark, lambda c, p: text.resolve_images(c, F.lit(0), p), given, paths) == want


def test_failed_page(spark):
    assert one(spark, lambda e: text.failed_page(F.lit(2), F.lit(8), e, "ns"), "a--b\n c") == "<!-- ns: page_index=2 pdf_page=3 conversion_failed_after_attempts=8 error=a- -b c -->"


def test_svg_and_json():
    assert P.svg_fragment('svg: <svg width="1"><g><rect/></g></svg> tail') == '<svg width="1"><g><rect/></g></svg>'
    assert P.svg_fragment('<svg><g><rect x="1"/><text>hi') == '<svg><g><rect x="1"/><text>hi</text></g></svg>'
    assert P.normal_cells('see [1] {"cells":[{"text":"a"}]}', False) is None
    assert P.bounded_blocks(1632, 2112, 28, 50176, 6291456) == (1624, 2100) and P.bounded_blocks(4000, 3000, 28, 50176, 6291456) == (2884, 2156)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<div data-label="Page-Header"><p>h</p></div><div data-label="Section-Header"><h2>T</h2></div><div data-label="Table"><table><tr><td>1</td></tr></table></div>', ("## T\n\n<table><tr><td>1</td></tr></table>", True, False)),
        ('<div data-label="Text"><p><math>x</math> <img alt="a"></p></div>', ("$x$", False, False)),
        ('<div data-label="Image"><img alt="a"></div>', ("![a]()", False, True)),
        ('<div data-label="Blank-Page"></div>', ("", False, False)),
        ("<ul><li>a_b</li><li>c</li></ul>", ("- a\\_b\n- c", False, False)),
    ],
)
def test_html(html, want):
    assert P.html_page(html) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('<div data-label="Text"></div>', ""),
        ('<div data-label="Text" data-bbox="1 2 3 4"><p></p></div>', "<p></p>"),
        ('<div data-label="Blank-Page">x</div>', ""),
        ('<div data-label="Text"><p>a</p></div><div data-label="Text"></div>', "a"),
    ],
)
def test_html_blocks_without_text(given, want):
    assert P.html_page(given)[0] == want


@pytest.mark.parametrize("given", ["```\r\na\r\nb\r\n```", "```md\na\x0bb\n```", " ```\na b\n```\n"])
def test_line_ends_of_fences(spark, given):
    assert one(spark, text.strip_outer_code_fence, given) == P.unfenced(given) == "a\nb"
