import duckdb
import pytest

from pagemill.functions import html as H
from pagemill.functions import procedural as P
from pagemill.plans import layouts, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("html", ["<div>" * 20_000 + "x", "<b><p>" * 20_000 + "y", "<ul><li>" * 3000 + "z", "<div>" * 20_000 + "</div>" * 20_000, "<table>" * 20_000, "</p>" * 100_000, "<blockquote>" * 3000 + "q"])
def test_depth(html):
    assert P.html_page(html)[0]


def test_intervals():
    page = H.Page("<div><p>a<b>b</p>c</div><ul><li>d<li>e</ul></x>f<br>")
    for i, tag in enumerate(page.tag):
        if tag:
            inside = range(i, page.end[i])
            # Elements lie wholly inside the one around them, one level deeper.
            assert all(page.end[j] <= page.end[i] for j in inside if page.tag[j] != "")
            assert all(page.depth[j] > page.depth[i] for j in range(i + 1, page.end[i]) if page.tag[j])
    assert page.raw(0, len(page.tag)) == "<div><p>a<b>b</b></p>c</div><ul><li>d<li>e</li></li></ul>f<br/>"
    assert [page.tag[i] for i in page.outermost("ul")] == ["ul"] and page.outermost("p") == []


def test_a_failing_page_keeps_its_content(monkeypatch):
    monkeypatch.setattr(H.Page, "markdown", lambda *_: 1 / 0)
    assert P.html_page('<div data-label="Text"><p>kept</p></div>')[0] == "<p>kept</p>"
    assert P.html_page("<p>whole</p>")[0] == "<p>whole</p>"


@pytest.mark.parametrize("name", ["html_to_markdown", "parse_all_parsers", "resize_by_profile", "source_metadata", "service_prompts", "skip_existing_bucketed", "block_resize", "image_dedup", "layout_metadata", "convert_documents", "recover_json", "hub_model_filter", "strict_front_matter"])
def test_like_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "part", "events", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = sorted(map(tuple, got.select(*columns).collect()), key=str)
    assert rows == sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=str) and rows


def test_cut_references_like_the_sql(spark, tmp_path):
    """Titles that end inside a reference, as some of ``pages`` do at larger sizes."""
    cuts = ["&", "&a", "&am", "&amp", "&amp;", "&q", "&quo", "&quot", "&quot;", "&lt", "&gt", "&copy", "&middot", "&ampquot", "&amp;quot", "&quotx", "&quotx;", "&nbsp", "&AMP", "&#39", "&#x27", "& b"]
    page = '<html><head><title>t</title></head><body><ul><li><a href="/x{0}">x{0}</a></li></ul><article><h1>token = {0}</h1><p><b>a &quot;b&quot; &amp;&amp; c{0}<br><p>{0}d</p></article><footer>&copy; e &middot; f</footer></body></html>'
    spark.createDataFrame([(i, page.format(x)) for i, x in enumerate(cuts)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT page_id, markdown, is_table, is_diagram FROM ({layouts.HTML}) ORDER BY page_id").fetchall()
    assert [tuple(x) for x in layouts.html_to_markdown(spark, str(tmp_path)).orderBy("page_id").collect()] == want and len(want) == len(cuts)


@pytest.mark.parametrize("odd", ["\xa0", "\x85", "\x1c", "\u2003", "\u2028", "\u3000"])
def test_white_space_like_the_sql(odd):
    """Only the explicit class is white space: other spaces are kept, wherever they are."""
    form = '<html><head></head><body><ul><li><a href="/{0}">{0}</a></li></ul><div class="ad">{0}</div><article><h1>{0}</h1><p><b>{0}<br><p>{0}</p><p><b>{0}<br></article><footer>&copy; {0}</footer></body></html>'
    pages = [form.format(x) for x in (f"a{odd}b", f"{odd}b", f"b{odd}", f"a{odd}{odd}b", odd)] + [form.format("a").replace("a<", f"a {odd} <").replace(f"a {odd} </a>", "a</a>")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(pages)))
    assert [P.html_page(x, unclosed=False)[0] for x in pages] == [x for x, in con.sql(f"SELECT markdown FROM ({layouts.HTML}) ORDER BY page_id").fetchall()]


def test_references_without_a_semicolon():
    # The parser of responses reads them, as the reference does; what stays HTML keeps them as they are.
    assert P.html_page("<p>&quot &amp &eacute; &#39; &x;</p>")[0] == '" & é \' &x;'
    assert P.html_page("<p>&quot &amp &eacute; &#39; &#x27; &x; &#39</p>", unclosed=False)[0] == "&quot & é ' ' &x; &#39"
    assert P.html_page('<p title="&quot"></p>', unclosed=False)[0] == '<p title="&quot"></p>'
    assert H.closed_references("&" * 100_000 + "&a" * 100_000 + "a" * 1_000_000).startswith("&&")


def test_every_parser_is_compared():
    assert "parse_all_parsers" in registry.ORACLE and "html_to_markdown" in registry.ORACLE and layouts.PARSE in layouts.PARSE_ALL
