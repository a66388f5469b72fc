import re

import pytest

from pagemill.plans import config, registry
from pagemill.sources import rendering


@pytest.mark.parametrize(
    "make",
    [
        lambda: config.ImageExtraction(min_width=0), lambda: config.ImageExtraction(bbox_tolerance=-1), lambda: config.Render(target_longest_dim=None), lambda: config.Render(min_pixels=4),
        lambda: config.Render(resize_factor=28, min_pixels=9, max_pixels=4), lambda: config.Conversion(timeout=0), lambda: config.Conversion(concurrency=0), lambda: config.Conversion(max_page_attempts=0),
    ],
)
def test_settings(make):
    with pytest.raises(ValueError):
        make()


def test_key(monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "a")
    monkeypatch.setenv("API_KEY", "b")
    assert config.api_key("c") == "c" and config.api_key() == "a"
    monkeypatch.delenv("OPENAI_API_KEY")
    assert config.api_key() == "b"


@pytest.mark.parametrize("name", ["assemble_document", "convert_documents", "page_selector", "image_dedup", "html_to_markdown"])
def test_queries(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_no_training_data_imports():
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for path in (root / "pagemill").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"\b(from|import)\s+[.\w]*\bllm\b", path.read_text())


@pytest.mark.skipif(rendering.available(), reason="the library is there")
def test_rendering_says_what_is_missing(spark):
    with pytest.raises(Exception, match="pymupdf"):
        rendering.page_counts(spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")).collect()


def test_every_attempt_has_its_rotation(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    for name in ("cumulative_rotation", "reduce_attempts"):
        got = sorted(map(tuple, registry.QUERIES[name](spark, sf).collect()), key=str)
        assert got == sorted(con.execute(registry.ORACLE[name]).fetchall(), key=str)
        if name == "cumulative_rotation":
            assert len(got) == spark.read.parquet(f"{sf}/events.parquet").count()
