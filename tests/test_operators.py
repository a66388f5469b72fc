import pytest
from pyspark.sql import functions as F

from pagemill.functions import geometry, text
from pagemill.operators import documents, pages, planning, sinks
from pagemill.sources import profiles, responses
from pagemill.streaming import ingest


@pytest.mark.parametrize(
    ("log", "want"),
    [
        ([("valid", 0)], ("valid", 1, 0, None)),
        ([("invalid", 90), ("invalid", 90), ("valid", 0)], ("valid", 3, 180, None)),
        ([("invalid", 90)] + [("error", 0)] * 7, ("retained", 1, 0, None)),
        ([("invalid", 90), ("fatal", 0)], ("retained", 1, 0, None)),
        ([("error", 0), ("fatal", 0)], ("failed", 2, 0, "e2")),
        ([("error", 0)] * 8, ("failed", 8, 0, "e8")),
        ([("invalid", 0)] * 8, ("retained", 8, 0, None)),
        ([("valid", 0), ("fatal", 0)], ("valid", 1, 0, None)),
    ],
)
def test_attempts(spark, log, want):
    rows = [("d", 0, i, kind, turn, f"e{i}" if kind in ("error", "fatal") else None, i, i) for i, (kind, turn) in enumerate(log, 1)]
    df = spark.createDataFrame(rows, "doc_id string, page_index int, attempt int, outcome string, correction int, error string, prompt_tokens long, completion_tokens long")
    got = documents.reduce_attempts(df).first()
    assert (got.status, got.attempts, got.applied_rotation, got.error) == want
    assert got.prompt_tokens == (want[1] if want[0] != "failed" or "fatal" in dict(log) else 0)


@pytest.mark.parametrize(
    ("spec", "zero", "pages_", "error"),
    [("3,1-2,2-", False, [2, 0, 1, 3], None), ("-2", False, [0, 1], None), ("0-2", True, [0, 1, 2], None), ("0", False, None, "out of bounds"), ("3-2", False, None, "start after end"), ("5-", False, None, "start after end"), ("-", False, None, "empty range"), ("", False, None, "no selectors"), ("a", False, None, "not a number")],
)
def test_selectors(spark, spec, zero, pages_, error):
    row = planning.select_pages(spark.createDataFrame([(spec, 4, zero)], "spec string, total_pages int, zero_based boolean")).first()
    assert (row.pages, row.error) == (pages_, error)


@pytest.mark.parametrize(("profile", "w", "h", "want"), [("GLM", 1700, 2200, (616, 784)), ("GLM", 10, 10, (84, 84)), ("INFINITY", 2550, 3300, (2560, 3296)), ("DOTS", 42, 70, (42, 70))])
def test_smart_size(spark, profile, w, h, want):
    rows = profiles.render_profiles(spark).where(F.col("profile") == profile)
    size = rows.select(geometry.smart_size(F.lit(float(w)), F.lit(float(h)), {c: F.col(c) for c in rows.columns}).alias("s")).first().s
    assert tuple(size) == want


@pytest.mark.parametrize(("profile", "w", "h", "want"), [("CHANDRA", 612, 792, 2.6667), ("CHANDRA", 200, 300, 5.12), ("GLM", 1000, 2000, 1.75)])
def test_scale(spark, profile, w, h, want):
    rows = profiles.render_profiles(spark).where(F.col("profile") == profile)
    assert abs(rows.select(geometry.render_scale(F.lit(float(w)), F.lit(float(h)), {c: F.col(c) for c in rows.columns}).alias("s")).first().s - want) < 1e-4


def test_profiles(spark):
    rows = profiles.with_profile(spark.createDataFrame([("GLM-OCR/",), ("dots.ocr",), ("rednote-hilab/dots.ocr",), ("nope",)], "service string"))
    got = {r.service: (r.canonical, r.error) for r in rows.collect()}
    assert got["GLM-OCR/"][0] == "zai-org/GLM-OCR" and got["dots.ocr"][0] == "rednote-hilab/dots.ocr-1.5" and got["rednote-hilab/dots.ocr"][0] == "rednote-hilab/dots.ocr"
    assert got["nope"][1].count(",") == 11


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("<|det|>title [1, 2, 3, 4]<|/det|># T\n<|det|>image [1,2,3,4]<|/det|>junk\nhidden\n<|det|>text [1,2,3,4]<|/det|>para\nmore\n\nSee [1] for details", "# T\n\npara\nmore\n\nfor details"),
        ("Figure [2] shows a\nb\ntext [1,2] c", "c"),
        ("", ""),
    ],
)
def test_segments(spark, given, want):
    df = spark.createDataFrame([("d", 0, given)], "doc_id string, page_index int, raw_response string")
    assert pages.segment_blocks(df, ["doc_id", "page_index"]).first().markdown == want


def test_unknown_parser(spark):
    df = spark.createDataFrame([("d", 0, "nope", "x")], "doc_id string, page_index int, parser string, raw_response string")
    with pytest.raises(Exception, match="unknown parser"):
        pages.parse(df).collect()


def test_files_and_streams(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    for name in ("b.pdf", "A.PDF", "c.txt", "sub/d.pdf"):
        (src / name).write_bytes(b"x")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(planning.list_files(spark, str(src))) == ["A.PDF", "b.pdf"]
    assert sorted(names(planning.list_files(spark, str(src), recursive=True))) == ["A.PDF", "b.pdf", "d.pdf"]
    for _ in range(2):  # the second time nothing is new
        ingest.append_to(ingest.arriving_files(spark, str(src)), str(tmp_path / "plan"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.output for r in spark.read.parquet(str(tmp_path / "plan")).collect()) == ["md/A.md", "md/b.md"]


def test_inference_and_sinks(spark, tmp_path):
    requests = spark.createDataFrame([("d", 0, "good"), ("d", 1, "bad")], "doc_id string, page_index int, payload string")

    def transport(payload):
        if payload == "bad":
            raise ValueError("broken")
        return payload.upper()

    got = {r.page_index: (r.attempt, r.body, r.error) for r in responses.infer(requests, transport, max_attempts=3, wait=lambda s: None).collect()}
    assert got == {0: (1, "GOOD", None), 1: (3, None, "ValueError: broken")}
    sinks.write_markdown(spark.createDataFrame([("a.md", "# A\n\nb\n")], "output string, markdown string"), str(tmp_path / "md"))
    (part,) = (tmp_path / "md" / "output=a.md").glob("part-*")
    assert part.read_text() == "# A\n\nb\n"


def test_paths(spark):
    row = spark.range(1).select(
        text.output_path(F.lit("/in/x/y.PDF")).alias("a"), text.output_path(F.lit("/in/x/y.z.pdf"), base="/in").alias("b"), text.page_name(F.lit(7), F.lit(3)).alias("c"), text.page_name(F.lit(7), F.lit(123456)).alias("d"),
        text.data_uri(F.lit("image/png"), F.lit(b"x" * 100)).alias("e"), text.prompt(F.lit("{width} {height}"), F.lit(3), F.lit(4), F.lit("{width}")).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.f) == ("md/y.md", "md/x/y.z.md", "p0007", "p000007", "{width}3 4") and "\n" not in row.e


def test_assembly_edges(spark):
    rows = spark.createDataFrame([("a", 1, "b"), ("a", 0, "a "), ("a", 2, " "), ("e", 0, " "), ("e", 1, None)], "doc_id string, page_index int, markdown string")
    assert dict(documents.assemble(rows).collect()) == {"a": "a \n\nb\n", "e": ""}
    assert dict(documents.assemble_compact(rows.where("doc_id = 'a'")).collect()) == {"a": "a\nb\n"}


def test_batches(spark):
    from pagemill.operators import batch

    tasks = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (1, 2, 0), (1, 3, 1), (2, 0, 0), (3, 5, None)], "batch long, position long, code long")
    judged = batch.outcomes(tasks, fail_fast=True)
    assert sorted((r.batch, r.position, r.status) for r in judged.collect()) == [(1, 0, "done"), (1, 1, "failed"), (1, 2, "skipped"), (1, 3, "skipped"), (2, 0, "done"), (3, 5, "failed")]
    assert sorted(map(tuple, batch.failure_report(judged).collect())) == [(1, 1, 3), (3, 5, 1)]
    assert sorted(map(tuple, batch.summary(batch.outcomes(tasks)).collect())) == [(1, 2, 2, 0, 1), (2, 1, 0, 0, 0), (3, 0, 1, 0, 1)]


def test_profiles_have_prompts(spark):
    from pagemill.sources import profiles

    rows = profiles.model_profiles(spark).collect()
    assert all(r.prompt for r in rows) and {r.name for r in rows if "{width}" in r.prompt} == {r.name for r in rows if r.parser == "svg"}
    assert profiles.listing(spark).count() == len(rows)


def test_attempts_keep_their_own_blocks(spark):
    from pagemill.operators import pages

    rows = [(1, 0, 1, "<|det|>title [1]<|/det|> A\nx"), (1, 0, 2, "<|det|>title [1]<|/det|> B\ny\n<|det|>image [2]<|/det|> z"), (1, 1, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, attempt int, raw_response string")
    assert sorted(map(tuple, pages.segment_blocks(df, ["doc_id", "page_index", "attempt"]).collect())) == [(1, 0, 1, "A\nx"), (1, 0, 2, "B\ny"), (1, 1, 1, "")]


def test_images_of_failed_pages_stay(spark):
    from pagemill.plans import convert

    log = [(1, 0, 1, "markdown", "text", None, False, 1, 1), (1, 1, 1, "markdown", None, "HTTPError: busy", True, 1, 1)]
    responses = spark.createDataFrame(log, "doc_id long, page_index int, attempt int, parser string, raw_response string, error string, fatal boolean, prompt_tokens long, completion_tokens long")
    images = spark.createDataFrame([(1, 1, 1, "d/1.png")], "doc_id long, page_index int, image_index int, path string")
    documents, stats = convert.convert(responses, images)
    assert "conversion_failed" in documents.first().markdown and "![Page 2 image 1](d/1.png)" in documents.first().markdown and stats.first().extracted_images == 1
