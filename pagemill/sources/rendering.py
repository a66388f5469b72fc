"""Optional stages that need a PDF library (pymupdf): page counts, page images, subsets. Absent, they raise when used."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def available() -> bool:
    import importlib.util

    return importlib.util.find_spec("pymupdf") is not None


def _library():
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("this stage needs pymupdf on the executors") from e
    return pymupdf


def page_counts(files: DataFrame) -> DataFrame:
    """path, total_pages and error from path and content; a file that can't be opened, or needs a password, has an error."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        pdf = _library()
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                try:
                    with pdf.open(stream=content, filetype="pdf") as doc:
                        rows.append((path, None, "password needed") if doc.needs_pass else (path, doc.page_count, None))
                except Exception as e:  # the library raises many kinds; each file's error is data here
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "total_pages", "error"]).astype({"total_pages": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, total_pages int, error string")


def render_pages(tasks: DataFrame) -> DataFrame:
    """path, page_index, width, height and image (PNG) from path, page_index, content, scale and rotation.

    Images are large: keep the Arrow batches small (spark.sql.execution.arrow.maxRecordsPerBatch).
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        pdf = _library()
        for batch in batches:
            rows = []
            for t in batch.itertuples():
                with pdf.open(stream=t.content, filetype="pdf") as doc:
                    image = doc[t.page_index].get_pixmap(matrix=pdf.Matrix(t.scale, t.scale).prerotate(t.rotation), alpha=False)
                    rows.append((t.path, t.page_index, image.width, image.height, image.tobytes("png")))
            yield pd.DataFrame(rows, columns=["path", "page_index", "width", "height", "image"])

    return tasks.select("path", "page_index", "content", "scale", "rotation").mapInPandas(run, "path string, page_index int, width int, height int, image binary")


def subset(files: DataFrame) -> DataFrame:
    """path and a new content with only the given pages (an array of zero-based numbers) in their order."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        pdf = _library()
        for batch in batches:
            out = []
            for t in batch.itertuples():
                with pdf.open(stream=t.content, filetype="pdf") as doc:
                    doc.select([int(p) for p in t.pages])
                    out.append((t.path, doc.tobytes()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return files.select("path", "content", "pages").mapInPandas(run, "path string, content binary")
