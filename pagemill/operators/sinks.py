"""Where documents go: a Parquet table first, and one Markdown file for each document where files are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    documents.write.mode(mode).parquet(path)


def write_markdown(documents: DataFrame, folder: str) -> None:
    """One UTF-8 file for each row: output (a relative path) and markdown. Written by Spark's own file system layer.

    Each path is a partition value of a text table, so any store that Spark reaches will do, and a task that runs twice
    replaces its file. The part file lies in a folder with the output's name; an empty document has one line feed. Where each
    row must be a file of exactly its name, with commit and abort, ``sources.files.write_files`` does that.
    """
    from pyspark.sql import functions as F

    rows = documents.select("output", F.regexp_replace("markdown", r"\n\z", "").alias("value"))
    rows.write.mode("overwrite").partitionBy("output").text(folder)
