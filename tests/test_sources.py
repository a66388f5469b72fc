import hashlib
import json
import os
import pathlib
import subprocess
import sys

import pytest

from pagemill.plans import assembly
from pagemill.sources import files, hub

ROWS = [(f"md/{i % 3}/{i}.md", f"text {i} é\n") for i in range(40)] + [("a/empty.md", None), ("long.md", "x" * 300_000)]


def on_disk(folder):
    root = pathlib.Path(folder)
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}


def test_one_file_for_each_row(spark, tmp_path):
    folder = f"{tmp_path}/out"
    files.write_files(spark.createDataFrame(ROWS, "output string, markdown string"), folder)
    want = {n: (x or "").encode() for n, x in ROWS}
    assert on_disk(folder) == want and not (tmp_path / "out" / files.STAGING).exists()
    assert {r.output: bytes(r.content) for r in files.read_files(spark, folder).collect()} == want
    assert json.loads((tmp_path / "out" / files.MARKER).read_text())["files"] == len(ROWS)
    # Names that are taken are refused, and nothing of the job stays; overwriting replaces.
    with pytest.raises(Exception, match="exists"):
        files.write_files(spark.createDataFrame([("new.md", "n"), ("long.md", "other")], "output string, markdown string").coalesce(1), folder)
    assert on_disk(folder) == want
    files.write_files(spark.createDataFrame([("long.md", bytearray(b"\x00png"))], "output string, png binary"), folder, "overwrite")
    assert on_disk(folder) == want | {"long.md": b"\x00png"}


@pytest.mark.parametrize("names", [["../x"], ["/x"], ["_x"], [""], [None], ["a", "a"]])
def test_names(spark, tmp_path, names):
    with pytest.raises(Exception, match="not a file's name|two rows"):
        files.write_files(spark.createDataFrame([(n, "x") for n in names], "output string, content string"), f"{tmp_path}/out")
    assert on_disk(f"{tmp_path}/out") == {}


def test_empty(spark, tmp_path):
    files.write_files(spark.createDataFrame([], "output string, content string"), f"{tmp_path}/out")
    assert files.read_files(spark, f"{tmp_path}/out").count() == files.read_files(spark, f"{tmp_path}/none").count() == 0


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pagemill.sources import files
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
before = files.FileWriter.write
def write(self, iterator):
    from pyspark import TaskContext
    if TaskContext.get().partitionId() == 0 and TaskContext.get().attemptNumber() < 2:
        # The first attempt dies while rows come in, the second when all files have been moved.
        def rows():
            for i, row in enumerate(iterator):
                if i == 3 and TaskContext.get().attemptNumber() == 0:
                    os._exit(1)
                yield row
        before(self, rows())
        os._exit(1)
    return before(self, iterator)
files.FileWriter.write = write
files.write_files(spark.createDataFrame([(f"d/{{i}}.md", str(i)) for i in range(50)], "output string, content string"), {folder!r})
spark.stop()
"""


def test_a_killed_task(tmp_path):
    folder, root = f"{tmp_path}/out", str(pathlib.Path(__file__).parent.parent)
    done = subprocess.run([sys.executable, "-c", KILLED.format(root=root, folder=folder)], capture_output=True, text=True, timeout=200, cwd=tmp_path, env={**os.environ, "PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-2000:]
    assert on_disk(folder) == {f"d/{i}.md": str(i).encode() for i in range(50)}


def test_markdown_files(spark):
    sf = "/root/testdata/sf0.001"
    want = {(len(m := r.markdown.encode()), hashlib.sha256(m).hexdigest()) for r in assembly.assemble_document(spark, sf).collect()}
    got = assembly.markdown_files(spark, sf).collect()
    assert {(r.bytes, r.sha256) for r in got} == want and len(got) == assembly.assemble_document(spark, sf).count()


def test_pages_of_a_listing(spark, tmp_path):
    rows = [(f"m{i}", f"2024-01-{i % 28 + 1:02}", None if i % 10 == 0 else i * 10, i % 100 if i % 7 else None) for i in range(500)]
    folder = f"{tmp_path}/pages"
    hub.save_pages(spark.createDataFrame(rows, hub.SCHEMA), folder, size=20)
    every = hub.read_pages(spark, folder)
    assert sorted(map(tuple, every.collect()), key=str) == sorted(rows, key=str)
    few = every.where("downloads >= 4500")
    assert sorted(map(tuple, few.collect()), key=str) == sorted((r for r in rows if (r[2] or 0) >= 4500), key=str)
    # Pages that can't hold such models aren't read, and no filter is left to Spark.
    assert few.rdd.getNumPartitions() < every.rdd.getNumPartitions() / 3
    assert every.where("downloads > 99999999").rdd.getNumPartitions() <= 1
    got = hub.filter_models(every, 1000, 50).collect()
    assert {r.model_id for r in got} == {r[0] for r in rows if (r[2] or 0) >= 1000 and (r[3] or 0) >= 50}
    assert hub.filter_models(every, 0, 0).count() == len(rows)
    assert hub.read_pages(spark, folder, ("id", "likes")).columns == ["id", "likes"]
    assert [r.id for r in every.where("id = 'm42'").collect()] == ["m42"]
