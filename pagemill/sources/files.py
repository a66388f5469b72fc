"""A sink of one file for each row, as a data source: ``output`` names the file, the other column is what it holds.

Every task attempt stages its files under its own name and lists them before it moves them to where they belong, so a task
that is killed and runs again replaces its files and leaves nothing else. ``commit`` removes the staging folder and leaves
a marker; ``abort`` takes back what attempts had moved. Any file system that Arrow knows will do (a plain path must be shared).
"""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType

FORMAT = "one_file_per_row"
STAGING, MARKER = "_staging", "_SUCCESS"


def file_system(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def checked(output: str | None) -> str:
    """A name that stays inside the folder."""
    parts = (output or "").split("/")
    if not output or output.startswith(("/", "_")) or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a file's name: {output!r}")
    return output


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, job: str, content: str, overwrite: bool):
        self.folder, self.job, self.content, self.overwrite = folder, job, content, overwrite

    def _staging(self, base: str) -> str:
        return posixpath.join(base, STAGING, self.job)

    def write(self, iterator) -> Written:
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = file_system(self.folder)
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.attemptNumber()}-{context.taskAttemptId()}"
        own, names, seen = posixpath.join(self._staging(base), attempt), [], set()
        system.create_dir(own)
        for row in iterator:
            name, value = checked(row["output"]), row[self.content]
            if name in seen:
                raise ValueError(f"two rows for {name}")
            seen.add(name)
            with system.open_output_stream(posixpath.join(own, str(len(names)))) as out:
                out.write(value.encode("utf-8", "surrogatepass") if isinstance(value, str) else bytes(value or b""))
            names.append(name)
        if not self.overwrite:
            earlier = {posixpath.join(base, n) for n in self._listed(system, base, context.partitionId())}
            for start in range(0, len(names), 1000):
                found = system.get_file_info([posixpath.join(base, n) for n in names[start : start + 1000]])
                taken = [f.path for f in found if f.type != fs.FileType.NotFound and f.path not in earlier]
                if taken:
                    raise FileExistsError(f"{taken[0]} exists")
        # From here on another attempt, or abort, knows what this one may have moved.
        with system.open_output_stream(f"{own}.json") as out:
            out.write(json.dumps(names).encode())
        for folder in {posixpath.dirname(n) for n in names} - {""}:
            system.create_dir(posixpath.join(base, folder))
        for i, name in enumerate(names):
            system.move(posixpath.join(own, str(i)), posixpath.join(base, name))
        system.delete_dir(own)
        return Written(attempt, len(names))

    def _listed(self, system, base: str, partition: int | None = None):
        """The names that attempts of this job (or of one partition) said they would move."""
        from pyarrow import fs

        for info in system.get_file_info(fs.FileSelector(self._staging(base), allow_not_found=True)):
            if info.path.endswith(".json") and (partition is None or info.base_name.split("-")[0] == str(partition)):
                with system.open_input_stream(info.path) as lines:
                    yield from json.loads(lines.read())

    def commit(self, messages) -> None:
        system, base = file_system(self.folder)
        system.create_dir(base)
        self._clear(system, base)
        with system.open_output_stream(posixpath.join(base, MARKER)) as out:
            out.write(json.dumps({"files": sum(m.files for m in messages if m), "tasks": sum(m is not None for m in messages)}).encode())

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, base = file_system(self.folder)
        if not self.overwrite:  # what was there before can't be had back
            for name in self._listed(system, base):
                path = posixpath.join(base, name)
                if system.get_file_info(path).type == fs.FileType.File:
                    system.delete_file(path)
        self._clear(system, base)

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        for path in (self._staging(base), posixpath.join(base, STAGING)):
            if path == self._staging(base) or not system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if system.get_file_info(path).type == fs.FileType.Directory:
                    system.delete_dir(path)


@dataclass
class Listed(InputPartition):
    names: list[str]


class FileReader(DataSourceReader):
    """The files of a folder, some hundred to a partition; none before the first commit. (Spark's own readers skip empty files.)"""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Listed]:
        from pyarrow import fs

        system, base = file_system(self.folder)
        if system.get_file_info(posixpath.join(base, MARKER)).type != fs.FileType.File:
            return [Listed([])]
        found = system.get_file_info(fs.FileSelector(base, recursive=True))
        names = sorted(n for f in found if f.type == fs.FileType.File and not (n := f.path.removeprefix(base.rstrip("/")).lstrip("/")).startswith(("_", ".")))
        return [Listed(names[i : i + 200]) for i in range(0, len(names), 200)] or [Listed([])]

    def read(self, partition: Listed):
        import pyarrow as pa

        system, base = file_system(self.folder)
        for name in partition.names:
            with system.open_input_stream(posixpath.join(base, name)) as f:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.readall()], pa.binary())], ["output", "content"])


class FileSink(DataSource):
    """``df.write.format("one_file_per_row").option("path", folder)``; mode append refuses names that are taken, overwrite replaces those files."""

    def schema(self) -> str:
        return "output string, content binary"

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(self.options["path"].rstrip("/"))

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        import uuid

        others = [f for f in schema.fields if f.name != "output"]
        if len(others) != len(schema.fields) - 1 or len(others) != 1 or not isinstance(others[0].dataType, (StringType, BinaryType)):
            raise ValueError("columns must be output and one of strings or bytes")
        return FileWriter(self.options["path"].rstrip("/"), uuid.uuid4().hex, others[0].name, overwrite)


def write_files(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """One file for each row of ``rows`` (output and content); a null content makes an empty file.

    Rows are dealt by name, so two rows of one name meet in a task, which refuses them. Names are relative and stay inside
    the folder. An empty table writes the marker alone.
    """
    rows.sparkSession.dataSource.register(FileSink)
    rows.repartition("output").write.format(FORMAT).mode(mode).option("path", folder).save()


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """output and content (bytes) of every file that was committed; nothing of a folder without the marker."""
    spark.dataSource.register(FileSink)
    return spark.read.format(FORMAT).option("path", folder).load()
