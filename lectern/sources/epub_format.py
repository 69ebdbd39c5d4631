"""EPUB containers as a format of Spark: spark.read.format("epub").load(folder), and the same for readStream.

A file is a partition. A task opens it where it lies and reads the directory of the archive, the package and the members that
are asked for: filters on the other columns are held against a member before its content is read. The stream takes files
in the order of their times and names; its offset is the last of them, and a batch has so many files at most.

    epub_format.register(spark)
    spark.read.format("epub").load("hdfs:///books").where("media_type = 'text/css'")
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

from .epub import MEMBERS, member_rows

COLUMNS = [f.split()[0] for f in MEMBERS.split(", ")]
#: What a filter says of a value that isn't null.
HOLDS = {
    EqualTo: lambda v, f: v == f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value, In: lambda v, f: v in f.value,
    StringStartsWith: lambda v, f: v.startswith(f.value), StringEndsWith: lambda v, f: v.endswith(f.value),
}


@dataclass
class File(InputPartition):
    path: str


def _opened(path: str):
    """The file system of a path and the path in it; without a scheme it is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files_under(path: str) -> list[tuple[int, str]]:
    """(time in nanoseconds, path) of the EPUB files under a path, or of the file itself, in order."""
    from pyarrow import fs

    system, at = _opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else []
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path.rstrip("/")) - len(at.rstrip("/"))] if path.rstrip("/").endswith(at.rstrip("/")) else ""
    return sorted((f.mtime_ns or 0, prefix + f.path) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".epub"))


def rows_of(path: str, filters: list[Filter]) -> Iterator[tuple]:
    def wanted(row: tuple) -> bool:
        for f in filters:
            value = row[COLUMNS.index(f.attribute[0])]
            if isinstance(f, IsNull):
                good = value is None
            elif isinstance(f, IsNotNull):
                good = value is not None
            elif isinstance(f, EqualNullSafe):
                good = value == f.value
            else:
                good = value is not None and HOLDS[type(f)](value, f)
            if not good:
                return False
        return True

    system, at = _opened(path)
    with system.open_input_file(at) as content:
        yield from member_rows(path, content, wanted)


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.filters = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            known = isinstance(f, (IsNull, IsNotNull, EqualNullSafe)) or type(f) in HOLDS
            if known and len(f.attribute) == 1 and f.attribute[0] in COLUMNS and f.attribute[0] != "content":
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[File]:
        return [File(p) for _, p in files_under(self.path)]

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is not None:
            yield from rows_of(partition.path, self.filters)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.upto = path, most, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        from_ = self.upto or self.initialOffset()
        new = [f for f in files_under(self.path) if f > (from_["time"], from_["path"])][: self.most]
        self.upto = {"time": new[-1][0], "path": new[-1][1]} if new else from_
        return self.upto

    def partitions(self, start: dict, end: dict) -> list[File]:
        self.upto = max(self.upto or start, end, key=lambda o: (o["time"], o["path"]))
        return [File(p) for t, p in files_under(self.path) if (start["time"], start["path"]) < (t, p) <= (end["time"], end["path"])]

    def read(self, partition: File) -> Iterator[tuple]:
        yield from rows_of(partition.path, [])

    def commit(self, end: dict) -> None:
        pass


class EpubFormat(DataSource):
    """Options: path, and maxFilesPerTrigger for streams (100)."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options["path"], int(self.options.get("maxFilesPerTrigger", 100)))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpubFormat)
