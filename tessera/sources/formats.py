"""User formats as Spark data sources, for batch reads and streams by name.

A format is a name, a schema and a function that turns one open binary file into
rows.  Registered, it reads like a built-in one: ``spark.read.format(name)
.load(path)`` with one partition per file, ``spark.readStream.format(name)
.load(path)`` with the files that arrived since the last trigger, and by file
extension through the registry of :mod:`.readers`.

Paths are those of pyarrow's file systems (local, HDFS, S3, ...); a folder means
all files below it whose names do not begin with ``_`` or ``.``.  The stream's
offset is a point in the order of (time, path) in which files arrived, so a
restart goes on where the checkpoint says.  Rows come as tuples or as dicts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import ConfigError, SourceNotFoundError
from .readers import register_reader

Parse = Callable[..., Iterable[tuple | dict]]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path
        super().__init__(path)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def list_files(path: str) -> list[tuple[int, str]]:
    """(modification time in ns, path) of the files of a path, oldest first."""
    system, inner = _filesystem(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise SourceNotFoundError(f"Source not found: {path}")
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
    prefix = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((f.mtime_ns or 0, prefix + f.path) for f in found if not f.base_name.startswith(("_", ".")))


def _rows(path: str, parse: Parse, names: list[str]) -> Iterator[tuple]:
    system, inner = _filesystem(path)
    with system.open_input_stream(inner, compression=None) as f:
        for row in parse(f):
            yield tuple(row.get(n) for n in names) if isinstance(row, dict) else tuple(row)


class _BatchReader(DataSourceReader):
    def __init__(self, path: str, parse: Parse, names: list[str]):
        self.path, self.parse, self.names = path, parse, names

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(p for _, p in list_files(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, _File):  # none without files
            yield from _rows(partition.path, self.parse, self.names)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, parse: Parse, names: list[str]):
        self.path, self.parse, self.names = path, parse, names

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = list_files(self.path)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = ((x["time"], x["path"]) for x in (start, end))
        return [_File(p) for t, p in list_files(self.path) if low < (t, p) <= high]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _rows(partition.path, self.parse, self.names)


def register_format(spark: SparkSession, name: str, schema: T.StructType | str, parse: Parse, extension: str | None = None) -> None:
    """Make ``name`` a format of the session; ``parse`` gets an open binary file and yields its rows.  With an
    ``extension`` the registry reads such files with it."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    class Format(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return kind

        def _path(self) -> str:
            if not self.options.get("path"):
                raise ConfigError(f"format {name!r} needs a path")
            return self.options["path"]

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _BatchReader(self._path(), parse, schema.names)

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return _StreamReader(self._path(), parse, schema.names)

    spark.dataSource.register(Format)
    if extension:
        def read(session: SparkSession, path: str, schema: T.StructType | str | None = None,
                 with_file_order: bool = False) -> DataFrame:
            if with_file_order:
                raise ConfigError(f"format {name!r} has no file order")
            r = session.read.format(name)
            return (r.schema(schema) if schema is not None else r).load(path)
        register_reader(extension, read)
