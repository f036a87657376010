"""Custom sources: a frontend is a Python data source that turns files into rows, one partition a file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINES = "path string, line int, body string"


class Lines(DataSource):
    """Lines of text files, by a list of paths in the option `paths`, separated by commas. The files must be where the executors are."""

    @classmethod
    def name(cls) -> str:
        return "millrace_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _LinesReader(self.options["paths"].split(","))


class _LinesReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, encoding="utf-8", newline="\n") as f:
            rows = [(partition.value, k, line.rstrip("\n")) for k, line in enumerate(f, 1)]
        if rows:
            kinds = (pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "line", "body"])


def covers(pattern: str, package: str) -> bool:
    """The rule of gates.in_directory for one name."""
    if pattern == "...":
        return True
    base = pattern.removesuffix("/...")
    return package == base or (base != pattern and package.startswith(base + "/"))


class Packages(DataSource):
    """Lines of files by package: package, path, line, body. Options: `files`, JSON from packages to their paths, and `scope`, JSON of the directory patterns that a plan sees (see gates.in_directory).

    The scope is settled where the read is planned: a package outside of it is no partition, and its files
    are not opened. It is an option and no pushed filter, since Spark plans a source once for all queries
    on one DataFrame: what one of them has pushed would hold for the next.
    """

    @classmethod
    def name(cls) -> str:
        return "millrace_packages"

    def schema(self) -> str:
        return "package string, " + LINES

    def reader(self, schema) -> DataSourceReader:
        scope = json.loads(self.options.get("scope", '["..."]'))
        return _PackagesReader({p: f for p, f in json.loads(self.options["files"]).items() if any(covers(s, p) for s in scope)})


class _PackagesReader(_LinesReader):
    def __init__(self, files: dict[str, list[str]]) -> None:
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((package, path)) for package, paths in sorted(self.files.items()) for path in paths] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        package, path = partition.value
        for batch in super().read(InputPartition(path)):
            yield pa.RecordBatch.from_arrays([pa.array([package] * batch.num_rows), *batch.columns], names=["package", *batch.schema.names])


def register(spark: SparkSession, *sources: type[DataSource]) -> None:
    for source in sources or (Lines, Packages):
        spark.dataSource.register(source)
