"""Trees of files as tables: listing, change gate, claims, units, regions, and loading what is needed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import claimed
from ..operators.changes import generation_diff


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, size, mtime of every file below root that is not empty (the reader has no split for one that is); contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """path, content and digest (SHA-256) of every file below root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content", F.sha2("content", 256).alias("digest"))


def suspects(now: DataFrame, was: DataFrame, key: str = "path", stat: Sequence[str] = ("size", "mtime")) -> DataFrame:
    """Files whose stat is not that of the last run: the only ones worth a digest."""
    return generation_diff(was, now, [key], stat)


def judged(files: DataFrame, text: str, trailer: str) -> DataFrame:
    """files with a mark for those that end in a provenance trailer: outputs, not inputs."""
    return files.withColumn("output", F.col(text).rlike(rf"(?:^|\n){trailer}[0-9a-f]{{64}}\n?\z"))


def claims(files: DataFrame, frontends: Mapping[str, Sequence[str]], path: str = "path") -> DataFrame:
    """files with the frontends whose patterns cover them; more than one is a fault of the file. The patterns are part of the program and become conditions, so nothing is joined."""
    who = F.array_compact(F.array(*[F.when(claimed(F.col(path), list(patterns)), name) for name, patterns in frontends.items()]))
    return files.withColumn("claimants", who)


def units(files: DataFrame, unit: Sequence[str], path: str = "path", digest: str = "digest") -> DataFrame:
    """Units with their number of files and their key: a digest over the paths and digests of the files in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(digest).alias("d"))))
    return files.groupBy(*unit).agg(F.count("*").alias("files"), F.sha2(F.array_join(F.transform(parts, lambda x: F.concat(x["p"].cast("string"), F.lit("="), x["d"])), ";"), 256).alias("unit_key"))


def restored(units_: DataFrame, memo: DataFrame, key: str = "unit_key") -> tuple[DataFrame, DataFrame]:
    """Units that a memo of parsed regions knows, and those to parse."""
    known = memo.select(key).distinct()
    return units_.join(known, key, "left_semi"), units_.join(known, key, "left_anti")


def parsed(units_: DataFrame, parse, schema: str) -> DataFrame:
    """Rows that parse (an iterator of pandas frames to one) makes of the units, partition by partition."""
    return units_.mapInPandas(parse, schema)


def spliced(parts: DataFrame, package: str, order: Sequence[Column]) -> DataFrame:
    """Rows of a package's parts under the name that its first part gives."""
    return parts.withColumn("package_name", F.first("name").over(Window.partitionBy(package).orderBy(*order)))


def write_regions(rows: DataFrame, path: str, by: Sequence[str] = ("kind",)) -> None:
    """Rows as Parquet, in a folder for each kind: a scan of one kind opens no other. Rows are clustered first, so a folder gets few files."""
    rows.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def sealed(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A lazy table over regions; filters on the kind prune folders, those on other columns row groups."""
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def scan_prefix(table: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Rows whose key begins with the prefix; the filter reaches the Parquet scan."""
    return table.where(F.col(key).startswith(prefix))
