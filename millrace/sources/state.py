"""State kept between runs: generations of runs, manifests in shards, outputs written where they differ.

A store is a folder of any Hadoop file system. Runs of a table are immutable Parquet folders; a
generation is a small JSON file that names the live runs of each table. Generations are numbered, and
the last one is live. One is written under another name and renamed when it is whole, and none is ever
written over: a reader sees the old generation or the new one, never a mix, and a crash leaves the old.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import newest
from ..operators.linking import reconciled

MAX_RUNS = 8


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{name}"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _current(self) -> str | None:
        """The live generation's file."""
        p = self._path(f"{self.root}/generations")
        names = [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
        last = max((n for n in names if n.endswith(".json")), default=None)
        return last and f"generations/{last}"

    def _publish(self, generation: dict) -> None:
        current = self._current()
        number = int(current.split("/")[1].split(".")[0]) + 1 if current else 0
        staged, at = f"generations/{uuid.uuid4().hex}.tmp", f"generations/{number:016d}.json"
        self._write(staged, json.dumps(generation))
        if self._fs.exists(self._path(f"{self.root}/{at}")) or not self._fs.rename(self._path(f"{self.root}/{staged}"), self._path(f"{self.root}/{at}")):
            raise FileExistsError(f"another run has published {at}")

    def generation(self) -> dict[str, list[dict]]:
        """Of each table its live runs, oldest first: name and rows."""
        current = self._current()
        return json.loads(self._read(current)) if current else {}

    def table(self, name: str, key: str = "key", schema=None) -> DataFrame | None:
        """All live rows of a table: of each key that of the newest run, unless it is dead."""
        runs = self.generation().get(name, [])
        if not runs:
            return None
        rows = None
        for k, run in enumerate(runs):
            part = self.spark.read.parquet(f"{self.root}/{run['name']}").withColumn("run", F.lit(k))
            rows = part if rows is None else rows.unionByName(part)
        return newest(rows, key).drop("run", "dead")

    def get(self, name: str, key, column: str = "key") -> DataFrame | None:
        rows = self.table(name, column)
        return None if rows is None else rows.where(F.col(column) == key)

    def commit(self, tables: dict[str, DataFrame], key: str = "key") -> None:
        """Append a run (rows with a column dead) to each table, and publish the generation.

        The runs of a table are merged into one when there would be more than MAX_RUNS, or when the
        newer ones outweigh the oldest.
        """
        generation = self.generation()
        for name, rows in tables.items():
            runs = generation.get(name, [])
            folder = f"runs/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{folder}")
            n = self.spark.read.parquet(f"{self.root}/{folder}").count()
            runs = [*runs, {"name": folder, "rows": n}]
            if len(runs) > 1 and (len(runs) > MAX_RUNS or sum(r["rows"] for r in runs[1:]) > runs[0]["rows"]):
                every = None
                for k, run in enumerate(runs):
                    part = self.spark.read.parquet(f"{self.root}/{run['name']}").withColumn("run", F.lit(k))
                    every = part if every is None else every.unionByName(part)
                folder = f"runs/{uuid.uuid4().hex}"
                newest(every, key).drop("run").withColumn("dead", F.lit(False)).write.parquet(f"{self.root}/{folder}")
                runs = [{"name": folder, "rows": self.spark.read.parquet(f"{self.root}/{folder}").count()}]
            generation[name] = runs
        self._publish(generation)

    def collect_garbage(self) -> int:
        """Delete runs and generations that the live generation does not name. How many went."""
        current, gone = self._current(), 0
        live = {run["name"] for runs in self.generation().values() for run in runs} | {current}
        for folder in ("runs", "generations"):
            p = self._path(f"{self.root}/{folder}")
            for status in self._fs.listStatus(p) if self._fs.exists(p) else []:
                if f"{folder}/{status.getPath().getName()}" not in live:
                    self._fs.delete(status.getPath(), True)
                    gone += 1
        return gone

    def lock(self, holder: str) -> bool:
        """Take the lock of the store; False if another holds it. Only one driver writes at a time."""
        p = self._path(f"{self.root}/LOCK")
        try:
            stream = self._fs.create(p, False)
        except Exception:
            return False
        stream.write(bytearray(holder.encode()))
        stream.close()
        return True

    def unlock(self) -> None:
        self._fs.delete(self._path(f"{self.root}/LOCK"), False)


def shards(manifest: DataFrame, path: str = "path") -> DataFrame:
    """Manifest entries with their bucket, one of 256."""
    return manifest.withColumn("bucket", F.substring(F.sha2(path, 256), 1, 2))


def write_manifest(manifest: DataFrame, folder: str, path: str = "path") -> None:
    """One JSON document folder per bucket, sorted by path."""
    shards(manifest, path).repartition("bucket").sortWithinPartitions("bucket", path).write.mode("overwrite").partitionBy("bucket").json(folder)


def read_manifest(spark: SparkSession, folder: str, schema, path: str = "path") -> DataFrame:
    """All entries by path. Entries in a bucket that is not theirs are refused."""
    rows = spark.read.schema(schema).json(folder)
    wrong = F.raise_error(F.concat(F.lit("an entry is in the wrong bucket: "), F.col(path)))
    return rows.withColumn("bucket", F.lpad(F.col("bucket").cast("string"), 2, "0")).withColumn(path, F.when(F.col("bucket") == F.substring(F.sha2(path, 256), 1, 2), F.col(path)).otherwise(wrong.cast("string"))).drop("bucket")


def to_write(staged: DataFrame, found: DataFrame, key: str = "path", digest: str = "digest", overwrite: bool = False, owned: str | None = None) -> DataFrame:
    """staged rows whose bytes differ from what is there. A found file that is not the engine's own (owned is false) is refused unless overwrite is set."""
    action = reconciled(staged, found, key, digest).where("action in ('created', 'updated')")
    if owned and not overwrite:
        action = action.join(found.where(~F.col(owned)).select(key), key, "left_anti")
    return staged.join(action, key)
