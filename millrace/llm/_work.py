"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[str, Callable[[], None]] = {}
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def keep_alone(name: str, clear: Callable[[], None]) -> None:
    """Called in a worker by the operator that is about to fill its cache of words: those of the others go."""
    _KEPT[name] = clear
    for other, forget in _KEPT.items():
        if other != name:
            forget()


def work_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local one, but only if the executors are on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, name: str, batch_rows: int | None = None, codec: str | None = None, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there.

    batch_rows: the most rows in an Arrow batch meanwhile, where single rows can be large. codec: of the
    files, where the session's is not the one to take. by: a column of few values, each of which is a part
    of its own (see discard); the rows are not sorted for that.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    before, writers = spark.conf.get(BATCH), spark.conf.get(WRITERS)
    try:
        if batch_rows:
            spark.conf.set(BATCH, str(min(batch_rows, int(before))) if int(before) > 0 else str(batch_rows))
        if by:
            spark.conf.set(WRITERS, "16")
        df.write.parquet(path, partitionBy=by, compression=codec)
    finally:
        spark.conf.set(BATCH, before)
        spark.conf.set(WRITERS, writers)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete tables made by materialize that no later plan reads, or one part of them ("column=value")."""
    for df in tables:
        path = getattr(df, "_millrace_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
