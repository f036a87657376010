"""Outputs that are published only if they hold what is claimed of them.

The claims are counted in the job that writes: no second pass over the rows. What is written stands
under a name of its own until they hold, and takes its place by one rename.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class ClaimsBroken(Exception):
    """Claims that rows break, with how many do."""

    def __init__(self, broken: dict[str, int], rows: int) -> None:
        super().__init__(f"not published: of {rows} rows " + ", ".join(f"{n} break {name!r}" for name, n in sorted(broken.items())))
        self.broken, self.rows = broken, rows


def publish(outputs: Mapping[str, DataFrame], claims: Mapping[str, Mapping[str, Column]], totals: Mapping[str, Column] | None = None) -> dict[str, int]:
    """Write each output (path to rows) as Parquet, and give them their names if all claims hold of all; the number of rows of each.

    claims: of each path, named conditions on a row; null counts as broken. totals: named conditions on
    counts, over columns named by path, to be checked when all is written. If anything breaks, or a job
    fails, no path is published, and what was written is deleted. Paths must be new. An empty output
    breaks no claim on rows.
    """
    spark = next(iter(outputs.values())).sparkSession if outputs else None
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration())
    name = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    staging, counts, broken = {}, {}, {}
    for path in outputs:
        if fs(path).exists(name(path)):
            raise FileExistsError(path)
    try:
        for path, rows in outputs.items():
            own = list(claims.get(path, {}).items())
            seen = Observation()
            metrics = [F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).alias(f"c{k}") for k, (_, ok) in enumerate(own)]
            staging[path] = f"{path}.staged-{uuid.uuid4().hex}"
            rows.observe(seen, F.count(F.lit(1)).alias("n"), *metrics).write.parquet(staging[path])
            counts[path] = seen.get["n"]
            broken |= {claim: seen.get[f"c{k}"] for k, (claim, _) in enumerate(own) if seen.get[f"c{k}"]}
        if totals and not broken:
            row = spark.range(1).select(*[F.lit(n).alias(p) for p, n in counts.items()], "id").select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in totals.items()]).first()
            broken |= {n: 1 for n in totals if not row[n]}
        if broken:
            raise ClaimsBroken(broken, sum(counts.values()))
        placed = []
        for path, from_ in staging.items():
            if fs(path).exists(name(path)) or not fs(path).rename(name(from_), name(path)):
                for p in placed:
                    fs(p).delete(name(p), True)
                raise FileExistsError(path)
            placed.append(path)
    finally:
        for from_ in staging.values():
            fs(from_).delete(name(from_), True)
    return counts
