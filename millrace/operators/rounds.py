"""Warm rounds: groups run again until nothing that they read changes.

A group (a file, a unit) has result rows and reads the results of other groups. A round runs the dirty
groups, compares what they return with what they had, and passes over those that returned the same; who
reads the others is dirty in the next round. The results of the last run are never rewritten: what has
changed since lies over them. What a round joins is dealt by key, not sent through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .incremental import cut, dealt, discard

Run = Callable[[DataFrame, DataFrame], DataFrame]
ROUNDS = 100


def _digests(rows: DataFrame, group: str) -> DataFrame:
    """group, and a digest of its rows that their order has no part in."""
    values = [c for c in sorted(rows.columns) if c != group]
    row = F.xxhash64(*values, *[F.col(c).isNull() for c in values])
    return rows.groupBy(group).agg(F.count("*").alias("_n"), F.sum(row.cast("decimal(20,0)")).alias("_sum"), F.bit_xor(F.xxhash64(row)).alias("_mix"))


def changed(before: DataFrame, after: DataFrame, group: str = "group") -> DataFrame:
    """Groups whose rows differ, those with rows on one side alone included."""
    a, b = _digests(before, group), _digests(after, group).select(F.col(group).alias("_g"), *[F.col(c).alias(f"{c}2") for c in ("_n", "_sum", "_mix")])
    same = F.struct("_n", "_sum", "_mix").eqNullSafe(F.struct("_n2", "_sum2", "_mix2"))
    return a.join(dealt(b), F.col(group) == F.col("_g"), "full").where(~same).select(F.coalesce(group, "_g").alias(group))


def warm(prior: DataFrame, reads: DataFrame, dirty: DataFrame, run: Run, group: str = "group", rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The results after a change, and what happened: (group, round, changed) of every group that ran.

    prior: results of the last run, with a column group. reads: group, read (a group whose results it
    reads). dirty: the groups whose own input changed, new and vanished ones included. run: from a table
    of groups and the results as they stand to the rows of these groups, which may be none. Where reads
    form no circle the outcome equals that of a run from nothing. Groups that read themselves in a
    circle run until they settle; where they do not within so many rounds, ValueError.
    """
    dirty, patch, log = cut(dirty.select(group).distinct()), None, []

    def overlaid() -> DataFrame:
        if patch is None:
            return prior
        ran = reduce(DataFrame.union, [t.select(group) for t in log]).distinct()
        return prior.join(dealt(ran), group, "left_anti").unionByName(patch)

    while not dirty.isEmpty():
        if len(log) == rounds:
            raise ValueError(f"results still change after {rounds} rounds: groups read each other in a circle")
        now = overlaid()
        fresh = cut(run(dirty, now).select(*prior.columns))
        moved = cut(changed(now.join(dealt(dirty), group, "left_semi"), fresh, group))
        log.append(cut(dirty.join(dealt(moved.withColumn("changed", F.lit(True))), group, "left").select(group, F.lit(len(log) + 1).alias("round"), F.coalesce("changed", F.lit(False)).alias("changed"))))
        new_patch = fresh if patch is None else cut(patch.join(dealt(dirty), group, "left_anti").unionByName(fresh))
        spent = [moved, dirty, *([patch] if patch is not None else []), *([fresh] if new_patch is not fresh else [])]
        patch, dirty = new_patch, cut(reads.join(dealt(moved.select(F.col(group).alias("read"))), "read", "left_semi").select(group).distinct())
        discard(*spent)
    schema = f"{group} {dict(prior.dtypes)[group]}, round int, changed boolean"
    history = reduce(DataFrame.unionByName, log) if log else prior.sparkSession.createDataFrame([], schema)
    return overlaid(), history


def cold(groups: DataFrame, reads: DataFrame, run: Run, schema: str, group: str = "group", rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The same from nothing: every group is dirty, and there are no results. schema: of these."""
    return warm(groups.sparkSession.createDataFrame([], schema), reads, groups, run, group, rounds)
