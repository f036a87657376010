"""Facts: competing claims on (subject, key) and the one that holds.

A claim has the columns subject, key, value, authority, turn, plugin, ord. Of the claims on a key the
one of the highest authority holds, then of the lowest turn, plugin and ord; the value breaks what is
still equal, so the outcome never depends on the order of rows. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBJECT = ["subject", "key"]
SOURCE = ["authority", "turn", "plugin", "ord"]


def _best() -> list[Column]:
    return [F.desc("authority"), F.asc("turn"), F.asc("plugin"), F.asc("ord"), F.asc("value")]


def ranked(claims: DataFrame) -> DataFrame:
    """Every claim with its rank on its key, 1 for the one that holds."""
    return claims.withColumn("rank", F.row_number().over(Window.partitionBy(*SUBJECT).orderBy(*_best())))


def winners(claims: DataFrame) -> DataFrame:
    """The claim that holds for each key: an aggregation, so each task sends one row a key, however many claims a hot key has."""
    key = F.struct((-F.col("authority")).alias("_a"), "turn", "plugin", "ord", "value")
    rest = [c for c in claims.columns if c not in SUBJECT]
    best = claims.groupBy(*SUBJECT).agg(F.min_by(F.struct(*rest), key).alias("_w"))
    return best.select(*SUBJECT, *[F.col(f"_w.{c}").alias(c) for c in rest])


def winners_at_least(claims: DataFrame, floor: int) -> DataFrame:
    """The holding claims of that authority or a higher one. A weaker winner reads as absent; nothing ranks up in its place."""
    return winners(claims).where(F.col("authority") >= floor)


def conflicts(claims: DataFrame) -> DataFrame:
    """Sources (subject, key, authority, turn, plugin, ord) that claim more than one value, with how many."""
    return claims.groupBy(*SUBJECT, *SOURCE).agg(F.countDistinct("value").alias("n")).where("n > 1")


def admitted(claims: DataFrame) -> DataFrame:
    """Claims without repeats; of a source with several values none is admitted."""
    return claims.join(conflicts(claims).select(*SUBJECT, *SOURCE), SUBJECT + SOURCE, "left_anti").dropDuplicates([*SUBJECT, *SOURCE, "value"])


def withdrawn(claims: DataFrame, gone: Column) -> DataFrame:
    """The claims that are left when those for which gone holds are taken back."""
    return claims.where(~F.coalesce(gone, F.lit(False)))


def withdrawn_sources(claims: DataFrame, sources: DataFrame, on: Sequence[str]) -> DataFrame:
    """The claims without those of the listed sources, for instance of the invocations that run again."""
    return claims.join(sources.select(*on).distinct(), list(on), "left_anti")


def present(holding: DataFrame, tombstones: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Holding claims that no group tombstone outranks.

    tombstones: subject, and authority, turn, plugin, ord of the drop; with groups (group, key) also
    group, and it covers the keys of its group alone. The whole rank decides, and on equal rank the
    claim stays.
    """
    names = {c: f"t_{c}" for c in SOURCE}
    t = tombstones.select("subject", *([] if groups is None else ["group"]), *[F.col(c).alias(n) for c, n in names.items()])
    if groups is None:
        hides = holding["subject"] == F.col("t_subject")
        t = t.withColumnRenamed("subject", "t_subject")
    else:
        t = t.join(groups.select("group", F.col("key").alias("t_key")), "group").withColumnRenamed("subject", "t_subject")
        hides = (holding["subject"] == F.col("t_subject")) & (holding["key"] == F.col("t_key"))
    outranks = F.struct((-F.col("t_authority")).alias("a"), F.col("t_turn"), F.col("t_plugin"), F.col("t_ord")) < F.struct((-F.col("authority")).alias("a"), F.col("turn"), F.col("plugin"), F.col("ord"))
    return holding.join(t, hides & outranks, "left_anti")


def read(subjects: DataFrame, holding: DataFrame, key: str) -> DataFrame:
    """subjects (subject) with the value that holds for the key, null where it is absent."""
    return subjects.join(holding.where(F.col("key") == key).select("subject", "value"), "subject", "left")


def subjects_of(holding: DataFrame, key: str) -> DataFrame:
    """Subjects for which the key reads present."""
    return holding.where(F.col("key") == key).select("subject").distinct()


def tracked(subjects: DataFrame, holding: DataFrame, key: str, record: str) -> tuple[DataFrame, DataFrame]:
    """A read as read() makes it, and the edges (record, grain, subject, key) it leaves behind: misses are edges too."""
    edges = subjects.select(F.lit(record).alias("record"), F.lit("fact").alias("grain"), "subject", F.lit(key).alias("key")).distinct()
    return read(subjects, holding, key), edges


def claimed_by(claims: DataFrame, plugin) -> DataFrame:
    """Facts a plugin has claimed, whether they hold or not."""
    return claims.where(F.col("plugin") == plugin).select(*SUBJECT).distinct()


def overlaid(prior: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Prior claims of untouched subjects and the fresh ones of the touched."""
    return prior.join(touched.select("subject").distinct(), "subject", "left_anti").unionByName(fresh)


def cutoff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Facts whose holding value changed, came or went: only these make their readers dirty."""
    b = before.select(*SUBJECT, F.struct("value").alias("was"))
    a = after.select(*SUBJECT, F.struct("value").alias("now"))
    return b.join(a, SUBJECT, "full").where(~F.col("was").eqNullSafe(F.col("now"))).select(*SUBJECT)


def stamped(rows: DataFrame, key: str, value: Column, plugin, subject: str = "subject", authority: int = 0, turn: int = 0, ord_: Column | None = None) -> DataFrame:
    """Claims that a handler makes, one for each row."""
    return rows.select(F.col(subject).alias("subject"), F.lit(key).alias("key"), value.alias("value"), F.lit(authority).alias("authority"), F.lit(turn).alias("turn"), F.lit(plugin).alias("plugin"), (F.lit(0) if ord_ is None else ord_).alias("ord"))


def classification(holding: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per subject with a column for each key."""
    return holding.groupBy("subject").pivot("key", list(keys)).agg(F.first("value"))
