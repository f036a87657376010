"""Differences between generations, and set operations that keep count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def generation_diff(before: DataFrame, after: DataFrame, key: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """key and change (added, removed, changed) of what differs between two generations. Digests or the values themselves can be compared."""
    b = before.select(*key, F.struct(*compare).alias("_was"))
    a = after.select(*key, F.struct(*compare).alias("_now"))
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_now").isNull(), "removed").when(~F.col("_was").eqNullSafe(F.col("_now")), "changed")
    return b.join(a, list(key), "full").select(*key, change.alias("change")).where("change is not null")


def moved_and_vanished(was: DataFrame, now: DataFrame, key: str = "path", stat: Sequence[str] = ("size", "mtime")) -> DataFrame:
    """Files whose stat differs or that are gone; files that are new need no notice."""
    return generation_diff(was, now, [key], stat).where("change <> 'added'")


def differing_lists(before: DataFrame, after: DataFrame, subject: str, order: Sequence[str], value: str) -> DataFrame:
    """Subjects whose ordered lists differ, an absent list being empty."""
    lists = lambda d, n: d.groupBy(subject).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias(n))
    both = lists(before, "_b").join(lists(after, "_a"), subject, "full")
    return both.where(~F.col("_b").eqNullSafe(F.col("_a"))).select(subject)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that only one side has."""
    a, b = a.distinct(), b.distinct()
    return a.subtract(b).unionByName(b.subtract(a))


def row_diff(prior: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """What a sorted table has to write: key, value, dead; changed and new rows, and marks for those that are gone."""
    p = prior.select(key, F.struct(value).alias("_p"))
    r = rows.select(key, F.struct(value).alias("_r"))
    both = p.join(r, key, "full").where(~F.col("_p").eqNullSafe(F.col("_r")))
    return both.select(key, F.col(f"_r.{value}").alias(value), F.col("_r").isNull().alias("dead"))


def newest(runs: DataFrame, key: str, run: str = "run") -> DataFrame:
    """Of each key the row of the newest run; a dead one means that there is none."""
    rest = [c for c in runs.columns if c != key]
    best = runs.groupBy(key).agg(F.max_by(F.struct(*rest), run).alias("_w")).select(key, *[F.col(f"_w.{c}").alias(c) for c in rest])
    return best.where("not dead") if "dead" in rest else best


def lost_lines(committed: DataFrame, fresh: DataFrame, text: str) -> DataFrame:
    """Committed lines, with repeats, whose text is nowhere in the fresh ones. A null text never matches."""
    return committed.join(fresh.select(text).distinct(), text, "left_anti")


def first_free(wanted: DataFrame, taken: DataFrame, candidates: Column, key: str = "id", tries: int = 64) -> DataFrame:
    """key and name: the first candidate of each row that is not taken, else the last with the smallest free number behind it.

    The rows see the names taken before, not each other's. tries bounds the numbers looked at. Names that
    are taken are read as a name and a number, so numbers are looked up, not made for each row.
    """
    names = taken.select("name").where("name is not null").distinct()
    tried = wanted.select(key, F.posexplode(candidates).alias("_at", "name"))
    free = tried.join(names, "name", "left_anti").groupBy(key).agg(F.min_by("name", "_at").alias("name"))
    digits = F.sequence(F.lit(1), F.lit(len(str(tries - 1))))
    split = names.select("name", F.explode(digits).alias("_d")).select(F.expr("left(name, length(name) - _d)").alias("_base"), F.expr("right(name, _d)").alias("_number"), "_d").where("length(_number) = _d and _number rlike '^(0|[1-9][0-9]*)$'")
    used = split.select("_base", F.col("_number").cast("int").alias("_number")).where(F.col("_number") < tries).groupBy("_base").agg(F.collect_set("_number").alias("_used"))
    rest = wanted.select(key, F.try_element_at(candidates, F.lit(-1)).alias("_base")).join(free.select(F.col(key).alias("_free")), F.col(key).eqNullSafe(F.col("_free")), "left_anti").join(used, "_base", "left")
    every = F.sequence(F.lit(0), F.lit(tries - 1))
    number = F.array_min(F.array_except(every, F.coalesce("_used", F.array().cast("array<int>"))))
    numbered = rest.select(key, "_base", number.alias("_number")).where("_number is not null").groupBy(key).agg(F.min_by(F.concat("_base", F.col("_number").cast("string")), "_number").alias("name"))
    return free.unionByName(numbered)
