"""Scans over declarations, gates before handlers, and the order of matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["lang", "package", "owner", "name", "kind", "disc"]


def by_kind(symbols: DataFrame, kind) -> DataFrame:
    """Declarations of a kind; the filter reaches the scan."""
    return symbols.where(F.col("kind") == kind)


def carrying(symbols: DataFrame, directives: DataFrame, on: Sequence[str]) -> DataFrame:
    """Declarations that carry one of the directives."""
    return symbols.join(directives.select(*on).distinct(), list(on), "left_semi")


def lookup(symbols: DataFrame, wanted: dict) -> DataFrame:
    """Declarations whose key columns all equal the wanted values; null-free, as identities are."""
    found = symbols
    for column, value in wanted.items():
        found = found.where(F.col(column) == F.lit(value))
    return found


def in_directory(path: Column, pattern: str) -> Column:
    """Whether a slash path lies in a directory pattern: `dir` alone, or `dir/...` with what is below; `...` is everything."""
    if pattern == "...":
        return F.lit(True)
    if pattern.endswith("/..."):
        base = pattern[: -len("/...")]
        return (path == base) | path.startswith(base + "/")
    return path == pattern


def admits(rows: DataFrame, lang: str | None = None, directory: str | None = None, module: str | None = None) -> DataFrame:
    """Rows (lang, dir, module) that the sources of a plan cover; an absent part does not restrict."""
    if lang is not None:
        rows = rows.where(F.col("lang") == lang)
    if directory is not None:
        rows = rows.where(in_directory(F.col("dir"), directory))
    return rows if module is None else rows.where(F.col("module") == module)


def gated(subjects: DataFrame, instances: DataFrame, on: str = "subject") -> DataFrame:
    """One match for each instance, not negated, of the gating directive."""
    return subjects.join(instances.where(~F.col("negated")).drop("negated"), on)


def not_skipped(matches: DataFrame, skips: DataFrame, on: str = "subject", plugin: str = "plugin") -> DataFrame:
    """Matches whose subject has not opted out of their plugin. A skip with a null plugin opts out of all."""
    s = skips.select(F.col(on).alias("_subject"), F.col(plugin).alias("_plugin")).distinct()
    every = s.where("_plugin is null").select("_subject")
    some = s.where("_plugin is not null")
    left = matches.join(every, F.col(on) == F.col("_subject"), "left_anti")
    return left.join(some, (F.col(on) == F.col("_subject")) & (F.col(plugin) == F.col("_plugin")), "left_anti")


def has_key(rows: DataFrame, holding: DataFrame, key, on: str = "subject") -> DataFrame:
    return rows.join(holding.where(F.col("key") == key).select(F.col("subject").alias(on)).distinct(), on, "left_semi")


def key_equals(rows: DataFrame, holding: DataFrame, key, value, on: str = "subject") -> DataFrame:
    return rows.join(holding.where((F.col("key") == key) & (F.col("value") == value)).select(F.col("subject").alias(on)).distinct(), on, "left_semi")


def lacks_key(rows: DataFrame, holding: DataFrame, key, on: str = "subject") -> DataFrame:
    """The negation of has_key: an absent fact counts."""
    return rows.join(holding.where(F.col("key") == key).select(F.col("subject").alias(on)).distinct(), on, "left_anti")


def numbered(matches: DataFrame, rule: str = "rule", subject: str = "subject", instance: str = "instance") -> DataFrame:
    """Matches with their place (seq, from 1) in the canonical order of a rule: subject, then instance. Rules are numbered apart, so no task has all rows."""
    return matches.withColumn("seq", F.row_number().over(Window.partitionBy(rule).orderBy(subject, instance)))


def ordered(rows: DataFrame, *columns) -> DataFrame:
    """A total order for output: a range-partitioned sort."""
    return rows.orderBy(*columns)


def selected(matches: DataFrame, selection: DataFrame, on: Sequence[str]) -> DataFrame:
    """Matches that are listed to run again."""
    return matches.join(selection.select(*on).distinct(), list(on), "left_semi")
