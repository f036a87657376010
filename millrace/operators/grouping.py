"""Grouping with a defined order inside each group, counts, and inverted indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accumulated(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, out: str = "members") -> DataFrame:
    """Of each key the values in the given order, joined by commas. What a group holds is its output; groups larger than that belong in accumulated_rows."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("string").alias("_v"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(items, lambda x: x["_v"]), ",").alias(out))


def accumulated_rows(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The same as rows: sorted within range partitions by key and order, for groups of any size."""
    return rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)


def routed(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Destinations with how many rows go to each."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"))


def distinct_sorted(rows: DataFrame, key: Sequence[str], value: str, out: str) -> DataFrame:
    """Of each key its distinct values in ascending order, joined by commas: derivations, imports, readers."""
    return rows.select(*key, value).distinct().groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.col(value).cast("string"))), ",").alias(out))


def merged_index(prior: DataFrame, fresh: DataFrame, touched: DataFrame, edge: str = "edge", record: str = "record") -> DataFrame:
    """An inverted index (edge, record) brought up to date: touched records lose their old edges and get the fresh ones."""
    kept = prior.join(touched.select(record).distinct(), record, "left_anti").select(edge, record)
    return kept.unionByName(fresh.select(edge, record)).distinct()


def two_level_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by (outer, inner), and of each outer over all inners, marked by level 1 and 0: one pass over the rows."""
    return rows.rollup(outer, inner).agg(F.count("*").alias("n"), F.grouping_id().alias("_g")).where("_g < 3").select(outer, inner, F.when(F.col("_g") == 0, 1).otherwise(0).alias("level"), "n")


def counted_if(rows: DataFrame, key: Sequence[str], **conditions: Column) -> DataFrame:
    """Per key how many rows fulfil each condition."""
    return rows.groupBy(*key).agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(name) for name, c in conditions.items()])


def arity_faults(units: DataFrame, uses: DataFrame, roles: Sequence[tuple[str, int, int | None]], unit: str = "unit", role: str = "role") -> DataFrame:
    """Units whose count of a role is not admitted. roles: name, least and most (None: any), a short fixed list."""
    spec = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(lo).alias("lo"), F.lit(hi).cast("int").alias("hi")) for r, lo, hi in roles])
    each = units.select(unit).distinct().select(unit, F.explode(spec).alias("s")).select(unit, F.col("s.role").alias(role), "s.lo", "s.hi")
    n = uses.groupBy(unit, role).agg(F.count("*").alias("_n"))
    full = each.join(n, [unit, role], "left").withColumn("n", F.coalesce("_n", F.lit(0)))
    return full.where((F.col("n") < F.col("lo")) | (F.col("hi").isNotNull() & (F.col("n") > F.col("hi")))).select(unit, role, "n")


def validated(instances: DataFrame, repeatable: Sequence[str], requires: Sequence[tuple[str, str]], conflicts: Sequence[tuple[str, str]]) -> DataFrame:
    """Faults (subject, fault, name) of the directive instances (subject, name, negated) of each subject.

    `duplicate`: a name that is not repeatable occurs again with the same polarity. `polarity`: a name
    is both stated and negated. `requires`, `conflicts`: of the pairs, the second is absent or present.
    """
    per = instances.groupBy("subject", "name").agg(F.sum(F.when(F.col("negated"), 0).otherwise(1)).alias("yes"), F.sum(F.when(F.col("negated"), 1).otherwise(0)).alias("no"))
    again = per.where(((F.col("yes") > 1) | (F.col("no") > 1)) & ~F.col("name").isin(list(repeatable) or [""])).select("subject", F.lit("duplicate").alias("fault"), "name")
    both = per.where("yes > 0 and no > 0").select("subject", F.lit("polarity").alias("fault"), "name")
    stated = per.where("yes > 0")
    names = stated.groupBy("subject").agg(F.collect_set("name").alias("names"))
    has = lambda n: F.array_contains("names", n)
    checks = [F.when(has(a) & ~has(b), F.struct(F.lit("requires").alias("fault"), F.lit(a).alias("name"))) for a, b in requires]
    checks += [F.when(has(a) & has(b), F.struct(F.lit("conflicts").alias("fault"), F.lit(a).alias("name"))) for a, b in conflicts]
    out = again.unionByName(both)
    if checks:
        out = out.unionByName(names.select("subject", F.explode(F.array_compact(F.array(*checks))).alias("c")).select("subject", "c.fault", "c.name"))
    return out.distinct()
