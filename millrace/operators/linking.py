"""Joins: references to targets, audits, suppression, collisions, containment, satisfaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_tier(candidates: DataFrame, ref: str = "ref", tier: str = "tier") -> DataFrame:
    """Of the candidates (ref, tier, hit) of each reference those of its lowest tier. The minimum is aggregated first, so a reference with many candidates sends one row a task."""
    lowest = candidates.groupBy(ref).agg(F.min(tier).alias(tier))
    return candidates.join(lowest, [ref, tier])


def resolved(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """Reference, target, and whether it is ambiguous.

    references: ref and candidates, an array of names from the narrowest scope to the widest.
    declarations: name and id. The first tier that has a hit decides; its smallest id is the target.
    References without a hit have a null target. Declarations are put together by name before the join, so
    a name that many share costs a reference one row.
    """
    tried = references.select("ref", F.posexplode("candidates").alias("tier", "name"))
    declared = declarations.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    hits = tried.join(declared, "name").groupBy("ref", "tier").agg(F.min("least").alias("target"), (F.min("least") < F.max("most")).alias("many"))
    first = hits.groupBy("ref").agg(F.min_by(F.struct("target", "many"), "tier").alias("b"))
    return references.select("ref").join(first, "ref", "left").select("ref", F.col("b.target").alias("target"), F.coalesce("b.many", F.lit(False)).alias("ambiguous"))


def attached(subjects: DataFrame, items: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Items with their subject, and the items whose subject is unknown."""
    return items.join(subjects, on), items.join(subjects.select(on), on, "left_anti")


def missing(required: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """Required rows without a row that fulfils them: audits, dangling references, unused suppressions, survivors."""
    return required.join(found.select(*on).distinct(), list(on), "left_anti")


def suppressed(findings: DataFrame, suppressions: DataFrame, on: Sequence[str], exempt: Column) -> DataFrame:
    """Findings that stay: without a suppression, or exempt from any."""
    marks = suppressions.select(*on).distinct().withColumn("_removed", F.lit(True))
    return findings.join(marks, list(on), "left").where(F.col("_removed").isNull() | exempt).drop("_removed")


def satisfying(members: DataFrame, wanted: DataFrame, owner: str = "owner", member: str = "member") -> DataFrame:
    """Owners that have every wanted member: relational division by counting matches."""
    need = wanted.select(member).distinct()
    matched = members.select(owner, member).distinct().join(need, member).groupBy(owner).agg(F.count("*").alias("n"))
    return matched.join(need.agg(F.count("*").alias("n")), "n").select(owner)


def unsatisfied(members: DataFrame, wanted: DataFrame, owner: str = "owner", member: str = "member") -> DataFrame:
    """Each owner with each wanted member that it lacks. wanted is one contract, a list that stays small beside the owners."""
    each = members.select(owner).distinct().withColumn("_k", F.lit(1)).join(wanted.select(member).distinct().withColumn("_k", F.lit(1)), "_k").drop("_k")
    return each.join(members.select(owner, member).distinct(), [owner, member], "left_anti")


def compared(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per owner that has one of the names: counts of wanted members (name, sig) it has, has with another signature, and lacks."""
    need = wanted.select("name", F.col("sig").alias("want")).distinct()
    total = need.agg(F.count("*").alias("total"))
    by_name = members.select("owner", "name", "sig").distinct().join(need, "name")
    per = by_name.groupBy("owner", "name", "want").agg(F.max((F.col("sig") == F.col("want")).cast("int")).alias("ok"))
    done = per.groupBy("owner").agg(F.sum("ok").alias("matched"), F.sum(1 - F.col("ok")).alias("mismatched"), F.count("*").alias("seen"))
    return done.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").select("owner", "matched", "mismatched", (F.col("total") - F.col("seen")).alias("missing"))


def reconciled(staged: DataFrame, found: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """What a write has to do at each path: created, updated, unchanged or deleted."""
    s, d = staged.select(key, F.col(digest).alias("_s"), F.lit(1).alias("_new")), found.select(key, F.col(digest).alias("_d"), F.lit(1).alias("_old"))
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(F.col("_s").eqNullSafe(F.col("_d")), "unchanged").otherwise("updated")
    return s.join(d, key, "full").select(key, action.alias("action"))


def merged_by_precedence(layers: Sequence[DataFrame], key: str = "path") -> DataFrame:
    """Of each key the row of the last layer that has it, with that layer's number from 1."""
    rows = None
    for k, layer in enumerate(layers, 1):
        layer = layer.withColumn("layer", F.lit(k))
        rows = layer if rows is None else rows.unionByName(layer)
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "layer").alias("_w"))
    return best.select(key, *[F.col(f"_w.{c}").alias(c) for c in rest])


def ancestors(path: Column) -> Column:
    """The directories above a slash path, outermost first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def clashes(paths: DataFrame) -> DataFrame:
    """path and clash of each path (case-folded): `case` (another spelling exists), `directory` (another path needs it as a directory), `file` (it needs a file as a directory), `none`; the first of these that applies.

    Equi-joins on folded paths and on their directories; no path is compared with all others.
    """
    p = paths.select("path").distinct().withColumn("folded", F.lower("path"))
    spellings = p.groupBy("folded").agg(F.count("*").alias("spellings"))
    needed = p.select(F.explode(ancestors(F.col("folded"))).alias("folded")).distinct().withColumn("needed", F.lit(True))
    under = p.select("path", F.explode(ancestors(F.col("folded"))).alias("folded")).join(p.select("folded").distinct(), "folded").select("path").distinct().withColumn("under", F.lit(True))
    all_ = p.join(spellings, "folded").join(needed, "folded", "left").join(under, "path", "left")
    return all_.select("path", F.when(F.col("spellings") > 1, "case").when(F.col("needed"), "directory").when(F.col("under"), "file").otherwise("none").alias("clash"))


def collisions(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row settles on, with how many."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def mixed(rows: DataFrame, unit: str, part: str) -> DataFrame:
    """Units whose rows differ in part."""
    return rows.groupBy(unit).agg(F.min(part).alias("_a"), F.max(part).alias("_b")).where("_a <> _b").select(unit)


def longest_prefix(rows: DataFrame, path: Column, roots: DataFrame, root: str = "root") -> DataFrame:
    """rows with the innermost root (slash path) that is the path or lies above it; rows without one go.

    The path's own prefixes are joined to the roots by equality, so the cost is rows times depth.
    """
    prefixes = F.concat(ancestors(path), F.array(path))
    tried = rows.select("*", F.explode(prefixes).alias("_p"))
    hit = tried.join(roots.select(F.col(root).alias("_p")).distinct(), "_p")
    return hit.groupBy(*rows.columns).agg(F.max_by("_p", F.length("_p")).alias(root))


def nearest_ancestor(rows: DataFrame, directory: str, marks: DataFrame) -> DataFrame:
    """rows with the nearest directory, upward from their own, that marks (dir) lists; null without one."""
    tried = rows.select("*", F.explode(F.concat(ancestors(F.col(directory)), F.array(directory))).alias("_d"))
    hit = tried.join(marks.select(F.col("dir").alias("_d")).distinct(), "_d").groupBy(directory).agg(F.max_by("_d", F.length("_d")).alias("nearest"))
    return rows.join(hit, directory, "left")


def qualified(references: DataFrame, homes: DataFrame) -> DataFrame:
    """References (ref, target, package) with the package to spell before the target: its home's, null where it is the reference's own or unknown."""
    home = homes.select(F.col("id").alias("target"), F.col("package").alias("_home"))
    return references.join(home, "target", "left").withColumn("qualifier", F.when(F.col("_home") != F.col("package"), F.col("_home"))).drop("_home")


def importable(references: DataFrame, exports: DataFrame, owner: str = "owner", target: str = "target") -> DataFrame:
    """Owners all of whose references are exported."""
    known = exports.select(target).distinct().withColumn("_ok", F.lit(True))
    return references.join(known, target, "left").groupBy(owner).agg(F.every(F.coalesce("_ok", F.lit(False))).alias("ok")).where("ok").select(owner)


def coalesced(rows: DataFrame, key: str, layers: Sequence[tuple[DataFrame, str]], value: str = "choice", default=None) -> DataFrame:
    """rows with the first non-null value that the layers, in order, have for the key, else the default: name resolution, policies."""
    out, columns = rows, []
    for k, (layer, column) in enumerate(layers):
        out = out.join(layer.select(F.col(key), F.col(column).alias(f"_c{k}")), key, "left")
        columns.append(F.col(f"_c{k}"))
    return out.withColumn(value, F.coalesce(*columns, F.lit(default))).drop(*[f"_c{k}" for k in range(len(columns))])


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in the order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")
