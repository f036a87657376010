"""Incremental recomputation: what a change makes dirty, and bringing results up to date.

The loops run on the driver; what they carry from round to round is written in the folder of
spark.checkpoint.dir, so that plans do not grow.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import facts


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a local one, but only if the executors are on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder: neither its lineage nor what the planner infers from it grows from round to round."""
    path = f"{shared_folder(df.sparkSession)}/millrace-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt by key where it is joined. A loop that broadcasts a table every round sends it through the driver every round."""
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut that no later plan reads."""
    for df in tables:
        path = getattr(df, "_millrace_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


class Seen:
    """What rounds have found, as written parts. Two parts of as many rounds are merged into one, so rows are written again as often as the logarithm of the rounds, and there are no more parts than that."""

    def __init__(self, first: DataFrame) -> None:
        self._parts: list[tuple[int, DataFrame]] = []
        self.add(first)

    def add(self, part: DataFrame) -> None:
        """part: a table made by cut. The one added last is not deleted by the next add, but may be by a later one."""
        parts, rank = self._parts, 0
        if len(parts) > 1:  # all but the newest can go into a larger part
            while len(parts) > 2 and parts[-2][0] == parts[-3][0]:
                (_, a), (rank, b) = parts[-3], parts[-2]
                parts[-3:-1] = [(rank + 1, cut(a.unionByName(b)))]
                discard(a, b)
        parts.append((0, part))

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [p for _, p in self._parts])


def reached(start: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """id and hop of everything that start (id) leads to by edges (id, next); hop is the fewest steps. Loops until nothing is new."""
    step = edges.select("id", F.col("next").alias("_next")).distinct()
    frontier = cut(start.select("id").distinct().withColumn("hop", F.lit(0)))
    seen, hop = Seen(frontier), 0
    while rounds is None or hop < rounds:
        hop += 1
        frontier = cut(frontier.select("id").join(step, "id").select(F.col("_next").alias("id")).distinct().join(seen.rows(), "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            discard(frontier)
            break
        seen.add(frontier)
    return seen.rows()


def reached_by(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """start and id of everything that each start leads to, itself included. starts: start, id; edges: id, next."""
    step = edges.select("id", F.col("next").alias("_next")).distinct()
    frontier = cut(starts.select("start", "id").distinct())
    seen = Seen(frontier)
    while not frontier.isEmpty():
        frontier = cut(frontier.join(step, "id").select("start", F.col("_next").alias("id")).distinct().join(seen.rows(), ["start", "id"], "left_anti"))
        seen.add(frontier)
    return seen.rows()


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node that it is linked with directly or not, for every node of links (a, b).

    Each round every node takes the smallest of its neighbours, what these have taken is followed to its
    end, twice as far at each step, and the links are contracted: each round leaves half of the nodes at
    most.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    names = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("comp"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p")))
        moved = True
        while moved:
            up = hook.select(F.col("x").alias("p"), F.col("p").alias("q"))
            further = cut(hook.select("x", "p").join(up, "p").select("x", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            discard(hook)
            hook = further
            moved = not hook.where("moved").isEmpty()
        renamed = cut(names.join(hook.select(F.col("x").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")))
        pa, pb = hook.select(F.col("x").alias("a"), F.col("p").alias("pa")), hook.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        contracted = cut(edges.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        discard(edges, names, hook)
        edges, names = contracted, renamed
    discard(edges)
    return names


def reached_through(start: DataFrame, uses: DataFrame, rounds: int | None = None) -> DataFrame:
    """id and hop of all that start (id) is tied to by sharing something: uses has id and via.

    Each round goes from the new ids to what they use and has not been seen, and from there to whoever
    uses it. Pairs of ids that share a thing are never made, so a thing that all use costs no more
    than its rows.
    """
    uses = cut(uses.select("id", "via").distinct())
    frontier = cut(start.select("id").distinct().withColumn("hop", F.lit(0)))
    seen, met, hop = Seen(frontier), None, 0
    while rounds is None or hop < rounds:
        hop += 1
        via = uses.join(frontier.select("id"), "id", "left_semi").select("via").distinct()
        via = cut(via if met is None else via.join(met.rows(), "via", "left_anti"))
        if met is None:
            met = Seen(via)
        else:
            met.add(via)
        frontier = cut(uses.join(via, "via", "left_semi").select("id").distinct().join(seen.rows(), "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    discard(uses, *(p for _, p in met._parts) if met is not None else ())
    return seen.rows()


def dirty_records(reads: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """record and hop of the records that a change of edges (edge) reaches.

    reads: edge, record. A record that reads a dirty edge is dirty, and so are the edges that it
    reads, hence records that share an edge with it.
    """
    uses = reads.select(F.col("record").alias("id"), F.col("edge").alias("via"))
    start = reads.join(edges.select("edge").distinct(), "edge", "left_semi").select(F.col("record").alias("id"))
    return reached_through(start, uses, rounds).select(F.col("id").alias("record"), "hop")


def closure_of_groups(start: DataFrame, members: DataFrame) -> DataFrame:
    """Groups that start (group) pulls in: groups that share a file, until none joins. members: group, file.

    The files of a group are linked with its first; a long chain of groups takes few rounds.
    """
    first = members.groupBy("group").agg(F.min("file").alias("first"))
    names = components(members.select("group", "file").join(first, "group").select(F.col("first").alias("a"), F.col("file").alias("b")))
    placed = first.join(names.withColumnRenamed("node", "first"), "first").select("group", "comp")
    return placed.join(placed.join(start.select("group").distinct(), "group", "left_semi").select("comp").distinct(), "comp", "left_semi").select("group")


def needed(start: DataFrame, needs: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """Units that start (unit) needs, directly or not, and that are not loaded. needs: unit, need."""
    out = reached(start.select(F.col("unit").alias("id")), needs.select(F.col("unit").alias("id"), F.col("need").alias("next"))).select(F.col("id").alias("unit"))
    return out if loaded is None else out.join(loaded.select("unit").distinct(), "unit", "left_anti")


def replayed(prior: DataFrame, fresh: DataFrame, rerun: DataFrame, record: str = "record") -> DataFrame:
    """Findings, reads or files after a partial run: those of records that did not run again, and the fresh ones."""
    return prior.join(rerun.select(record).distinct(), record, "left_anti").unionByName(fresh)


def warm_winners(before: DataFrame, claims: DataFrame, rerun: DataFrame, run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Facts after the listed subjects (subject) ran again, and the facts whose winner changed.

    before: the claims of the last run. run: makes the claims of the subjects it is given. Only the
    touched subjects are ranked again. The result equals that of a full run.
    """
    touched = rerun.select("subject").distinct()
    fresh = run(claims.join(touched, "subject", "left_semi"))
    prior_of_touched = facts.winners(before.join(touched, "subject", "left_semi"))
    now_of_touched = facts.winners(fresh)
    kept = facts.winners(before.join(touched, "subject", "left_anti"))
    return kept.unionByName(now_of_touched), facts.cutoff(prior_of_touched, now_of_touched)


def membership_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, package) in which declarations came or went: readers of the enumeration are dirty."""
    was, now = before.select("kind", "package", "id").distinct(), after.select("kind", "package", "id").distinct()
    return was.subtract(now).unionByName(now.subtract(was)).select("kind", "package").distinct()


def reusable(checks: DataFrame, reads: DataFrame, dirty: DataFrame) -> DataFrame:
    """Checks (check) none of whose reads (check, edge) is dirty (edge)."""
    hit = reads.join(dirty.select("edge").distinct(), "edge", "left_semi").select("check").distinct()
    return checks.join(hit, "check", "left_anti")
