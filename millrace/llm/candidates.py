"""Links among candidate pairs and candidate sets, without expanding the sets into all their pairs.

All members of a set are first compared with one of them, its center. Where that leaves a set in more
than one component, only the members outside its main component are compared with the rest, and only
pairs whose sketches allow a link are taken up, the likeliest first: what these have joined needs no
others. A set too large for one task is first cut by finer
keys, of which members that can link share one: members that only a common passage has brought together
share few of them. Of a list that is large even so every task gets a part, and the members outside the
main component to compare with it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import discard, materialize
from .components import components

CHUNK = 2048
LARGE = 2 * CHUNK  # members from which a set is cut by finer keys
TRIES = (8,)  # partners of a member that are tried before the others
PAIRS = 1 << 16  # of possible partners, in an Arrow batch
ROWS = 200  # of two sets, sketches or lines, in an Arrow batch


def _find(joined: dict[int, int], comp: int) -> int:
    """What the component belongs to, after what has been joined here."""
    while comp in joined:
        if (further := joined[comp]) in joined:
            joined[comp] = joined[further]
        comp = further
    return comp


def _settled(left: list[tuple], right: list[tuple], i: np.ndarray, j: np.ndarray, joined: dict[int, int], alike: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of places in lists of members (ref, comp, whole, feature), the likeliest of each of the left first, those that join components, and those that cannot be told here and may.

    Of the pairs between two components few are looked at, then four times as many, until these are one:
    what is left out is joined already. All are looked at if nothing joins the two.
    """
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    alive, most, links, unsure = np.argsort(nth, kind="stable"), 1, [], []
    features = [r[3] for r in left], [r[3] for r in right]
    told = np.array([r[2] for r in left], bool)[i] & np.array([r[2] for r in right], bool)[j]
    while len(alive):
        names, root = np.unique([_find(joined, r[1]) for side in (left, right) for r in side], return_inverse=True)
        x, y = root[i[alive]], root[len(left) + j[alive]]
        between = np.minimum(x, y) * len(names) + np.maximum(x, y)
        alive, between = alive[x != y], between[x != y]
        order = np.argsort(between, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(between[order], between[order])
        now, alive = alive[place < most], alive[place >= most]
        if len(now):
            for k in now[alike(*features, i[now], j[now])].tolist():
                if not told[k]:
                    unsure.append(k)
                elif (x := _find(joined, left[i[k]][1])) != (y := _find(joined, right[j[k]][1])):
                    joined[max(x, y)] = min(x, y)
                    links.append(k)
        most *= 4
    return np.array(links, np.int64), np.array(unsure, np.int64)


def _crossing(finder: Callable[[list[tuple]], Callable], most: int | None, judge: tuple[Callable, Callable] | None = None, again: bool = False):
    """Rows (name, chunk, ref, comp, outside, home, features...), sorted by set and chunk, at home first, to pairs of refs in different components that the finder holds possible (kind 0) or that the judge has found linked (kind 1).

    A task compares the members outside the main component, a block of them at a time, with those that are
    at home in its chunk. finder: from the features of the latter to a function from those of any member to
    the numbers of its possible partners, the likeliest first. most: so many partners of a member are taken,
    or all. judge: see linked; the last feature is what it looks at. What it can tell is looked at without
    regard to most, unless it was before (again); of the rest so many are taken, and a row (kind 2) says that there were more.
    """

    drop = judge is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, others, i, j = [], [], [], []  # members (ref, comp, whole, last feature) of several sets, and places of pairs in them
        joined: dict[int, int] = {}  # components by what this task has found

        def pairs() -> pa.RecordBatch:
            x, y = np.array(i, np.int64), np.array(j, np.int64)
            kind = np.zeros(len(x), np.int32)
            if drop:
                if again:
                    unsure = ~(np.array([r[2] for r in refs], bool)[x] & np.array([r[2] for r in others], bool)[y])
                    x, y = x[unsure], y[unsure]
                links, rest = _settled(refs, others, x, y, joined, judge[1])
                rest = rest[np.argsort(x[rest], kind="stable")]
                first = np.arange(len(rest)) - np.searchsorted(x[rest], x[rest]) < (most or len(rest))
                kind = np.repeat(np.array([1, 0, 2], np.int32), [len(links), first.sum(), min(1, (~first).sum())])
                use = np.r_[links, rest[first], rest[~first][:1]]
                x, y = x[use], y[use]
            both = np.array([r[0] for r in refs], np.int64)[x], np.array([r[0] for r in others], np.int64)[y]
            for part in (refs, others, i, j):
                part.clear()
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.minimum(*both)), pa.array(np.maximum(*both))], names=["kind", "a", "b"])

        def member(row: tuple) -> tuple:
            return (row[0], row[1], judge[0](row[-1]), row[-1]) if drop else (row[0],)

        def done(home: list[tuple], found: list[Callable], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            def settle() -> tuple[int, np.ndarray]:
                others.extend(map(member, home))
                return len(others) - len(home), np.array([_find(joined, r[1]) for r in home], np.int64)

            if drop and again and all(judge[0](r[-1]) for r in home):
                rows = [r for r in rows if not judge[0](r[-1])]
                if not rows:
                    return
            if not found:
                found.append(finder([r[4 : len(r) - drop] for r in home]))
            partners = found[0]
            begin, comps = settle()
            for row in rows:
                _, comp, _, _, *features = row
                tried = partners(*features[: len(features) - drop])
                tried = (begin + tried[comps[tried] != _find(joined, comp)][: None if drop else most]).tolist()
                if not tried and drop:
                    continue
                i.extend([len(refs)] * len(tried))
                j.extend(tried)
                refs.append(member(row))
                if len(i) > PAIRS:
                    yield pairs()
                    begin, comps = settle()
            if len(refs) + len(others) > 2 * CHUNK:
                yield pairs()

        at, home, found, rows = None, [], [], []
        for batch in batches:
            for name, chunk, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, chunk) != at or len(rows) >= CHUNK and not row[3]:
                    if rows and home:
                        yield from done(home, found, rows)
                    rows = []
                    if (name, chunk) != at:
                        at, home, found = (name, chunk), [], []
                if row[3]:
                    home.append(tuple(row))
                if row[2]:
                    rows.append(tuple(row))
        if rows and home:
            yield from done(home, found, rows)
        if i:
            yield pairs()

    return run


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components that more links make of components: only the latter are contracted anew."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    every = materialize(labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp"))), "labels")
    name = lambda k: every.select(F.col("node").alias(k), F.col("comp").alias(f"_{k}"))
    more = components(links.join(name("b"), "b").join(name("a"), "a").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    out = materialize(every.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("_comp")), "comp", "left").select("node", F.coalesce("_comp", "comp").alias("comp")), "labels")
    discard(every, more)
    return out


def _open(placed: DataFrame) -> DataFrame:
    """Of lists (name, ref, comp) in more than one component: their size, and outside, which members are not in the main one."""
    parts = placed.groupBy("name", "comp").agg(F.count("*").alias("n"))
    main = parts.groupBy("name").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    return placed.join(main, "name").select("name", "ref", "comp", "size", (F.col("comp") != F.col("main")).alias("outside"))


def linked(pairs: DataFrame, sets: DataFrame, screen: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], finder, finer, judge: tuple[DataFrame, Callable, Callable] | None = None) -> DataFrame:
    """The components that verified links make; as many links are verified as join what is linked.

    pairs: a, b. sets: name, ref and features, a row for each member. screen: from pairs (a, b, and the
    features of both by name_a and name_b) to those that can be linked. verify: from pairs to those that are. finder: see _crossing. finer: from a
    table of refs to (ref, key), keys of which refs that can be linked share one. judge: a table of refs and
    one more feature of each, a function from a member's to whether it is whole, and one from those of some members, those of others, and
    places in both to which pairs are linked, if both are whole, or can be linked still. A set may hold members by the square of
    which the sketches tell nothing: these pairs are settled where both lie, and only links that join components are rows.
    """
    features = [c for c in sets.columns if c not in ("name", "ref")]
    centers = sets.groupBy("name").agg(F.min("ref").alias("ref")).join(sets, ["name", "ref"])
    centers = centers.select("name", F.col("ref").alias("a"), *[F.col(c).alias(f"{c}_a") for c in features])
    star = sets.join(centers, "name").where("ref <> a").select("a", F.col("ref").alias("b"), *[F.col(c).alias(f"{c}_b") for c in features], *[f"{c}_a" for c in features])
    tested = materialize(pairs.union(screen(star)).distinct(), "tested", ROWS)
    links = materialize(verify(tested), "verified", ROWS)
    labels = components(links)
    discard(links)
    slim = sets.select("ref", *features).dropDuplicates(["ref"])
    if judge is not None:
        slim = slim.join(judge[0], "ref")
    # The likeliest partners first: most lists are one component then. The last round leaves nothing out.
    for most in (*TRIES, None):
        placed = sets.select("name", "ref").join(labels.withColumnRenamed("node", "ref"), "ref", "left").select("name", "ref", F.coalesce("comp", "ref").alias("comp"))
        open_ = materialize(_open(placed), "open")
        before, large = [open_], open_.where(F.col("size") > LARGE)
        if not large.isEmpty():
            keys = large.select("name", "ref", "comp").join(finer(large.select("ref")), "ref")
            cut = materialize(_open(keys.select(F.xxhash64("name", "key").alias("name"), "ref", "comp").distinct()), "cut")
            open_, before = open_.where(F.col("size") <= LARGE).unionByName(cut), [open_, cut]
        open_ = open_.withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
        own = F.pmod(F.xxhash64("ref"), F.col("chunks")).cast("int")
        chunk = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
        dealt = open_.withColumn("own", own).withColumn("chunk", F.explode(chunk)).withColumn("home", F.col("chunk") == F.col("own"))
        dealt = dealt.join(slim, "ref").select("name", "chunk", "ref", "comp", "outside", "home", *[c for c in slim.columns if c != "ref"])
        dealt = dealt.repartition("name", "chunk").sortWithinPartitions("name", "chunk", F.desc("home"))
        crossing = dealt.mapInArrow(_crossing(finder, most, judge and judge[1:], most is None), "kind int, a long, b long")
        told = None
        if judge is not None:
            told = crossing = materialize(crossing, "crossing")
            discard(*before)
        more = judge is None or not told.where("kind = 2").isEmpty()
        links = [] if told is None or told.where("kind = 1").isEmpty() else [told.where("kind = 1").select("a", "b")]
        if told is None or not told.where("kind = 0").isEmpty():
            fresh = materialize(crossing.where("kind = 0").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "crossing", ROWS)
            if judge is None:
                discard(*before)
            if not fresh.isEmpty():
                links.append(materialize(verify(fresh), "verified", ROWS))
                if most is not None and more:
                    tested, old = materialize(tested.union(fresh), "tested"), tested
                    discard(old)
            discard(fresh)
        if links:
            labels, old = _joined(labels, functools.reduce(DataFrame.union, links)), labels
            discard(*links, old)
        if told is not None:
            discard(told)
        if not more:
            break
    discard(tested)
    return labels
