"""Near-duplicate embeddings by a pivot-permutation index.

Equal vectors of a label are one class, of which one is compared. A vector is described by its nearest
reference points (pivots). Two vectors are compared if they have the same label and share at least so
many of their nearest pivots: the inverted lists are kept for every combination of that many pivots, so
that a list holds exactly the vectors with that shared count, and a pair is counted in the list of its
smallest common combination alone. Lists too long for one task are cut into blocks, and every pair of
blocks is a task. Vectors in a list are verified by cosine in double precision.

How many pivots there are, how many describe a vector and how many are to be shared follows from a
bounded sample: of the settings by which enough of the hardest links (a cosine of just the threshold, in
any direction) share pivots, the one that compares least. Pivots are vectors of the sample, as unlike
as can be had, so that they lie where the vectors lie, in few dimensions or in a narrow cone too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import discard, materialize
from .components import components

PIVOTS, NEAREST, SHARED = 128, 6, 3
#: Settings that are tried: how many nearest pivots describe a vector, and how many are to be shared.
SETTINGS = ((6, 3), (8, 3), (8, 2), (10, 2), (4, 2), (4, 1), (3, 1), (2, 1))
#: The share of the hardest links that is enough; what an entry of a list, and the loss of all links, cost, in vectors compared.
ENOUGH, LIST_COST, LOSS = 0.97, 20, 2000
BLOCK = 1024
SHORT = 16  # vectors of a list that are tried pair by pair
SAMPLE, TRIED = 4096, 512


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, embedding, label) to vec_id, raw (a digest of label and values), cls (one of label and direction) and unit (the direction); cls and unit are null where the row links with nothing."""
    for batch in batches:
        column, labels = batch.column(1), batch.column(2).to_pylist()
        length = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        values = column.flatten()
        absent = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
        start = np.cumsum(length) - length
        raw, cls, unit = [b""] * len(labels), [None] * len(labels), [None] * len(labels)
        for d in np.unique(length).tolist():
            rows = np.flatnonzero(length == d)
            at = start[rows][:, None] + np.arange(d)
            x = flat[at]
            top = np.abs(x).max(1) if d else np.zeros(len(rows))
            with np.errstate(all="ignore"):
                u = x / top[:, None]
                u /= np.sqrt((u * u).sum(1))[:, None]
            good = np.isfinite(top) & (top > 0)
            for k, i in enumerate(rows.tolist()):
                tag = repr((labels[i], d if column[i].is_valid else None)).encode()
                holes = absent[at[k]].tobytes() if absent is not None and absent[at[k]].any() else b""
                raw[i] = xxhash.xxh3_128_digest(tag + x[k].tobytes() + holes)
                if good[k] and labels[i] is not None:
                    unit[i] = u[k].tobytes()
                    cls[i] = xxhash.xxh3_128_digest(tag + unit[i])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in (raw, cls, unit)), batch.column(2)], names=["vec_id", "raw", "cls", "unit", "label"])


class Pivots:
    """So many unit vectors of each length: from the sample, the rest at random, the same in every task. counts: of the lengths that have a number of their own."""

    def __init__(self, sample: dict[int, np.ndarray], count: int, counts: dict[int, int] | None = None, nearest: int = NEAREST, shared: int = SHARED, seed: int = 5) -> None:
        self.sample, self.counts, self.nearest, self.shared, self.seed, self._made = sample, counts or {}, nearest, shared, seed, {}
        self.count = max([count, *self.counts.values()])

    def __getitem__(self, d: int) -> np.ndarray:
        if d not in self._made:
            fill = _directions(self.count, d, self.seed)
            self._made = {d: np.vstack([self.sample.get(d, fill[:0]), fill])[: self.counts.get(d, self.count)]}  # one length at a time
        return self._made[d]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}}


def _directions(count: int, d: int, seed: int) -> np.ndarray:
    x = np.random.default_rng(seed + d).normal(size=(count, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivot_count(vectors: int) -> int:
    """A power of two of which the third power is 200 times the vectors of the largest label at least, and not below 128: so many keep the lists of unlike vectors short."""
    count = PIVOTS
    while count**3 < 200 * vectors:
        count *= 2
    return count


def _unlike(x: np.ndarray, most: int) -> np.ndarray:
    """At most so many rows of x in an order of which each beginning is spread out: at first no two alike, then ever more alike ones."""
    chosen, nearest = [], np.full(len(x), -1.0)
    for limit in (0.7, 0.8, 0.9, 0.95):
        while len(chosen) < most and (free := np.flatnonzero(nearest < limit)).size:
            chosen.append(free[0])
            nearest = np.maximum(nearest, x @ x[free[0]])
    return x[chosen]


def _nearest(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    return np.argpartition(-(x @ pivots.T), nearest, axis=1)[:, :nearest]


def _ordered(x: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """The nearest pivots of each row, the nearest first."""
    near = -(x @ pivots.T)
    at = np.argpartition(near, most, axis=1)[:, :most]
    return np.take_along_axis(at, np.argsort(np.take_along_axis(near, at, 1), axis=1), 1)


def _held(near: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros((len(near), count), np.float32)
    np.put_along_axis(out, near, 1, axis=1)
    return out


def hardest(x: np.ndarray, threshold: float, seed: int) -> np.ndarray:
    """For each row a vector at a cosine of just the threshold, in a direction at random."""
    side = np.random.default_rng(seed).normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    return threshold * x + np.sqrt(1 - threshold**2) * side


def _setting(x: np.ndarray, labels: np.ndarray, spread: np.ndarray, settings, vectors: int, threshold: float, seed: int) -> tuple[int, int, int]:
    """The number of pivots, of nearest ones, and of shared ones that compare least of those that find enough. x, labels: some vectors of the sample."""
    best, most, y = None, max(n for n, _ in settings), hardest(x, threshold, seed)
    some = labels[:256]
    i, j = np.triu_indices(len(some), 1)
    same = some[i] == some[j]
    count = 2 * PIVOTS // 16
    while count <= len(spread):
        a, b = _ordered(x, spread[:count], most), _ordered(y, spread[:count], most)
        for n, s in settings:
            held = _held(a[:, :n], count)
            found = float(((held * _held(b[:, :n], count)).sum(1) >= s).mean())
            pair = (held[:256] @ held[:256].T)[i[same], j[same]].astype(int)
            lists = np.array([comb(k, s) for k in range(n + 1)])[pair]  # in which two vectors of a label meet
            cost = LIST_COST * comb(n, s) + vectors * float(lists.mean() if len(lists) else 0) + LOSS * (1 - found)
            rank = (found < ENOUGH, -found if found < ENOUGH else cost)
            if best is None or rank < best[0]:
                best = rank, count, n, s
        count *= 2
    return best[1:]


def fit_pivots(classes: DataFrame, vectors: int, threshold: float = 0.98, seed: int = 5) -> Pivots:
    """From a sample of at most SAMPLE vectors of all lengths; vectors: how many the largest label has."""
    rows = classes.orderBy("cls").limit(SAMPLE).select("unit", "label").collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r.unit) // 8, []).append(r)
    nearest, shared, sample, counts, settings = NEAREST, SHARED, {}, {}, SETTINGS
    for d, own in sorted(by_length.items(), key=lambda e: (-len(e[1]), e[0])):  # the commonest length settles what is shared
        x = np.array([np.frombuffer(r.unit) for r in own])
        aside = min(TRIED, len(x) // 2) or len(x)  # settings are tried on vectors that are no pivots
        most = min(8 * pivot_count(vectors), SAMPLE)
        sample[d] = _unlike(x[aside % len(x) :], most)
        spread = np.vstack([sample[d], _directions(most - len(sample[d]), d, seed)])
        labels = np.unique([str(r.label) for r in own[:aside]], return_inverse=True)[1]
        count, nearest, shared = _setting(x[:aside], labels, spread, settings, vectors, threshold, seed)
        settings, counts[d] = ((nearest, shared),), count
        sample[d] = sample[d][:count].copy()
    return Pivots(sample, min(pivot_count(vectors), SAMPLE), counts, nearest, shared)


def _describe(pivots: Pivots):
    picks = np.array(list(combinations(range(pivots.nearest), pivots.shared)))
    base = pivots.count ** np.arange(pivots.shared - 1, -1, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, labels = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys, combos, nears = [None] * len(data), [None] * len(data), [b""] * len(data)
            by_dim: dict[int, list[int]] = {}
            for i, x in enumerate(data):
                by_dim.setdefault(len(x) // 8, []).append(i)
            for d, rows in by_dim.items():
                x = np.frombuffer(b"".join(data[i] for i in rows), np.float64).reshape(len(rows), d)
                near = np.sort(_nearest(x, pivots[d], pivots.nearest), axis=1).astype(np.int64)
                combo = (near[:, picks] * base).sum(2)
                for i, c, p in zip(rows, combo, near, strict=True):
                    salt = xxhash.xxh64_intdigest(f"{d}:{labels[i]}") >> 1
                    keys[i] = (salt ^ (c * 0x1000001)).tolist()
                    combos[i] = c.tolist()
                    nears[i] = p.astype(np.int32).tobytes()
            columns = [pa.array(keys, pa.list_(pa.int64())), pa.array(combos, pa.list_(pa.int64())), pa.array(nears, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *columns], names=["uid", "unit", "rows", "keys", "combos", "near"])

    return run


def _before(near: np.ndarray, combo: np.ndarray) -> np.ndarray:
    """Of every vector its pivots that come before the last of its combination and are not in it; -1 for none. near: a row of pivots a vector; combo: the same of one combination."""
    kept = np.where((near < combo[:, -1:]) & (near[:, :, None] != combo[:, None, :]).all(2), near, -1)
    return np.sort(kept, axis=1)[:, -(near.shape[1] - combo.shape[1]) :]


def _smallest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs whose other pivots are x and y, whether they share none: no smaller combination is common to them."""
    return ~((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any((1, 2))


def _parts(combo: np.ndarray, count: int, shared: int) -> np.ndarray:
    return np.stack([combo // count**k % count for k in range(shared - 1, -1, -1)], 1)


_FOUND = pa.schema({"kind": pa.int32(), "a": pa.int64(), "b": pa.int64()})


def _found(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], schema=_FOUND)


def _short_lists(uid, weight, unit: list[bytes], near, combo, starts, sizes, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of lists that are tried pair by pair, all at once."""
    lists = [starts[:0, None] + np.zeros((1, 2), np.int64)]
    for g in np.unique(sizes).tolist():
        i, j = np.triu_indices(g, 1)
        lists.append((starts[sizes == g][:, None, None] + np.stack([i, j], 1)).reshape(-1, 2))
    a, b = np.concatenate(lists).T
    width = np.array([len(u) // 8 for u in unit])
    for d in np.unique(width[a]).tolist():
        rows, place = np.flatnonzero(width == d), np.zeros(len(width), np.int64)
        place[rows] = np.arange(len(rows))
        x = np.frombuffer(b"".join(unit[i] for i in rows), np.float64).reshape(len(rows), d)
        own = np.flatnonzero(width[a] == d)
        step = max(1, (1 << 20) // d)
        for at in range(0, len(own), step):
            p, q = a[own[at : at + step]], b[own[at : at + step]]
            keep = (np.einsum("ij,ij->i", x[place[p]], x[place[q]]) >= threshold) & (uid[p] != uid[q])
            p, q = p[keep], q[keep]
            keep = _smallest(_before(near[p], combo[p]), _before(near[q], combo[q]))
            p, q = p[keep], q[keep]
            yield _found(0, np.r_[uid[p], uid[q]], np.r_[weight[q], weight[p]])
            yield _found(1, uid[p], uid[q])


def _long_list(uid, side, weight, x: np.ndarray, near, combo, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of one list, or a pair of its blocks: to each vector the number of vectors by links that belong to this list, and enough of these links to join all that they link."""
    other = _before(near, combo)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    linked = (np.clip(x[left] @ x[right].T, -1, 1) >= threshold) & (uid[left][:, None] != uid[right][None, :])
    i, j = np.nonzero(linked)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        linked[i[part], j[part]] = _smallest(other[left[i[part]]], other[right[j[part]]])
    same = side[0] == 2
    for at, n in [(left, linked @ weight[right]), *([] if same else [(right, weight[left] @ linked)])]:
        yield _found(0, uid[at[n > 0]], n[n > 0])
    if same:  # both sides are the same vectors
        linked = np.triu(linked)
    name, edges = np.arange(len(uid)), []
    for k in np.flatnonzero(linked.any(1)).tolist():
        met = right[linked[k]]
        names, first = np.unique(name[met], return_index=True)
        fresh = names != name[left[k]]
        if fresh.any():
            edges += [(left[k], met[f]) for f in first[fresh]]
            name[np.isin(name, names[fresh])] = name[left[k]]
    if edges:
        p, q = np.array(edges).T
        yield _found(1, uid[p], uid[q])


def _verified(threshold: float, pivots: Pivots):
    count, nearest, shared = pivots.count, pivots.nearest, pivots.shared

    """Rows (key, i, j, uid, side, combo, rows, unit, near), sorted by list and blocks, to the vectors that each is linked to (kind 0) and links (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            key = np.array([r[:3] for r in rows], np.int64)
            uid, side, combo, weight = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5, 6))
            unit, near = [r[7] for r in rows], np.frombuffer(b"".join([r[8] for r in rows]), np.int32).reshape(-1, nearest)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1) | (combo[1:] != combo[:-1])])
            sizes, combo = np.diff(np.r_[starts, len(rows)]), _parts(combo, count, shared)
            short = (sizes <= SHORT) & (side[starts] == 2)
            yield from _short_lists(uid, weight, unit, near, combo, starts[short], sizes[short], threshold)
            for at, n in zip(starts[~short].tolist(), sizes[~short].tolist(), strict=True):
                part = slice(at, at + n)
                x = np.frombuffer(b"".join(unit[part]), np.float64).reshape(n, -1)
                yield from _long_list(uid[part], side[part], weight[part], x, near[part], combo[part], threshold)

        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= BLOCK and row[:3] + row[5:6] != rows[-1][:3] + rows[-1][5:6]:
                    yield from done(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from done(rows)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per distinct row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal, and their cosine is
    at least the threshold. A vector that is null, empty, zero, or holds a null or a value that is not
    finite links with nothing; all others do, of any length and however large or small. Rows that
    repeat a vec_id with other values are vectors of their own. kept: the row names its component. An
    empty table gives no rows.
    """
    given = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"), vectors["label"].cast("string").alias("label"))
    rows = materialize(given.mapInArrow(units, "vec_id long, raw binary, cls binary, unit binary, label string"), "vectors")
    members = materialize(rows.select("vec_id", "raw", "cls").distinct(), "vector-members")
    sizes = members.where("cls is not null").groupBy("cls").agg(F.count("*").alias("rows"))
    classes = rows.where("cls is not null").select("cls", "label", "unit").dropDuplicates(["cls"]).join(sizes, "cls")
    classes = materialize(classes.withColumn("uid", F.monotonically_increasing_id()), "vector-classes")
    discard(rows)
    largest = classes.groupBy("label", F.length("unit")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    pivots = fit_pivots(classes, largest or 0, threshold)
    described = classes.select("uid", "unit", "label", "rows").mapInArrow(_describe(pivots), "uid long, unit binary, rows long, keys array<long>, combos array<long>, near binary")
    described = materialize(described, "described")
    entries = described.select("uid", F.explode(F.arrays_zip("keys", "combos")).alias("e")).select("uid", F.col("e.keys").alias("key"), F.col("e.combos").alias("combo"))
    lists = entries.groupBy("key", "combo").agg(F.count("*").alias("n")).where("n > 1")
    dealt = entries.join(lists, ["key", "combo"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise(F.when(F.col("own") < F.col("other"), 0).otherwise(1))
    dealt = dealt.select("uid", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "combo")
    full = dealt.join(described.select("uid", "rows", "unit", "near"), "uid").select("key", "i", "j", "uid", "side", "combo", "rows", "unit", "near")
    found = materialize(full.repartition("key", "i", "j").sortWithinPartitions("key", "combo", "i", "j").mapInArrow(_verified(threshold, pivots), "kind int, a long, b long"), "vector-links")
    discard(described)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("uid")).agg(F.sum("b").alias("n_links"))
    labels = components(found.where("kind = 1").select("a", "b"))
    placed = classes.select("cls", "uid", "rows").join(counts, "uid", "left").join(labels.withColumnRenamed("node", "uid"), "uid", "left")
    placed = placed.select("cls", (F.coalesce("n_links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("comp", "uid").alias("comp"))
    firsts = members.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("first")).join(placed, "cls")
    names = firsts.groupBy("comp").agg(F.min("first").alias("component_id"))
    linked = members.where("cls is not null").join(firsts.join(names, "comp"), "cls").select("vec_id", "n_links", "component_id")
    alone = members.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = {
    "op4_embedding_dedup": """
with recursive v as (select vec_id, label, cast(embedding as double[]) as x from embeddings),
u as (select * from v where label is not null and len(x) > 0 and len([y for y in x if y is null or not isfinite(y)]) = 0 and list_dot_product(x, x) > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and len(a.x) = len(b.x) and a.vec_id <> b.vec_id where list_cosine_similarity(a.x, b.x) >= 0.98),
r(node, comp) as (select vec_id, vec_id from v union select l.b, r.comp from r join l on l.a = r.node),
m as (select node, min(comp) as comp from r group by node)
select vec_id, (select count(*) from l where a = vec_id) as n_links, comp as component_id, vec_id = comp as kept from v join m on node = vec_id"""
}
