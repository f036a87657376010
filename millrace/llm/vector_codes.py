"""Vector code compression: product codebooks by Lloyd's rounds with Elkan's bounds.

Vectors of integers are cut into four parts, each part is known by the nearest entry of its codebook, and
the entries move to the mean of their parts. A table holds for every part, from round to round, its
entry, an upper bound on the distance to it and a lower bound on the distance to every entry. When
entries have moved, bounds are shifted by how far. An entry is passed over where its lower bound, or half
its distance from the present entry, is strictly above the upper bound; distances to the others are taken
in whole numbers, so that ties are certain and go to the lower entry. Lower bounds are kept in a byte
each, rounded down to steps of the largest.

The driver holds the codebooks alone: of four parts, 256 entries of the vectors' length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import discard, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BATCH_ROWS, WIDTH = 4096, 64
MARGIN = 1e-12  # relative, by which bounds are let out for rounding
STEPS = 255

Books = dict[int, list[np.ndarray]]  # by the length of vectors, of every part its entries
_STATE = "vec_id long, label string, d int, x binary, code binary, upper binary, lower binary, steps binary"


def _edges(d: int) -> list[int]:
    return [k * d // PARTS for k in range(PARTS + 1)]


def _largest(d: int) -> int:
    """Components are held within this, so that squared distances over d components stay within 62 bits."""
    return 1 << ((62 - max(d - 1, 0).bit_length()) // 2 - 1)


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, embedding, label) to vec_id, label, d and x (integer components) of those that have only finite ones."""
    for batch in batches:
        column = batch.column(1)
        length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are not finite
        start = np.cumsum(length) - length
        whole = np.r_[0, np.cumsum(~np.isfinite(values))]
        good = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (whole[start + length] == whole[start]))
        data = []
        with np.errstate(over="ignore"):
            floors = np.floor(values * SCALE)
        for k in good.tolist():
            d = int(length[k])
            most = _largest(d)
            data.append(np.clip(floors[start[k] : start[k] + d], -most, most).astype("<i4").tobytes())
        at = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(length[good].astype(np.int32)), pa.array(data, pa.binary())], names=["vec_id", "label", "d", "x"])


def first_books(vectors: DataFrame, entries: int = ENTRIES) -> Books:
    """Of each length of vectors, the parts of those of the smallest ids; of equal ids, the smallest bytes come first, and null ids last."""
    books: Books = {}
    for (d,) in vectors.select("d").distinct().collect():
        rows = vectors.where(F.col("d") == d).orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
        x = np.array([np.frombuffer(r.x, "<i4") for r in rows], np.int64).reshape(len(rows), d)
        books[d] = [x[:, a:b] for a, b in zip(_edges(d), _edges(d)[1:], strict=False)]
    return books


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # floating point is exact, and faster
        x, y = x.astype(np.float64), y.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in y], 1)


def _to(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to one vector, or to rows of y in turn, exact."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


class Bounds(NamedTuple):
    """Of one part of many vectors: the entry, an upper bound on the distance to it, lower bounds on the distances to all."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


class Geometry:
    """What pruning asks of a codebook: half the distances between entries, for each entry the smallest of these, and how far entries have moved."""

    def __init__(self, book: np.ndarray, before: np.ndarray | None) -> None:
        self.book = book
        half = np.sqrt(_squared(book, book)) * (0.5 * (1 - MARGIN))
        self.half = half
        self.nearest = np.where(np.eye(len(book), dtype=bool), np.inf, half).min(1, initial=np.inf)
        self.moved = np.sqrt(_to(book, before)) * (1 + MARGIN) if before is not None else None


def assign_all(x: np.ndarray, geometry: Geometry) -> Bounds:
    """The first assignment: every distance is taken."""
    squared = _squared(x, geometry.book)
    code = squared.argmin(1)  # the first of equal ones
    distance = np.sqrt(squared)
    return Bounds(code, distance[np.arange(len(x)), code] * (1 + MARGIN), distance * (1 - MARGIN))


def assign_again(x: np.ndarray, old: Bounds, geometry: Geometry) -> tuple[Bounds, int]:
    """The next assignment, and how many distances were taken."""
    code, upper = old.code.copy(), (old.upper + geometry.moved[old.code]) * (1 + MARGIN)
    lower = np.maximum(old.lower - geometry.moved, 0) * (1 - MARGIN)
    rows = np.flatnonzero(upper >= geometry.nearest[code])
    own, bound = code[rows], upper[rows, None]
    open_ = (lower[rows] <= bound) & (geometry.half[own] <= bound)
    open_[np.arange(len(rows)), own] = False
    some = open_.any(1)
    rows, open_, own = rows[some], open_[some], own[some]
    # The upper bound is made tight before others are looked at.
    part = x[rows]
    best = _to(part, geometry.book[own])
    tight = np.sqrt(best)
    lower[rows, own] = tight * (1 - MARGIN)
    tight = tight * (1 + MARGIN)
    taken = len(rows)
    for j in np.flatnonzero(open_.any(0)).tolist():
        at = np.flatnonzero(open_[:, j])
        at = at[(lower[rows[at], j] <= tight[at]) & (geometry.half[own[at], j] <= tight[at])]
        if not len(at):
            continue
        squared = _to(part[at], geometry.book[j])
        lower[rows[at], j] = np.sqrt(squared) * (1 - MARGIN)
        nearer = (squared < best[at]) | ((squared == best[at]) & (j < own[at]))
        taken += len(at)
        at, squared = at[nearer], squared[nearer]
        best[at], own[at], tight[at] = squared, j, np.sqrt(squared) * (1 + MARGIN)
    code[rows], upper[rows] = own, tight
    return Bounds(code, upper, lower), taken


def _packed(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds in bytes, and for each row the step of which they are multiples, rounded down."""
    step = lower.max(1, initial=0) / STEPS
    return np.floor(lower / np.where(step > 0, step, 1)[:, None]).astype(np.uint8), step


def _unpacked(data: np.ndarray, step: np.ndarray) -> np.ndarray:
    return data * (step[:, None] * (1 - MARGIN))


def _by_length(batch: pa.RecordBatch, lengths: int, data: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors in a batch: it, the rows, and their components."""
    d_of = batch.column(lengths).to_numpy(zero_copy_only=False)
    raw = batch.column(data).to_pylist()
    for d in np.unique(d_of).tolist():
        rows = np.flatnonzero(d_of == d)
        yield d, rows, np.frombuffer(b"".join([raw[k] for k in rows]), "<i4").reshape(len(rows), d).astype(np.int64)


def _stacked(column: pa.Array, rows: np.ndarray, kind, shape: tuple) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join([data[k] for k in rows]), kind).reshape(len(rows), *shape)


def _geometries(books: Books, before: Books | None) -> dict[int, list[Geometry]]:
    return {d: [Geometry(b, before[d][k] if before else None) for k, b in enumerate(parts)] for d, parts in books.items()}


def _assigned(batch: pa.RecordBatch, geometries: dict[int, list[Geometry]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[Bounds]]]:
    """For each length in a batch of the state, or of vectors that have none yet: it, the rows, their components, and the bounds of every part."""
    for d, rows, x in _by_length(batch, 2, 3):
        parts, out = geometries[d], []
        if batch.num_columns > 4:
            code = _stacked(batch.column(4), rows, np.uint8, (PARTS,))
            upper = _stacked(batch.column(5), rows, np.float64, (PARTS,))
            lower = _stacked(batch.column(6), rows, np.uint8, (PARTS, len(parts[0].book)))
            steps = _stacked(batch.column(7), rows, np.float64, (PARTS,))
        for k, (a, b) in enumerate(zip(_edges(d), _edges(d)[1:], strict=False)):
            if parts[k].moved is None:
                out.append(assign_all(x[:, a:b], parts[k]))
            else:
                out.append(assign_again(x[:, a:b], Bounds(code[:, k].astype(np.int64), upper[:, k], _unpacked(lower[:, k], steps[:, k])), parts[k])[0])
        yield d, rows, x, out


def _round(books: Books, before: Books | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        geometries = _geometries(books, before)
        for batch in batches:
            new = [[b""] * batch.num_rows for _ in range(4)]
            for _, rows, _, bounds in _assigned(batch, geometries):
                packed = [_packed(b.lower) for b in bounds]
                columns = (
                    np.stack([b.code for b in bounds], 1).astype(np.uint8), np.stack([b.upper for b in bounds], 1),
                    np.stack([p for p, _ in packed], 1), np.stack([s for _, s in packed], 1),
                )
                for out, data in zip(new, columns, strict=True):
                    for k, row in zip(rows.tolist(), data, strict=True):
                        out[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, pa.binary()) for c in new)], names=["vec_id", "label", "d", "x", "code", "upper", "lower", "steps"])

    return run


def _sums(books: Books):
    """Rows (d, x, code) to the sums of a task: d, part, entry, chunk (of WIDTH components), count, sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for d, rows, x in _by_length(batch, 0, 1):
                code = _stacked(batch.column(2), rows, np.uint8, (PARTS,))
                if d not in totals:
                    totals[d] = [(np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)) for b in books[d]]
                for k, (a, b) in enumerate(zip(_edges(d), _edges(d)[1:], strict=False)):
                    counts, sums = totals[d][k]
                    counts += np.bincount(code[:, k], minlength=len(counts))
                    np.add.at(sums, code[:, k], x[:, a:b])
        for d, parts in totals.items():
            found = [(d, k, j, at // WIDTH, int(n[j]), s[j, at : at + WIDTH].tolist()) for k, (n, s) in enumerate(parts) for j in np.flatnonzero(n).tolist() for at in range(0, s.shape[1], WIDTH)]
            if found:
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["d", "part", "entry", "chunk", "n", "s"])

    return run


def _means(state: DataFrame, books: Books) -> Books:
    """The entries moved to the floors of the means of their parts; unused ones stay. The driver gets one row an entry, for every WIDTH of its components."""
    width = min(WIDTH, max((b.shape[1] for parts in books.values() for b in parts), default=0))
    rows = state.select("d", "x", "code").mapInArrow(_sums(books), "d int, part int, entry int, chunk int, n long, s array<long>")
    rows = rows.groupBy("d", "part", "entry", "chunk").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)])
    moved = {d: [b.copy() for b in parts] for d, parts in books.items()}
    for r in rows.collect():
        book = moved[r.d][r.part]
        at = r.chunk * WIDTH
        book[r.entry, at : at + WIDTH] = [r[f"s{i}"] // r.n for i in range(min(WIDTH, book.shape[1] - at))]
    return moved


def _last(books: Books, before: Books | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        geometries = _geometries(books, before)
        for batch in batches:
            code, error = [b""] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for d, rows, x, bounds in _assigned(batch, geometries):
                for k, row in zip(rows.tolist(), np.stack([b.code for b in bounds], 1).astype(np.uint8), strict=True):
                    code[k] = row.tobytes()
                for k, (a, b) in enumerate(zip(_edges(d), _edges(d)[1:], strict=False)):
                    error[rows] += _to(x[:, a:b], books[d][k][bounds[k].code])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(code, pa.binary()), pa.array(error)], names=["vec_id", "label", "d", "code", "error"])

    return run


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, Books]:
    """Codes of vectors (vec_id, embedding, label), and the codebooks.

    Codes: vec_id, label (as text), d (the vector's length), code (the entry of each part, a byte each),
    error (squared distance to these entries). Components are the floors of 1,024 times the vectors'; such
    as are too large for sums of squares in 62 bits (beyond 131,072 in 64 components) count as the
    largest. Vectors that are null, or hold null or non-finite components, are left out. Each length of
    vectors has codebooks of its own; parts of a length that four does not divide differ by one component.
    With fewer vectors than entries there are as many entries. Rows that repeat are answered each; vec_id
    is carried along, null or not. An empty table gives no rows and no codebooks.
    """
    given = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"), vectors["label"].cast("string").alias("label"))
    state = materialize(given.mapInArrow(_integers, "vec_id long, label string, d int, x binary"), "codes", BATCH_ROWS)
    books, before = first_books(state, min(entries, ENTRIES)), None
    for _ in range(rounds):
        state, old = materialize(state.mapInArrow(_round(books, before), _STATE), "codes", BATCH_ROWS, "zstd"), state
        discard(old)
        books, before = _means(state, books), books
    codes = materialize(state.mapInArrow(_last(books, before), "vec_id long, label string, d int, code binary, error long"), "codes", BATCH_ROWS)
    discard(state)
    return codes, books


def decode(codes: DataFrame, books: Books) -> DataFrame:
    """vec_id and embedding: the entries that the code of each row names, as components of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            found = [np.concatenate([books[d][k][j] for k, j in enumerate(code)]) / SCALE for d, code in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return codes.select("vec_id", "d", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def books_digest(parts: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for part in parts for entry in part.tolist() for v in entry).encode()).hexdigest()


def code_digests(codes: DataFrame, books: Books) -> DataFrame:
    """vec_id, code (hexadecimal), error, label_error (null beyond 64 bits), codebooks_sha256 (of the vector's length)."""
    totals = materialize(codes.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    digest = F.lit(None).cast("string")
    for d, parts in books.items():
        digest = F.when(F.col("d") == d, books_digest(parts)).otherwise(digest)
    return codes.join(totals, codes["label"].eqNullSafe(totals["of"])).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return code_digests(*compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _sql() -> str:
    """The rounds written out, every distance taken."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} as materialized (select vec_id, part, min(e * 256 + entry) as k from (select q.vec_id, q.part, c.entry, sum((q.x - c.x) * (q.x - c.x))::bigint as e "
            f"from q join c{r} c on q.part = c.part and q.pos = c.pos group by all) group by all)"
        )
        if r < ROUNDS:
            steps.append(
                f"m{r} as (select q.part, q.pos, (a.k % 256)::bigint as entry, sum(q.x)::bigint as s, count(*) as n from q join a{r} a on q.vec_id = a.vec_id and q.part = a.part group by all), "
                f"c{r + 1} as materialized (select c.part, c.pos, c.entry, case when m.n is null then c.x else (m.s - ((m.s % m.n) + m.n) % m.n) // m.n end as x "
                f"from c{r} c left join m{r} m on c.part = m.part and c.pos = m.pos and c.entry = m.entry)"
            )
    return f"""
with v as (select vec_id, label, embedding, len(embedding) // 4 as w from embeddings where embedding is not null and len([y for y in embedding if y is null or not isfinite(y)]) = 0),
u as (select vec_id, label, w, unnest(embedding) as y, unnest(range(len(embedding))) as i from v),
q as materialized (select vec_id, label, i // w as part, i % w as pos, floor(1024 * y::double)::bigint as x from u),
c0 as materialized (select part, pos, rank - 1 as entry, x from (select *, dense_rank() over (order by vec_id) as rank from q) where rank <= 256),
{", ".join(steps)},
t as (select vec_id, string_agg(printf('%02x', (k % 256)::int), '' order by part) as code, sum(k // 256)::bigint as error from a{ROUNDS} group by vec_id),
b as (select sha256(string_agg(x, ',' order by part, entry, pos)) as codebooks_sha256 from c{ROUNDS})
select t.vec_id, t.code, t.error, sum(t.error) over (partition by v.label)::bigint as label_error, codebooks_sha256 from t join v on t.vec_id = v.vec_id, b"""


SQL = {"op12_vector_codes": _sql()}
