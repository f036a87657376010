"""N-gram Jaccard join by parity sketches.

A text is the set of its distinct five-word shingles. Every shingle flips one bit of a sketch, so two
sketches differ in at most as many places as the sets do; two sets of sizes a and b with similarity
0.75 or more differ in D = (a + b) / 7 shingles at most. The sketch is cut into more than D blocks
(their number belongs to a band of D), so at least one is equal, and the blocks that are not empty are
the keys of the join. A block is that wide that it is kept as the XOR of its shingles' hashes. If a set
fills no more than D blocks, the equal ones can all be empty; it is cut once more into twice as many,
and so is any partner that it has not been found with, for which the same holds. A
second sketch of 128 bits is compared whole and discards most pairs of unlike texts at once. Larger
sketches, with places in proportion to the set, screen what is left, which is verified on the sets.

Equal sets are one entry. Tasks deal the block keys out in packed arrays; a bucket of keys is sorted
and yields pairs and, for larger groups, sets of candidates, which are not
expanded into their pairs (see candidates).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import discard, keep_alone, materialize, shuffle_partitions
from .candidates import ROWS, linked

WORDS = 5
SMALL_SET = 6
FLUSH_KEYS = 1 << 21
MAX_CACHED = 1 << 18
NO_ID = (1 << 63) - 1
U64 = np.uint64
_C = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5), U64(0xD6E8FEB86659FD93)]


class _Words(dict):
    """Hashes of the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_CACHED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words without visible structure."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; below five words the whole sequence is one, without words there is none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U64)
    w = np.fromiter(map(_HASHES.__getitem__, words), U64, len(words))
    n = min(WORDS, len(w))
    with np.errstate(over="ignore"):
        total = np.full(len(w) - n + 1, U64(n), U64)
        for k in range(n):
            total += w[k : len(w) - n + 1 + k] * _C[k]
    return np.unique(mix(total))


@cache
def bands() -> tuple[list[int], list[int]]:
    """Of each band: blocks, and the largest D it serves."""
    blocks, most = [4], [1]
    while most[-1] < 1 << 40:
        blocks.append(max(blocks[-1] + 1, int(blocks[-1] * 2**0.5)))
        most.append(max(most[-1] + 1, int((blocks[-1] - 1) / (1.08 + 4 / blocks[-1]))))
    return blocks, most


def _keys(s: np.ndarray, first_cut: int = 0) -> np.ndarray:
    """Block keys of a set, for every band that a partner of any size can put a pair in. first_cut: cuts from another number on find the same pairs by other blocks."""
    n = len(s)
    low, high = max(1, (n + -(-3 * n // 4)) // 7), (n + 4 * n // 3) // 7
    if high < 1:
        return np.zeros(0, U64)  # only equal sets are near
    blocks, most = bands()
    first, last = int(np.searchsorted(most, low)), int(np.searchsorted(most, high))
    cuts, out = [], []
    with np.errstate(over="ignore"):
        for j in range(first, last + 1):
            for cut in count(first_cut):
                if cut - first_cut == len(cuts):
                    order = s if cut == 0 else np.sort(mix(s + U64(cut) * _C[3]))
                    cuts.append((order >> U64(32), mix(order ^ _C[0])))
                place, flips = cuts[cut - first_cut]
                at = (place * U64(blocks[j] << (cut - first_cut))) >> U64(32)
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                out.append(mix(np.bitwise_xor.reduceat(flips, starts) ^ mix(at[starts] * _C[1] + U64(j) * _C[2] + U64(cut) * _C[4])))
                if len(starts) > min(high, most[j]):
                    break  # else all blocks that it shares with a partner can be empty
    return np.concatenate(out)


def _sketch(s: np.ndarray, bits: int) -> bytes:
    """Parity of the shingles at each of so many places; the halves of a sketch make that of half the size by XOR."""
    odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _large(s: np.ndarray) -> bytes:
    """The sketch by which pairs are screened: at least two places for each shingle."""
    return _sketch(s, max(64, 1 << (2 * len(s) - 1).bit_length()))


def _differ(x: bytes, y: bytes) -> int:
    """Places in which two sketches differ, the larger one folded: never more than the sets differ."""
    a, b = (np.frombuffer(v, U64) for v in (x, y))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


_DOCS = (np.int64, np.int64, np.int64, np.int64)  # id, hash of the text, set, size
_KEYS = (np.int64, np.int32, U64, U64, np.int32, np.uint32, np.uint8)  # per set: set, size, sketch, keys; per key: 40 bits


def _name(items: bytes) -> int:
    """A set is known by this hash of its sorted shingles."""
    return int.from_bytes(xxhash.xxh64_digest(items), "big", signed=True)


def _deal(buckets: int):
    """Documents to packed rows: kind 0 with ids, kind 1 with the block keys of a bucket, kind 3 with a large sketch (data; bucket: size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_alone("ngram", _HASHES.clear)
        seen: set[int] = set()
        docs, sets, keys, held, large = [], [], [], 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(0, docs[0][2] % buckets, _pack(*(np.array(c, np.int64) for c in zip(*docs, strict=True))))] if docs else []
            if sets:
                key = np.concatenate(keys)
                owner = np.repeat(np.arange(len(keys), dtype=np.int64), [len(k) for k in keys])
                bucket = ((key >> U64(32)) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, owner, bucket = key[order], owner[order], bucket[order]
                ends = np.searchsorted(bucket, np.arange(buckets + 1))
                ref, n, s0, s1 = (np.array(c, k) for c, k in zip(zip(*sets, strict=True), _KEYS[:4], strict=True))
                for b in range(buckets):
                    part = slice(ends[b], ends[b + 1])
                    who, times = np.unique(owner[part], return_counts=True)
                    if len(who):
                        rows.append((1, b, _pack(ref[who], n[who], s0[who], s1[who], times.astype(np.int32), (key[part] & U64(0xFFFFFFFF)).astype(np.uint32), (key[part] >> U64(56)).astype(np.uint8))))
            rows = [(k, b, 0, 0, data) for k, b, data in rows] + [(3, r % buckets, r, n, data) for r, n, data in large]
            columns = zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["kind", "bucket", "ref", "n", "data"])

        for batch in batches:
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingles(text)
                ref = _name(s.tobytes())
                docs.append((i, h, ref, len(s)))
                if len(s) and ref not in seen:
                    if len(seen) > MAX_CACHED:
                        seen.clear()
                    seen.add(ref)
                    k = _keys(s)
                    if len(k):
                        sets.append((ref, len(s), *np.frombuffer(_sketch(s, 128), U64)))
                        large.append((ref, len(s), _large(s)))
                        keys.append(k)
                        held += len(k)
                if held > FLUSH_KEYS or len(docs) > FLUSH_KEYS >> 3:
                    yield from flush()
                    docs, sets, keys, held, large = [], [], [], 0, []
        if docs:
            yield from flush()

    return run


def _possible(n: np.ndarray, s0: np.ndarray, s1: np.ndarray, a, b) -> np.ndarray:
    """Whether sizes and 128-bit sketches allow a similarity of 0.75."""
    na, nb = n[a].astype(np.int64), n[b].astype(np.int64)
    differ = np.bitwise_count(s0[a] ^ s0[b]).astype(np.int64) + np.bitwise_count(s1[a] ^ s1[b])
    return (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (7 * differ <= na + nb)


def _match(parts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], tuple]:
    """Candidates of one bucket: pairs (2, m), sets of more members; both index the tables of sets (set, size, sketch)."""
    columns = list(zip(*(_unpack(p, _KEYS) for p in parts), strict=True))
    ref, n, s0, s1, times, low, high = (np.concatenate(c) for c in columns)
    ref, first, dense = np.unique(ref, return_index=True, return_inverse=True)
    n, s0, s1 = n[first], s0[first], s1[first]
    key, who = (high.astype(U64) << U64(32)) | low, np.repeat(dense, times)
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])]
    key, who = key[fresh], who[fresh]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    two = starts[sizes == 2]
    pairs = [np.stack([who[two], who[two + 1]])]
    groups: dict[int, np.ndarray] = {}
    for at, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        members = who[at : at + size]
        groups.setdefault(xxhash.xxh64_intdigest(members.tobytes()), members)
    large = []
    for members in sorted(groups.values(), key=len, reverse=True):
        if len(members) <= SMALL_SET:
            i, j = np.triu_indices(len(members), 1)
            pairs.append(np.stack([members[i], members[j]]))
        else:
            large.append(members)
    pair = np.unique(np.concatenate(pairs, axis=1), axis=1)
    pair = pair[:, _possible(n, s0, s1, pair[0], pair[1])]
    return pair, _merged(large, n, s0, s1), (ref, n, s0, s1)


def _merged(large: list[np.ndarray], n: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> list[np.ndarray]:
    """Sets without members that no other member can be near to; sets that overlap by half or more are one."""
    out: list[set[int]] = []
    home: dict[int, int] = {}
    for members in large:
        if len(members) <= 4096:
            near = np.zeros(len(members), bool)
            for k in range(len(members)):
                ok = _possible(n, s0, s1, members[k], members)
                near[k] = ok.sum() > 1
            members = members[near]
        if len(members) < 2:
            continue
        m = members.tolist()
        votes: dict[int, int] = {}
        for x in m:
            if x in home:
                votes[home[x]] = votes.get(home[x], 0) + 1
        best = max(votes, key=votes.__getitem__, default=-1)
        if best >= 0 and 2 * votes[best] >= len(out[best]) + len(m) - votes[best]:
            out[best].update(m)
        else:
            best = len(out)
            out.append(set(m))
        for x in m:
            home.setdefault(x, best)
    return [np.array(sorted(x)) for x in out]


_OUT = ["kind", "a", "b", "n", "h", "sketch"]


def _rows(kind: int, a, b, n=None, h=None, sketch=None) -> pa.RecordBatch:
    zero = np.zeros(len(a), np.int64)
    columns = [np.full(len(a), kind, np.int32), *(zero if c is None else c.astype(np.int64) for c in (a, b, n, h))]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(sketch or [None] * len(a), pa.binary())], names=_OUT)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows, sorted by bucket, to rows of documents (0), pairs (1), members of sets (2) and sketches (3). A set is named by its smallest member, so sets that share it become one."""

    def found(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        pair, sets, (ref, n, s0, s1) = _match(parts)
        if pair.shape[1]:
            yield _rows(1, ref[pair[0]], ref[pair[1]])
        for m in sets:
            yield _rows(2, np.full(len(m), ref[m].min()), ref[m], n[m])

    at, parts = -1, []
    for batch in batches:
        sketches = []
        for kind, bucket, name, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                i, h, ref, n = _unpack(data, _DOCS)
                yield _rows(0, i, ref, n, h)
                continue
            if kind == 3:
                sketches.append((name, size, data))
                continue
            if bucket != at and parts:
                yield from found(parts)
                parts = []
            at = bucket
            parts.append(data)
        if sketches:
            a, size, data = zip(*sketches, strict=True)
            yield _rows(3, np.array(a), np.zeros(len(a), np.int64), np.array(size), sketch=list(data))
    if parts:
        yield from found(parts)


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, their sizes and large sketches) whose sketches allow a similarity of 0.75."""
    for batch in batches:
        keep = [7 * _differ(x, y) <= n + m for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _partners(features: list[tuple]):
    """From (size, large sketch) of the members of a set to a function from those of any member to the numbers of the members that can be near to it, the most alike first."""
    n = np.array([f[0] for f in features])
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    words = np.array([len(f[1]) // 8 for f in features])
    for w in np.unique(words):
        who = np.flatnonzero(words == w)
        by_size[int(w)] = who, np.stack([np.frombuffer(features[i][1], U64) for i in who])
    halves = {w: bits[:, : w // 2] ^ bits[:, w // 2 :] for w, (_, bits) in by_size.items() if w > 1}

    def partners(size: int, sketch: bytes) -> np.ndarray:
        own = np.frombuffer(sketch, U64)
        found, apart = [np.zeros(0, np.int64)], [np.zeros(0)]
        for w, (who, bits) in by_size.items():  # partners have sketches of the same size, or of the next
            if w == len(own):
                differ = bits ^ own
            elif w == 2 * len(own):
                differ = halves[w] ^ own
            elif 2 * w == len(own):
                differ = bits ^ (own[:w] ^ own[w:])
            else:
                continue
            differ = np.bitwise_count(differ).sum(1, dtype=np.int64)
            near = (7 * differ <= n[who] + size) & (4 * np.minimum(n[who], size) >= 3 * np.maximum(n[who], size))
            found.append(who[near])
            apart.append((differ / (n[who] + size))[near])
        return np.concatenate(found)[np.argsort(np.concatenate(apart), kind="stable")]

    return partners


def _near_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (name, ref, n, large sketch; sorted by name) that can be near to another of their set. Sets too large to try all pairs stay whole."""

    def done(rows: list[tuple]) -> list[tuple]:
        if not 1 < len(rows) <= 1024:
            return rows if len(rows) > 1 else []
        partners = _partners([r[2:] for r in rows])
        return [r for r in rows if len(partners(*r[2:])) > 1]  # itself is one

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["name", "ref", "n", "sketch"])

    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != at:
                if kept := done(rows):
                    yield out(kept)
                at, rows = row[0], []
            rows.append(row)
    if kept := done(rows):
        yield out(kept)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        right = pa.array([_name(x) == r for x, r in zip(packed, batch.column(0).to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["ref", "items"]).filter(right)


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (ref, items) to the keys (ref, key) of other cuts, of which near sets share one as well."""
    for batch in batches:
        keys = [_keys(np.frombuffer(x, U64), 16) for x in batch.column(1).to_pylist()]
        ref = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(ref), pa.array(np.concatenate([np.zeros(0, U64), *keys]).view(np.int64))], names=["ref", "key"])


def _verified(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= threshold * (len(p) + len(q) - common))
            keep = [i for i, k in enumerate(ok) if k]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells rows apart: the id, and a hash of the text, as ids can be null or repeat."""
    return F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(docs[text_col], F.lit("")))


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each row of docs its key (id, h), n (shingles) and first: the smallest key of its component. Rows without shingles are their own."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    i, h = _row_key(docs, id_col, text_col)
    rows = docs.select(i.alias("id"), h.alias("h"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    dealt = rows.mapInArrow(_deal(parts), "kind int, bucket int, ref long, n long, data binary")
    found = materialize(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_candidates, "kind int, a long, b long, n long, h long, sketch binary"), "ngram")
    members = found.where("kind = 0").select(F.col("a").alias("id"), "h", F.col("b").alias("ref"), "n")
    large = found.where("kind = 3").groupBy(F.col("a").alias("ref")).agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    pairs = found.where("kind = 1").select("a", "b").distinct()
    sketch = lambda k: large.select(F.col("ref").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))

    def screen(edges: DataFrame) -> DataFrame:
        return edges.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_screened, "a long, b long")

    pairs = materialize(screen(pairs.join(sketch("b"), "b").join(sketch("a"), "a")), "pairs", ROWS)
    sets = found.where("kind = 2").select(F.col("a").alias("name"), F.col("b").alias("ref")).distinct().join(large, "ref").select("name", "ref", "n", "sketch")
    sets = materialize(sets.repartition("name").sortWithinPartitions("name").mapInArrow(_near_members, "name long, ref long, n long, sketch binary"), "sets", ROWS)

    wanted = pairs.select(F.col("a").alias("ref")).union(pairs.select("b")).union(sets.select("ref")).distinct()
    first = members.join(wanted, "ref", "left_semi").groupBy("ref").agg(F.min(F.struct("id", "h")).alias("key")).select("ref", "key.id", "key.h")
    items = materialize(rows.dropDuplicates(["id", "h"]).join(first, ["id", "h"]).select("ref", "text").mapInArrow(_sets, "ref long, items binary"), "items", ROWS)

    def verify(edges: DataFrame) -> DataFrame:
        left, right = items.select(F.col("ref").alias("a"), F.col("items").alias("x")), items.select(F.col("ref").alias("b"), F.col("items").alias("y"))
        return edges.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_verified(75), "a long, b long")

    def finer(members: DataFrame) -> DataFrame:
        return members.select("ref").distinct().join(items, "ref").select("ref", "items").mapInArrow(_finer, "ref long, key long")

    labels = linked(pairs, sets, screen, verify, _partners, finer)
    placed = members.join(labels.select(F.col("node").alias("ref"), "comp"), "ref", "left").select("id", "h", "n", F.coalesce("comp", "ref").alias("comp"))
    key = F.struct("id", "h")
    firsts = placed.where("n > 0").groupBy("comp").agg(F.min(key).alias("first"))
    discard(pairs, sets, items)
    return placed.where("n > 0").join(firsts, "comp").select("id", "h", "n", "first").union(placed.where("n = 0").select("id", "h", "n", key.alias("first")))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable by links).

    Two documents link if their shingle sets have 100 * intersection >= 75 * union. Null, empty and
    blank texts have no shingles and link with nothing. A row with a null id takes part in links, but
    never names a component that has another id. Rows that share an id, or repeat, are documents of their
    own. An empty table gives no rows.
    """
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return _placed(docs, id_col, text_col).select(real("id").alias(id_col), F.col("n").alias("n_shingles"), real("first.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, null ids last; of equal ids, that of the smallest hash of the text, and of equal rows any. Rows without shingles all stay."""
    keys = ["_mr_id", "_mr_h"]
    placed = _placed(docs, id_col, text_col).where((F.col("first.id") == F.col("id")) & (F.col("first.h") == F.col("h")))
    kept = placed.groupBy(F.col("id").alias(keys[0]), F.col("h").alias(keys[1])).agg(F.max("n").alias("_mr_n"))
    i, h = _row_key(docs, id_col, text_col)
    own = F.when(F.col("_mr_n") == 0, F.monotonically_increasing_id())
    return docs.withColumn(keys[0], i).withColumn(keys[1], h).join(kept, keys).withColumn("_mr_own", own).dropDuplicates([*keys, "_mr_own"]).drop(*keys, "_mr_n", "_mr_own")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op1_ngram_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [hash(array_to_string(words, ' '))] else [hash(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) for i in range(1, len(words) - 3)] end) as g from w),
n as (select doc_id, count(*) as n, min(hash(g)) as lo, sum(g) as total from s group by doc_id),
c as (select *, min(doc_id) over (partition by n, lo, total) as first from n),
f as (select s.* from s join c on c.doc_id = s.doc_id and c.first = c.doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from f a join f b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join c x on x.doc_id = a join c y on y.doc_id = b where 100 * both_ >= 75 * (x.n + y.n - both_)),
e as (select a, b from l union all select b, a from l),
r(node, comp) as (select first, first from c where first = doc_id union select e.b, r.comp from r join e on e.a = r.node where e.b <> r.comp),
m as (select node, min(comp) as comp from r group by node)
select d.doc_id, coalesce(c.n, 0) as n_shingles, coalesce(m.comp, d.doc_id) as component_id from documents d left join c on c.doc_id = d.doc_id left join m on m.node = c.first"""
}
