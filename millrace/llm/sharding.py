"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and ordered by a digest of the text. The smallest shard capacity
for which a greedy walk over the ordered group sizes needs no more than the given shards is found by
binary search; the cuts are made there. The walk runs on the driver over segments of the digest
space, at most a few thousand at a time: a segment in which a cut can fall is split into 256 by the
next two digits, until the bounds on the capacity meet.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._work import discard, materialize

DIGITS, FIRST, STEP = 32, 3, 2
CELL_ROWS = 100_000


class Segment(NamedTuple):
    prefix: str  # of the digests in it
    size: int  # bytes
    groups: int

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or len(self.prefix) >= DIGITS


def _ends(capacity: int, segments: list[Segment], sums: list[int], shards: int, optimistic: bool) -> list[int]:
    """Bytes before the end of each shard, greedily filled; optimistic: unresolved segments can be cut anywhere."""
    ends, at = [], 0
    for _ in range(shards):
        i = bisect_right(sums, at + capacity) - 1
        end = sums[i]
        if optimistic and i < len(segments) and not segments[i].atomic:
            end = at + capacity
        at = max(at, end)
        ends.append(at)
    return ends


def _smallest(segments: list[Segment], sums: list[int], shards: int, low: int, optimistic: bool) -> int:
    """Binary search of the smallest feasible capacity."""
    high = max(low, sums[-1])
    while low < high:
        mid = (low + high) // 2
        if _ends(mid, segments, sums, shards, optimistic)[-1] >= sums[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def _even_cuts(capacity: int, segments: list[Segment], sums: list[int], shards: int) -> list[int]:
    """Indexes of the segments that begin shards 1 and on: within the capacity, each as near as can be to an even share of what is left."""
    latest = [len(segments)]  # latest[r]: the first segment from which r shards hold the rest
    for _ in range(shards):
        latest.append(bisect_left(sums, sums[latest[-1]] - capacity))
    cuts, at = [], 0
    for k in range(1, shards):
        low, high = max(at, latest[shards - k]), max(at, bisect_right(sums, sums[at] + capacity) - 1)
        want = sums[at] + (sums[-1] - sums[at]) / (shards - k + 1)
        i = min(max(bisect_left(sums, want), low), max(low, high))
        if i > low and want - sums[i - 1] <= sums[min(i, len(segments))] - want:
            i -= 1
        cuts.append(i)
        at = i
    return cuts


def minimax_cuts(groups: DataFrame, shards: int) -> list[str]:
    """Digest prefixes at which shards 1 to shards - 1 begin. groups: g (digest), bytes."""

    def split(prefixes: list[str] | None, digits: int) -> list[Segment]:
        part = groups if prefixes is None else groups.where(F.substring("g", 1, len(prefixes[0])).isin(prefixes))
        rows = part.groupBy(F.substring("g", 1, digits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
        return [Segment(r.p, int(r.b), int(r.n)) for r in rows]

    segments, largest = sorted(split(None, FIRST)), groups.agg(F.max("bytes")).first()[0] or 0
    if not segments:
        return []
    while True:
        sums = list(accumulate((s.size for s in segments), initial=0))
        low = _smallest(segments, sums, shards, max(largest, -(-sums[-1] // shards)), True)
        high = _smallest(segments, sums, shards, low, False)
        open_ = set()
        if low < high:
            early, late = _ends(low, segments, sums, shards, False), _ends(high, segments, sums, shards, True)
            for a, b in zip(early, late, strict=True):
                first, last = max(0, bisect_right(sums, a) - 2), bisect_left(sums, b) + 1
                open_ |= {s.prefix for s in segments[first:last] if not s.atomic}
        if not open_:
            return [segments[i].prefix if i < len(segments) else "~" for i in _even_cuts(high, segments, sums, shards)]
        length = min(map(len, open_))
        now = sorted(p for p in open_ if len(p) == length)
        finer = split(now, min(DIGITS, length + STEP))
        segments = sorted([s for s in segments if s.prefix not in set(now)] + finer)


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: the largest shard is as small as the order of the groups allows, the others near
    equal. size: UTF-8 bytes of the text plus 1; a null text has none, is a group of its own, apart
    from empty texts, and its text_crc32 is that of no bytes. Equal texts share a shard, so one
    group larger than an even share makes a shard that large. Slots run from 0 without gaps; which
    of several equal rows has which slot is not defined. An empty table gives no rows.
    """
    text = docs["text"]
    slim = materialize(
        docs.select(
            docs["doc_id"], (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(text.isNull(), F.rpad(F.lit(""), DIGITS, "0")).otherwise(F.substring(F.sha2(text, 256), 1, DIGITS)).alias("g"),
        ),
        "shard",
    )
    groups = materialize(slim.groupBy("g").agg(F.sum("size").alias("bytes")), "groups")
    cuts = minimax_cuts(groups, shards)
    rows = slim.count()
    discard(groups)
    begins = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<string>")
    placed = slim.withColumn("shard", F.size(F.filter(begins, lambda c: c <= F.col("g"))))
    # Slots: rows are dealt into cells of bounded size, counted, and numbered cell by cell.
    salts = max(1, -(-rows // (shards * CELL_ROWS)) * 8)
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    cells = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "g")))
    return numbered.join(cells, ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
