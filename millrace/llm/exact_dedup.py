"""Exact deduplication by Grace hashing.

Records are dealt by the hash of their content. A task streams its share into an open-addressing
table that compares complete contents; when the distinct contents outgrow the table's bytes, the
table and the rest of the stream go to spill files by further hash bits, and each file is treated
the same way until it fits. Copies are merged before the shuffle, so a content that a third of all
rows repeat is dealt once per map task.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RECORD = struct.Struct("<qqqi")
_SPACE = r"[\x20\x09-\x0D]+"

Record = tuple[int, int, int, bytes]  # hash, smallest id, rows, content


class ContentTable:
    """Open addressing with linear probing; two records are one only if their bytes are equal."""

    def __init__(self, slots: int = 1024) -> None:
        self._slots = [-1] * slots
        self._mask = slots - 1
        self.records: list[list] = []
        self.bytes = 0

    def add(self, h: int, first: int, rows: int, content: bytes) -> None:
        i = h & self._mask
        while (at := self._slots[i]) >= 0:
            r = self.records[at]
            if r[0] == h and r[3] == content:
                r[1] = min(r[1], first)
                r[2] += rows
                return
            i = (i + 1) & self._mask
        self._slots[i] = len(self.records)
        self.records.append([h, first, rows, content])
        self.bytes += len(content) + 64
        if 2 * len(self.records) > len(self._slots):
            self._grow()

    def _grow(self) -> None:
        self._mask = 2 * len(self._slots) - 1
        self._slots = [-1] * (self._mask + 1)
        for at, r in enumerate(self.records):
            i = r[0] & self._mask
            while self._slots[i] >= 0:
                i = (i + 1) & self._mask
            self._slots[i] = at


def grace(records: Iterable[Record], max_bytes: int, fanout_bits: int = 4, level: int = 0) -> Iterator[list]:
    """One record per distinct content. At most max_bytes of contents are held, besides one record."""
    table, records = ContentTable(), iter(records)
    for r in records:
        table.add(*r)
        if table.bytes > max_bytes and (level + 1) * fanout_bits <= 64:
            break
    else:
        yield from table.records
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [open(os.path.join(folder, str(k)), "w+b") for k in range(1 << fanout_bits)]
        try:

            def spill(h: int, first: int, rows: int, content: bytes) -> None:
                f = files[(h >> (64 - (level + 1) * fanout_bits)) & ((1 << fanout_bits) - 1)]
                f.write(_RECORD.pack(h, first, rows, len(content)))
                f.write(content)

            for r in table.records:
                spill(*r)
            del table
            for r in records:
                spill(*r)
            for f in files:
                f.seek(0)
                yield from grace(_read(f), max_bytes, fanout_bits, level + 1)
                f.truncate(0)
        finally:
            for f in files:
                f.close()


def _read(f) -> Iterator[Record]:
    while head := f.read(_RECORD.size):
        h, first, rows, n = _RECORD.unpack(head)
        yield h, first, rows, f.read(n)


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")


def _pre_aggregate(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            ids, hashes, contents = (batch.column(k).to_pylist() for k in range(3))
            for i, h, c in zip(ids, hashes, contents, strict=True):
                table.add(h, i, 1, c)
            if table.bytes > max_bytes:
                yield _batch(table.records)
                table = ContentTable()
        if table.records:
            yield _batch(table.records)

    return run


def _batch(records: list) -> pa.RecordBatch:
    columns = list(zip(*records, strict=True))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "first", "rows", "content"])


def _groups(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)

        out: list[tuple] = []
        for _, first, rows, content in grace(records(), max_bytes):
            out.append((hashlib.sha256(content).hexdigest(), first, rows))
            if len(out) == 10_000:
                yield _out(out)
                out = []
        if out:
            yield _out(out)

    return run


def _out(rows: list[tuple]) -> pa.RecordBatch:
    sha, first, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(sha, pa.string()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["text_sha256", "keep_id", "group_size"])


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 48 << 20) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (smallest id), group_size.

    Null and empty texts are one group, repeated rows count as often as they occur, and a row with a
    null id never becomes keep_id unless the group has no other. An empty table gives no rows.
    """
    text = normalised(docs[text_col])
    records = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1)).alias("first"), F.xxhash64(text).alias("h"), text.cast("binary").alias("content"))
    merged = records.mapInArrow(_pre_aggregate(table_bytes // 2), "h long, first long, rows long, content binary")
    return merged.repartition("h").mapInArrow(_groups(table_bytes), "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 48 << 20) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256. See content_groups for nulls.

    Of several rows that share the smallest id within a group, all are marked kept.
    """
    groups = content_groups(docs, id_col, text_col, table_bytes)
    members = docs.select(docs[id_col].cast("long").alias(id_col), F.sha2(normalised(docs[text_col]), 256).alias("text_sha256"))
    joined = members.join(groups, "text_sha256")
    keep = F.when(F.col("keep_id") < (1 << 63) - 1, F.col("keep_id"))
    return joined.select(id_col, keep.alias("keep_id"), "group_size", F.col(id_col).eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of which an equal text with a smaller id exists; repeated rows leave one."""
    keys = ["_mr_sha", "_mr_key"]
    keep = content_groups(docs, id_col, text_col).select(F.col("text_sha256").alias(keys[0]), F.col("keep_id").alias(keys[1]))
    marked = docs.withColumn(keys[0], F.sha2(normalised(docs[text_col]), 256)).withColumn(keys[1], F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1)))
    return marked.join(keep, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op6_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from n"""
}
