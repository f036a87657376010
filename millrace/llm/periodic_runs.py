"""Periodic runs of words by a harmonic grid of common-extension queries.

A run of period p that is four periods long holds four neighbouring multiples of p. So for each p the
multiples jp are looked at: where the words at four neighbours agree, the longest common extensions of
jp and (j + 1)p, forward and backward, give the run. An extension is a range minimum over the common
prefixes of neighbours in the suffix array, of the words or of the reversed words. The grid of all
periods has n log n points; suffix arrays are built only over the documents in which some four agree.
A block of documents stands end to end, with a word of its own after each, that nothing extends over.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPIES, SHORTEST = 4, 6
BLOCK_BYTES = 1 << 20
QUERIES = 1 << 18
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Extensions:
    """Longest common extensions to the right, in an array of words whose last one occurs once."""

    def __init__(self, words: np.ndarray) -> None:
        self._rank, levels = self._ranks(words)
        n = len(words)
        order = np.empty(n, np.int64)
        order[self._rank] = np.arange(n)
        # Neighbours agree in 2^k words where their ranks by 2^k words do.
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(n - 1, np.int32)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
            same &= (a < n) & (b < n)
            step = same.astype(np.int64) << k
            a += step
            b += step
            shared += step.astype(np.int32)
        self._least = [shared]
        while 2 << (len(self._least) - 1) <= len(shared):
            half, last = 1 << (len(self._least) - 1), self._least[-1]
            self._least.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _ranks(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The place of each suffix among all, and its rank by the first 1, 2, 4 ... words; only suffixes that still share a rank are sorted again."""
        n = len(words)
        order = np.argsort(words, kind="stable")
        found = words[order]
        heads = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        sizes = np.diff(np.r_[heads, n])
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(heads, sizes)
        levels, open_, k = [rank.astype(np.int32)], order[np.repeat(sizes, sizes) > 1], 1
        while len(open_):
            after = open_ + k
            key = rank[open_] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            at = np.argsort(key)
            open_, key = open_[at], key[at]
            first, places = rank[open_], np.arange(len(open_))
            fresh = np.r_[True, key[1:] != key[:-1]]
            group = np.maximum.accumulate(np.where(np.r_[True, first[1:] != first[:-1]], places, 0))
            rank[open_] = first + np.maximum.accumulate(np.where(fresh, places, 0)) - group
            levels.append(rank.astype(np.int32))
            sizes = np.diff(np.r_[np.flatnonzero(fresh), len(open_)])
            open_, k = open_[np.repeat(sizes, sizes) > 1], 2 * k
        return rank, levels

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i and j differ everywhere."""
        a, b = self._rank[i], self._rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self._least[k][low[own]], self._least[k][high[own] - (1 << k)])
        return out


def _grid(words: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i and periods p where i is a multiple of p and the words at i, i + p, i + 2p and i + 3p agree. The documents come by falling size: a period goes over those that can hold a run of it."""
    periods = np.arange(1, int(sizes[0]) // COPIES + 1)
    long_enough = np.searchsorted(-sizes, -np.maximum(COPIES * periods, SHORTEST), side="right")
    places, found = [], []
    for p, m in zip(periods.tolist(), np.r_[0, ends][long_enough].tolist(), strict=True):
        stride = words[:m:p]
        same = stride[1:] == stride[:-1]
        hits = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if len(hits):
            places.append(hits * p)
            found.append(np.full(len(hits), p))
    return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents end to end, each followed by a negative number of its own; where each starts and ends."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    words = np.empty(int(ends[-1]) + 1, np.int64)
    words[ends] = -1 - np.arange(len(docs))
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = np.concatenate(docs)
    return words, ends - sizes, ends


def block_runs(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document of word numbers, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    by_size = sorted((k for k, d in enumerate(docs) if len(d) >= SHORTEST), key=lambda k: -len(docs[k]))
    if not by_size:
        return out
    words, starts, ends = _joined([docs[k] for k in by_size])
    i, p = _grid(words, ends, ends - starts)
    home = np.searchsorted(ends, i)
    inside = i + 3 * p < ends[home]
    i, p, home = i[inside], p[inside], home[inside]
    if not len(i):
        return out
    own = np.unique(home)
    words, at, ends = _joined([docs[by_size[k]] for k in own.tolist()])
    place = np.searchsorted(own, home)
    i = i - starts[home] + at[place]
    forward = _extended(words, i, i + p)
    backward = _extended(words[::-1], len(words) - i, len(words) - i - p)
    start, end = i - backward, i + p + forward
    keep = end - start >= np.maximum(COPIES * p, SHORTEST)
    start, end, p, place = start[keep], end[keep], p[keep], place[keep]
    order = np.lexsort((p, end, start))  # of equal stretches the smallest period comes first
    start, end, p, place = start[order], end[order], p[order], place[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    for s, e, q, k in zip(start[new].tolist(), end[new].tolist(), p[new].tolist(), place[new].tolist(), strict=True):
        out[by_size[own[k]]].append((s - int(at[k]), e - s, q))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def _extended(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common extensions of i and j, which can point at the end of words; nothing extends from there."""
    lce = Extensions(np.r_[words, np.int64(np.iinfo(np.int64).min)])
    return np.concatenate([lce(i[at : at + QUERIES], j[at : at + QUERIES]) for at in range(0, len(i), QUERIES)])


def _kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    starts, lengths, periods = np.array(found, np.int64).T
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    return list(compress(words, (np.cumsum(change)[:-1] == 0).tolist()))


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(rows: list[int]) -> pa.RecordBatch:
        number = defaultdict(count().__next__)
        split = [texts[k].as_py().split() for k in rows]
        found = block_runs([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in split])
        flat = [dict(zip(("start", "length", "period"), r, strict=True)) for f in found for r in f]
        runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat, _RUN))
        left = pa.array([b" ".join(_kept(w, f)) for w, f in zip(split, found, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(list(map(len, split)), pa.int64()), runs, left], names=["doc_id", "n_words", "runs", "collapsed"])

    for batch in batches:
        texts = batch.column(1).cast(pa.binary())  # bytes are split at ASCII white space alone
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        rows, n = [], 0
        for k in np.argsort(-sizes, kind="stable").tolist():
            rows.append(k)
            n += int(sizes[k])
            if n >= BLOCK_BYTES:
                yield done(rows)
                rows, n = [], 0
        if rows:
            yield done(rows)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, runs (array of start, length, period), collapsed.

    Words are stretches of anything but ASCII white space, numbered from 0. A run is a stretch with
    smallest period q, of four periods and six words at least, that keeps its period no further to
    either side; runs can overlap. collapsed: the text, by single spaces, without the words that some
    run contains after its first period. A null or empty text has no words, no runs and an empty
    collapsed text. Rows that repeat are each answered; doc_id is carried along, null or not. An empty
    table gives no rows. A text is taken up by one task, at about 200 bytes a word where it may hold runs.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_detect, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the tail of every tenth document, by the CRC-32 of its id, repeats with a period between a tenth and a third of the tail."""
    doc_id = docs["doc_id"].cast("long")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(docs["text"], r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    a = g % F.nullif(n, F.lit(0))
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    first = F.slice(words, F.lit(1), a.cast("int"))
    unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    changed = F.array_join(F.concat(first, tail), " ")
    return docs.select(doc_id.alias("doc_id"), F.when((h % 10 == 0) & (n > 0), changed).otherwise(docs["text"]).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of the rows of periodic_runs: the number of runs, the longest one, digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))

    def sha(text: Column) -> Column:
        return F.sha2(text, 256)

    return found.withColumn("m", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.period")).alias("period"),
        F.floor(1000 * F.col("m.length") / -F.col("m.period")).cast("long").alias("exponent_milli"),
        sha(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


SQL = {
    "op11_periodic_runs": r"""
with bytes as (select doc_id, text, [case when k % 8 = 0 then ord(cast(doc_id as varchar)[k // 8 + 1]) else 0 end for k in range(8 * length(cast(doc_id as varchar)))] as b from documents),
hashed as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(xor(c, x) >> 1, case when xor(c, x) & 1 = 1 then 3988292384 else 0 end)), 4294967295) as h,
  [w for w in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] as original from bytes),
cut as (select doc_id, h, original, len(original) as n, case when h % 10 = 0 and len(original) > 0 then (h // 10) % len(original) end as a, h // 10 as g from hashed),
texts as (select doc_id, n, case when a is null then original else [case when i < a then original[i + 1] else original[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] end for i in range(n)] end as words from cut),
places as (select doc_id, n, unnest(words) as word, unnest(range(n)) as i from texts),
equal_ as (select x.doc_id, x.i, y.i - x.i as p from places x join places y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
grouped as (select doc_id, p, i, i - row_number() over (partition by doc_id, p order by i) as island from equal_),
stretches as (select doc_id, p, min(i) as start, count(*) + p as length from grouped group by doc_id, p, island having count(*) + p >= greatest(6, 4 * p)),
runs as (select doc_id, start, length, min(p) as period from stretches group by doc_id, start, length),
lost as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
collapsed as (select p.doc_id, string_agg(p.word, ' ' order by p.i) as left_ from places p left join lost l on p.doc_id = l.doc_id and p.i = l.i where l.i is null group by p.doc_id),
summed as (select doc_id, count(*) as n_runs, max({'length': length, 'start': -start, 'period': -period}) as m, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as lines from runs group by doc_id)
select t.doc_id, coalesce(n_runs, 0) as n_runs, -m.start as start, m.length as length, -m.period as period, 1000 * m.length // -m.period as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(left_, '')) as collapsed_sha256
from texts t left join summed s on t.doc_id = s.doc_id left join collapsed c on t.doc_id = c.doc_id"""
}
