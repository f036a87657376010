"""Removal of repeated and nearly repeated lines.

A line is lower-cased, cut into words at Unicode white space, and its words are reduced to letters and
digits. For hashing, words of more than twelve bytes are cut into pieces, and letters of scripts without
spaces are words of their own. The keys of the join are words that stand together, so many and so few
at a time that some edits leave one key whole: every two words in lines of up to five, every three in
lines of five to seven, every three within five in lines of eight and nine, every three neighbours up to
18, and from 15 on blocks, counted from the beginning and from the end, whose SimHashes are the keys;
their size is rounded down, and that of a line a tenth shorter serves as well. Candidates are screened:
short lines by the counts of their letters, of which an edit changes two at most, so that no
similar pair is lost; long ones by SimHashes of 64 bits over their words. The others are verified by edit
similarity on the reduced lines; of a connected group the first occurrence stays, by doc_id and line
number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import discard, materialize, shuffle_partitions
from .candidates import ROWS, linked
from .ngram_join import mix

U64 = np.uint64
COUNTED = 160  # characters, below which letters are counted
LENGTHS, APART = (0, 300, 600), (20, 17, 14)  # from so many characters on, SimHashes of similar lines are so many bits apart at most, nearly always
BLOCKS = 15  # words of a line from which on it has keys by blocks
#: Keys by words: the words of a line that has them, and at which places from each word on they stand.
WINDOWS = (
    *(((2, 5), (0, k)) for k in range(1, 5)), *(((5, 7), (0, j, k)) for k in range(2, 7) for j in range(1, k)), *(((8, 9), (0, j, k)) for k in range(2, 5) for j in range(1, k)),
    ((10, 18), (0, 1, 2)),
)
SHORTEST = 10  # below, similar lines are equal
LONG_WORD, PIECE = 12, 6  # bytes
MAX_CACHED = 1 << 18
NO_ID = (1 << 63) - 1
HEAD = 2048  # characters of a line that are looked at before it is compared as a whole
WHOLE = 1 << 13  # characters of a line that is compared where the members of its set lie
STRETCH = 64  # of them, one number
AT_ONCE = 1 << 12  # pairs
NARROW, BAND = 319, 1279  # characters of a line that is compared in a band: a tenth are edits at most, so 63 diagonals hold them, and 255
FEW = 16  # pairs that are compared one by one
TOGETHER = 1 << 15  # pairs of sketches
SMALL_SET = 8
ONE_TASK = 1 << 14
FLUSH_KEYS = 1 << 19
BUCKETS = 4  # of keys, for each partition of a shuffle
_BLANK = re.compile(r"[\t\v\f\r\x1C-\x1F ]+")
_DROPPED = re.compile(r"[\x00-\x08\x0E-\x1B!-/:-@\[-`{-\x7F]+")
_WIDE = re.compile(r"[^\w\x00-\x7F]")
_COMMON = bytes([*range(0xC0), 0xC3])  # in UTF-8: ASCII, later bytes, and the first byte of the letters of Latin 1
_GROUPS = np.arange(256, dtype=np.int64) % 16  # of letters that are counted together, the common ones apart
_GROUPS[list(b"etaoinshrdlcumfpgwybvkxjqz0123456789")] = np.arange(36) % 16
_RNG = np.random.default_rng(1)
_LETTERS = _RNG.integers(1, 1 << 63, 256, dtype=U64)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_GONE = bytes(c for c in range(128) if _DROPPED.match(chr(c)))
_CLASSES = bytes(3 if c == 10 else 2 if c < 128 and _BLANK.match(chr(c)) else 1 for c in range(256))  # 1: kept, 2: blank, 3: line feed
_LETTERS[np.frombuffer(_CLASSES, np.uint8) != 1] = 0
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(U64).ravel()
_POWERS = [np.ones(1, U64), np.ones(1, U64)]
_SIZES = [1, 2, 3, 4, 5, 6]  # of blocks, in words; from there on by a quarter
while _SIZES[-1] < 1 << 40:
    _SIZES.append(_SIZES[-1] * 5 // 4 + 1)
_SIZES = np.array(_SIZES)


def narrowed(text: str) -> str:
    """Lower case; beyond ASCII, white space is a space and what is no letter or digit is dropped."""
    text = text.lower()
    if not text.isascii():
        data = text.encode()
        if data.translate(None, _COMMON) or b"\xc3\x97" in data or b"\xc3\xb7" in data:
            for c in set(_WIDE.findall(text)):
                text = text.replace(c, " " if c.isspace() else "")
    return text


def reduced(line: str) -> str:
    """Lower case, words at white space, of them letters and digits, one space between two."""
    return " ".join([w for w in (_DROPPED.sub("", x) for x in _BLANK.split(narrowed(line))) if w])


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, n at least."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(2 * n, base, U64)
                steps[0] = 1
                _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def _words(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut further: at letters of three bytes or more, and into pieces where they are long. Beginnings, ends, and whether a whole word begins there."""
    whole = np.ones(len(starts), bool)
    wide = np.flatnonzero(b >= 0xE0)
    if len(wide):
        cuts = np.setdiff1d(wide, starts, assume_unique=True)
        order = np.argsort(np.r_[starts, cuts], kind="stable")
        whole = np.r_[whole, np.zeros(len(cuts), bool)][order]
        last = ends[np.searchsorted(starts, np.r_[starts, cuts][order], side="right") - 1]
        starts = np.r_[starts, cuts][order]
        ends = np.minimum(np.r_[starts[1:], len(b)], last)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):
        more = (ends[long] - starts[long] - 1) // PIECE
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        cuts = np.repeat(starts[long], more) + PIECE * nth
        order = np.argsort(np.r_[starts, cuts], kind="stable")
        last = np.r_[ends, np.repeat(ends[long], more)][order]
        whole = np.r_[whole, np.zeros(len(cuts), bool)][order]
        starts = np.r_[starts, cuts][order]
        ends = np.minimum(np.r_[starts[1:], len(b)], last)
    return starts, ends, whole


def _simhash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The majority of each bit over the hashes of the words of each range. sums: of the words before each, eight counters of eight bits in a number."""
    count = end - begin
    with np.errstate(over="ignore"):  # what runs over in the prefix sums cancels out
        odds = (sums[np.minimum(begin + 255, end)] - sums[begin]).view(np.uint8).reshape(-1, 64)
        most = odds > (count >> 1).astype(np.uint8)[:, None]
        for k in np.flatnonzero(count > 255):  # a counter holds 255 words: longer ranges are summed in pieces
            cuts = np.r_[np.arange(begin[k], end[k], 255), end[k]]
            most[k] = 2 * (sums[cuts[1:]] - sums[cuts[:-1]]).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64) > count[k]
    return np.packbits(most, axis=1).view(U64).ravel()


def _plan(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lines of so many words: blocks counted from each end, and words in one."""
    halves = np.where(words < 16, 1, np.where(words < 64, 2, 4))
    size = np.where(words < 4, words - 1, words // (2 * halves))
    return halves, _SIZES[np.maximum(0, np.searchsorted(_SIZES, size, side="right") - 1)]


def _blocks(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of words that are blocks of lines: line, begin, end and a tag of size and place."""
    line, first, last, tag, before = [], [], [], [], None
    for words in (count, count - np.maximum(1, count // 10)):
        halves, size = _plan(words)
        for k in range(4):
            use = (k < halves) & (count >= BLOCKS)
            if before is not None:
                use &= (halves != before[0]) | (size != before[1])
            own = np.flatnonzero(use)
            head = begin[own] + k * size[own]
            tail = begin[own] + count[own] - (k + 1) * size[own]
            for side, at in ((0, head), (1, tail)):
                line.append(own)
                first.append(at)
                last.append(at + size[own])
                tag.append(size[own] * 8 + 2 * k + side)
        before = halves, size
    return tuple(np.concatenate(x) for x in (line, first, last, tag))


def _windows(word: list[np.ndarray], begin: np.ndarray, count: np.ndarray, places: tuple[int, ...], words: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words at these places from each word on, of lines of so many words, and to which lines they belong. word: hashes of the words as the first, second and third of a key."""
    own = np.flatnonzero((count >= max(words[0], places[-1] + 1)) & (count <= words[1]))
    each = count[own] - places[-1]
    owner = np.repeat(own, each)
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + begin[owner]
    with np.errstate(over="ignore"):
        key = np.full(len(at), U64(len(places)), U64)
        for hashes, k in zip(word, places, strict=False):
            key += hashes[at + k]
    return mix(key), owner


def _letters(b: np.ndarray, kind: np.ndarray, line: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of wanted lines how often letters of each of sixteen groups occur, up to 15, four bits each; a character counts by its first byte."""
    long = np.diff(np.r_[-1, np.flatnonzero(kind == 3), len(b) - 1])
    number = np.full(len(long), -1)
    number[line[wanted]] = np.flatnonzero(wanted)
    at = np.flatnonzero(np.repeat(number >= 0, long))
    use = (kind[at] == 1) & ((b[at] & 0xC0) != 0x80)
    at, of = at[use], np.repeat(number[number >= 0], long[number >= 0])[use]
    counts = np.bincount(of * 16 + _GROUPS[b[at]], minlength=16 * len(line)).reshape(-1, 16)
    counts = np.minimum(counts, 15).astype(np.uint8)
    return (counts[:, ::2] | counts[:, 1::2] << 4).view(U64).ravel()


def fingerprints(texts: list[str], with_keys: bool = False) -> tuple[np.ndarray, ...]:
    """Of every line with a word: number of its text, line number in it, ref (a hash of the words in their order), length of the reduced line, sketch (counts of letters of short lines, SimHash of long ones). With keys: also the keys, and to which of these lines each belongs.

    The texts are one array of bytes. A word's hash is polynomial, taken from prefix sums over the array.
    """
    data = narrowed("\n".join(texts)).encode().translate(None, _GONE)
    b, kind = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_CLASSES), np.uint8)
    inside = kind == 1
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(b) and inside[0]:
        edges = np.r_[0, edges]
    if len(edges) % 2:
        edges = np.r_[edges, len(b)]
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return (np.zeros(0, np.int64),) * (7 if with_keys else 5)
    starts, ends, whole = _words(b, starts, ends)
    power, inverse = _powers(len(b))
    with np.errstate(over="ignore"):
        letters = _LETTERS[b]
        letters *= power[: len(b)]
        word = mix(np.add.reduceat(letters, starts) * inverse[starts])  # blanks count nothing, so a word may be summed up to the next
    later = np.flatnonzero((b & 0xC0) == 0x80)  # bytes of a character that has begun
    size = ends - starts + whole - np.bincount(np.searchsorted(starts, later, side="right") - 1, minlength=len(starts))
    bounds = np.r_[0, np.searchsorted(starts, np.flatnonzero(kind == 3)), len(starts)]
    line = np.flatnonzero(bounds[1:] > bounds[:-1])
    begin, count = bounds[line], np.diff(bounds)[line]
    place = np.arange(len(word)) - np.repeat(begin, count)
    with np.errstate(over="ignore"):
        ref = mix(np.add.reduceat(mix(word + (2 * place + whole).astype(U64) * U64(_BASE)), begin))
    n = np.add.reduceat(size, begin) - 1
    with np.errstate(over="ignore"):
        odds = np.zeros((len(word) + 1, 8), U64)
        np.cumsum(_LANES[word.view(np.uint8)].reshape(-1, 8), axis=0, out=odds[1:])
    short = n < COUNTED
    sim = np.where(short, _letters(b, kind, line, short), _simhash(odds, begin, np.where(short, begin, begin + count)))
    first = np.cumsum([0, *(t.count("\n") + 1 for t in texts)])
    text = np.searchsorted(first, line, side="right") - 1
    out = text, line - first[text], ref.view(np.int64), n, sim.view(np.int64)
    if not with_keys:
        return out
    count = np.where(n < SHORTEST, 0, count)
    owner, head, tail, tag = _blocks(begin, count)
    with np.errstate(over="ignore"):
        keys = mix(_simhash(odds, head, tail) ^ mix(tag.astype(U64) * U64(_BASE))) if len(owner) else np.zeros(0, U64)
    with np.errstate(over="ignore"):
        placed = [word * U64(_BASE), word * U64(_FACTORS[0]), word * U64(_FACTORS[1])]
    windows = [_windows(placed, begin, count, places, words) for words, places in WINDOWS]
    return *out, np.concatenate([keys, *(k for k, _ in windows)]), np.concatenate([owner, *(o for _, o in windows)])


def _deal(buckets: int):
    """Texts (id, key, text) to rows of their lines that have a word (kind 0, or 3 where the task has seen that line before: id, key, line, ref), of themselves (kind 1: id, key, n lines, 0 for null) and packed rows of the keys of a bucket (kind 2: bucket as line, data)."""

    names = ["kind", "id", "key", "line", "ref", "n", "data"]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def batch_of(kind: int | np.ndarray, rows: int, **columns) -> pa.RecordBatch:
        given = columns | {"kind": np.broadcast_to(np.int32(kind), rows)}
        return pa.RecordBatch.from_arrays([pa.nulls(rows, t) if c not in given else pa.array(given[c], t) for c, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def lines_of(ids: list[int], keys: list[int], texts: list[str]) -> pa.RecordBatch:
            text, line, ref, n, sim, block, owner = fingerprints(texts, True)
            if len(seen) > MAX_CACHED:
                seen.clear()
            fresh = np.zeros(len(ref), bool)
            _, first = np.unique(ref, return_index=True)
            fresh[[k for k, r in zip(first.tolist(), ref[first].tolist(), strict=True) if r not in seen]] = True
            seen.update(ref[fresh].tolist())
            use = fresh[owner]
            owner = owner[use]
            held.append((block[use], ref[owner], n[owner].astype(np.uint32), sim[owner]))
            return batch_of(np.where(fresh, 0, 3), len(ref), id=np.array(ids, np.int64)[text], key=np.array(keys, np.int64)[text], line=line.astype(np.int32), ref=ref)

        def dealt() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            bucket = ((columns[0] >> U64(32)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            columns = [c[order] for c in columns]
            rows = [(b, b"".join([c[ends[b] : ends[b + 1]].tobytes() for c in columns])) for b in range(buckets) if ends[b] < ends[b + 1]]
            return batch_of(2, len(rows), line=[r[0] for r in rows], data=[r[1] for r in rows])

        ids, keys, texts, size = [], [], [], 0
        for batch in batches:
            own, key, bodies = (batch.column(k).to_pylist() for k in range(3))
            yield batch_of(1, len(own), id=own, key=key, n=[0 if t is None else t.count("\n") + 1 for t in bodies])
            for i, k, text in zip(own, key, bodies, strict=True):
                if text is not None:
                    ids.append(i)
                    keys.append(k)
                    texts.append(text)
                    size += len(text)
                if size > 1 << 19:
                    yield lines_of(ids, keys, texts)
                    ids, keys, texts, size = [], [], [], 0
                    if sum(len(h[0]) for h in held) > FLUSH_KEYS:
                        yield dealt()
        if texts:
            yield lines_of(ids, keys, texts)
        if held:
            yield dealt()

    return run


def _apart(n: np.ndarray) -> np.ndarray:
    return np.array(APART)[np.searchsorted(LENGTHS, n, side="right") - 1]


def _counts(x: np.ndarray) -> np.ndarray:
    """Counts of letters, a row of sixteen for each sketch."""
    b = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
    return np.hstack([b & 15, b >> 4]).view(np.int8)


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much counts of letters differ in all."""
    return np.abs(_counts(x) - _counts(y)).sum(1, dtype=np.int64)


def _possible(n, sim, m, other) -> tuple[np.ndarray, np.ndarray]:
    """Whether lengths and sketches allow an edit similarity of 0.9, and how unlike the sketches are. A short line and a long one have no sketches in common."""
    n, sim, m, other = np.broadcast_arrays(*map(np.atleast_1d, (n, sim, m, other)))
    large = np.maximum(n, m)
    ok, unlike = 10 * np.minimum(n, m) >= 9 * large, np.zeros(len(n), np.int64)
    for kind, measure, most in ((large < COUNTED, _between, 2 * (large // 10)), (np.minimum(n, m) >= COUNTED, lambda x, y: np.bitwise_count(x ^ y).astype(np.int64), _apart(large))):
        at = np.flatnonzero(ok & kind)
        unlike[at] = measure(sim[at], other[at])
        ok[at] = unlike[at] <= most[at]
    return ok, unlike


def _accompanied(n: np.ndarray, sim: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of the members of a set, in the order of their lengths, which have a possible partner but themselves in their window from low to high."""
    found, wide = np.zeros(len(n), bool), high - low
    cuts = np.searchsorted(np.cumsum(wide), np.arange(TOGETHER, wide.sum(), TOGETHER))
    for a, b in zip((0, *(cuts + 1)), (*(cuts + 1), len(n)), strict=True):
        if a >= b:
            continue
        each = wide[a:b]
        own = np.repeat(np.arange(a, b), each)
        other = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - low[a:b], each)
        own, other = (x[own != other] for x in (own, other))
        found[own[_possible(n[own], sim[own], n[other], sim[other])[0]]] = True
    return found


def _rows(kind, a, b, n, sim) -> pa.RecordBatch:
    columns = (np.full(len(a), kind, np.int32), a, b, n, sim)
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U64 else c) for c in columns], names=["kind", "a", "b", "n", "sim"])


def _partners(features: list[tuple]):
    """From (n, sim) of the members of a set to a function from those of any member to the numbers of its possible partners."""
    n, sim = np.array([f[0] for f in features]), np.array([f[1] for f in features], np.int64).view(U64)
    order = np.argsort(n, kind="stable")
    n, sim = n[order], sim[order]
    letters = _counts(sim)

    def partners(size: int, own: int) -> np.ndarray:
        low, high = np.searchsorted(n, -(-9 * size // 10)), np.searchsorted(n, size * 10 // 9, side="right")
        if low == high:
            return order[:0]
        own, large = np.array([own], np.int64).view(U64), np.maximum(n[low:high], size)
        if large[-1] < COUNTED:
            unlike = np.abs(letters[low:high] - _counts(own)).sum(1, dtype=np.int64)
            found = np.flatnonzero(unlike <= 2 * (large // 10))
        else:
            ok, unlike = _possible(n[low:high], sim[low:high], size, own)
            found = np.flatnonzero(ok)
        found, unlike = order[low + found], unlike[found]
        return found[np.lexsort((found, unlike))]

    return partners


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n and sim of both) that can be similar."""
    for batch in batches:
        na, nb, x, y = (batch.column(k).to_numpy() for k in range(2, 6))
        keep = _possible(na, x.view(U64), nb, y.view(U64))[0]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows, sorted by bucket, to pairs (kind 1) and members of sets (kind 2). Sets with the same smallest member become one."""

    def found(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for p in parts:
            m = len(p) // 28
            for to, kind, at in zip(columns, (U64, np.int64, np.uint32, U64), (0, 8 * m, 16 * m, 20 * m), strict=True):
                to.append(np.frombuffer(p, kind, m, at))
        key, ref, n, sim = (np.concatenate(c) for c in columns)
        order = np.lexsort((ref, key))
        order = order[np.r_[True, (key[order[1:]] != key[order[:-1]]) | (ref[order[1:]] != ref[order[:-1]])]]
        key, ref, n, sim = key[order], ref[order], n[order].astype(np.int64), sim[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        lists = [starts[sizes == 2][:, None] + np.array([[0, 1]])]
        for g in range(3, SMALL_SET + 1):
            i, j = np.triu_indices(g, 1)
            lists.append((starts[sizes == g][:, None, None] + np.stack([i, j], 1)).reshape(-1, 2))
        a, b = np.concatenate(lists).T
        ok = _possible(n[a], sim[a], n[b], sim[b])[0]
        pair = np.unique(np.sort(np.stack([ref[a[ok]], ref[b[ok]]]), axis=0), axis=1)
        if pair.shape[1]:
            zero = np.zeros(pair.shape[1], np.int64)
            yield _rows(1, pair[0], pair[1], zero, zero)
        for at, size in zip(starts[sizes > SMALL_SET].tolist(), sizes[sizes > SMALL_SET].tolist(), strict=True):
            m = at + np.argsort(n[at : at + size], kind="stable")
            if size <= ONE_TASK:
                # Partners are a tenth longer or shorter at most: a window of the lines by length.
                low, high = np.searchsorted(n[m], -(-9 * n[m] // 10)), np.searchsorted(n[m], n[m] * 10 // 9, side="right")
                m = m[_accompanied(n[m], sim[m], low, high)]
            if len(m) == 2:
                zero = np.zeros(1, np.int64)
                yield _rows(1, ref[m].min(keepdims=True), ref[m].max(keepdims=True), zero, zero)
            elif len(m):
                yield _rows(2, np.full(len(m), ref[m].min()), ref[m], n[m], sim[m])

    at, parts = -1, []
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != at and parts:
                yield from found(parts)
                parts = []
            at = bucket
            parts.append(data)
    if parts:
        yield from found(parts)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and the numbers and refs of lines that are wanted of them to the reduced lines."""
    for batch in batches:
        refs, bodies = [], []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = text.split("\n")
            for w in wanted:
                refs.append(w["ref"])
                bodies.append(reduced(own[w["line"]]))
        yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(bodies, pa.string())], names=["ref", "body"])


def unlike_parts(x: str, y: str) -> tuple[str, str]:
    """What is left of two lines without their common beginning and end; the edit distance stays."""

    def common(same, most: int) -> int:
        low = 0
        while low < most:
            mid = (low + most + 1) // 2
            low, most = (mid, most) if same(mid) else (low, mid - 1)
        return low

    k = common(lambda m: x[:m] == y[:m], min(len(x), len(y)))
    x, y = x[k:], y[k:]
    k = common(lambda m: x[len(x) - m :] == y[len(y) - m :], min(len(x), len(y)))
    return x[: len(x) - k], y[: len(y) - k]


def edits_at_most(x: str, y: str, most: int) -> int:
    """So many edits suffice, by words: where the lines part, the next place within twelve words at which two words agree again is looked for. Gives up beyond most."""
    a, b, total, i, j = x.split(" "), y.split(" "), 0, 0, 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        found = []
        for skip in range(1, 13):
            for p in range(max(0, skip - (m - j) + 1), min(skip, n - i - 1) + 1):
                q = skip - p
                if a[i + p] == b[j + q] and a[i + p + 1 : i + p + 2] == b[j + q + 1 : j + q + 2]:
                    found.append((max(len(" ".join(a[i : i + p])), len(" ".join(b[j : j + q]))) + (not p or not q), p, q))
            if found:
                break
        if not found:
            break
        cost, p, q = min(found)
        total, i, j = total + cost, i + p, j + q
        if total > most:
            return total
    return total + (max(len(" ".join(a[i:])), len(" ".join(b[j:]))) + 1 if i < n or j < m else 0)


def distance(x: str, y: str, most: int) -> int:
    """The edit distance; some number above most if the lengths tell that it is above most. A column of the table of distances is two numbers, of which a bit says where it rises or falls."""
    if abs(len(x) - len(y)) > most or not x or not y:
        return max(len(x), len(y))
    letters = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = {chr(c): int.from_bytes(np.packbits(letters == c, bitorder="little").tobytes(), "little") for c in np.unique(letters).tolist()}
    up = every = (1 << len(x)) - 1
    down, get = 0, places.get
    for c in y:
        same = get(c, 0)
        still = same | down
        across = (((same & up) + up) ^ up) | same
        rise = (down | (across | up) & every ^ every) << 1 | 1
        up = (up & across) << 1 & every | (still | rise) & every ^ every
        down = rise & still
    return len(y) + up.bit_count() - down.bit_count()


def _placed(lines: list[str], sizes: np.ndarray, first: np.ndarray, columns: int, fill: int) -> np.ndarray:
    """Letters, a row for each line, which begins at its place; the rest is filled up."""
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full((len(lines), columns), fill, np.uint32)
    out[np.repeat(np.arange(len(lines)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)] = flat
    return out


def _banded(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Whether lines of up to BAND characters have an edit similarity of 0.9. Of a table of distances only the diagonals are kept that so many edits reach, a bit each in one to four numbers, of many tables at once."""
    sizes = np.array([(len(x), len(y)) for x, y in pairs], np.int64).reshape(-1, 2)
    limit, found = sizes.max(1, initial=0) // 10, np.zeros(len(pairs), bool)
    order = np.flatnonzero(np.abs(sizes[:, 0] - sizes[:, 1]) <= limit)
    words = 2 * limit // STRETCH + 1  # of the band
    order = order[np.lexsort((sizes[order, 1], words[order]))]
    cuts = np.r_[np.arange(AT_ONCE // 4, len(order), AT_ONCE // 4), np.flatnonzero(np.diff(words[order])) + 1]
    top, one, ones = U64(STRETCH - 1), U64(1), ~U64(0)
    for at in np.split(order, np.unique(cuts)):
        if len(at) < FEW:
            found[at] = [edits_at_most(*pairs[k], limit[k]) <= limit[k] or distance(*unlike_parts(*pairs[k]), limit[k]) <= limit[k] for k in at.tolist()]
            continue
        (n, m), most, wide = sizes[at].T, limit[at], int(words[at[0]])
        band = STRETCH * wide
        x = _placed([pairs[k][0] for k in at], n, band - 1 - most, band + max(int(m.max()), int((n - most).max())), (1 << 32) - 1)
        y = _placed([pairs[k][1] for k in at], m, np.zeros(len(at), np.int64), int(m.max()), (1 << 32) - 2)
        if max(np.where(x >> 31, 0, x).max(), np.where(y >> 31, 0, y).max()) < 254:
            x, y = x.astype(np.uint8), y.astype(np.uint8)  # what is filled up stays unlike
        y = np.ascontiguousarray(y.T)
        first = [band - 1 - most - STRETCH * w for w in range(wide)]  # bits from here on are rows of the table
        up = [np.where(f >= STRETCH, U64(0), ones << np.clip(f, 0, STRETCH - 1).astype(U64)) for f in first]
        down, edits = [np.zeros(len(at), U64)] * wide, most.copy()
        last = n - most  # the column at which the lowest diagonal meets the end of the line
        least = last.min()
        for i in range(len(y)):
            if i % 32 == 31:  # the way back to the end takes no more edits away than this
                use = edits <= 2 * most + m - n
                if not use.all():
                    at, n, m, most, last, x, edits = (v[use] for v in (at, n, m, most, last, x, edits))
                    up, down, y = [v[use] for v in up], [v[use] for v in down], np.ascontiguousarray(y[:, use])
                    if not len(at):
                        break
            same = np.packbits(x[:, i : i + band] == y[i][:, None], axis=1, bitorder="little").view(U64)
            across, rise, fall, carry = [], [], [], None
            for w in range(wide):
                own, u = same[:, w], up[w]
                both = own & u
                total = both + u
                if wide > 1:
                    over = total < u
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    carry = over.astype(U64)
                across.append((total ^ u) | own | down[w])
                rise.append(down[w] | ~(across[w] | u))
                fall.append(across[w] & u)
            if i < least:
                edits += 1 - (across[-1] >> top).view(np.int64)
            else:
                bit = np.clip(band - 2 + last - i, 0, band - 1)
                shift, late = (bit % STRETCH).astype(U64), np.zeros(len(at), np.int64)
                for w in range(wide):
                    step = ((rise[w] >> shift) & one).view(np.int64) - ((fall[w] >> shift) & one).view(np.int64)
                    late += step if wide == 1 else np.where(bit // STRETCH == w, step, 0)
                edits += np.where(i < last, 1 - (across[-1] >> top).view(np.int64), np.where(i < m, late, 0))
            for w in range(wide):
                across[w] = across[w] >> one | across[w + 1] << top if w + 1 < wide else across[w] >> one
                rise[w], fall[w] = across[w] & rise[w], fall[w] | ~(across[w] | rise[w])
            up, down = fall, rise
        found[at] = edits <= most
    return found


def _close(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Whether lines have an edit similarity of 0.9."""
    long = np.array([max(len(x), len(y)) > BAND for x, y in pairs], bool)
    keep = long.copy()
    keep[~long] = _banded([p for p, far in zip(pairs, long, strict=True) if not far])
    for k in np.flatnonzero(long).tolist():
        most = max(map(len, pairs[k])) // 10
        keep[k] = edits_at_most(*pairs[k], most) <= most or distance(*unlike_parts(*pairs[k]), most) <= most
    return keep


def _stretch_edits(table: np.ndarray, of: np.ndarray, letters: np.ndarray, which: np.ndarray, first: np.ndarray, steps: int) -> np.ndarray:
    """For each pair the least edits between a stretch and any part of the line beside it in a window. table: of each stretch the places of each letter, as bits; letters: of the lines, a column for each; of, which: whose stretch and whose line; first: where the windows begin; steps: how long they are."""
    up, down = np.full(len(of), ~U64(0)), np.zeros(len(of), U64)
    edits = np.full(len(of), STRETCH, np.int64)
    least, flat, rows, top, one = edits.copy(), table.ravel(), of * table.shape[1], U64(STRETCH - 1), U64(1)
    line, at, wide = letters.ravel(), first * letters.shape[1] + which, letters.shape[1]
    for _ in range(steps):
        same = flat[rows + line[at]]
        at += wide
        across = same & up
        across += up
        across ^= up
        across |= same
        same |= down
        rise = across | up
        np.invert(rise, out=rise)
        rise |= down
        up &= across
        edits += (rise >> top).view(np.int64)
        edits -= (up >> top).view(np.int64)
        np.minimum(least, edits, out=least)
        rise <<= one  # a part may begin anywhere: the row above stays 0
        up <<= one
        down = rise & same
        same |= rise
        np.invert(same, out=same)
        up |= same
    return least


def _coded(heads: list[str]) -> np.ndarray:
    """Letters as numbers below 64, a row for each line, filled up with 64; unlike letters may have the same."""
    out = np.full((len(heads), max(map(len, heads))), STRETCH, np.uint8)
    for row, head in zip(out, heads, strict=True):
        row[: len(head)] = np.frombuffer(head.encode("utf-32-le", "surrogatepass"), np.uint32) & 63
    return out


def _not_far(left: list[dict], right: list[dict], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs of places in lists of lines (head: the beginning, HEAD characters of it at least, chars: length) may have an edit similarity of 0.9; no pair that has is ruled out.

    A line is cut into stretches. Those of one line are found in the other no further away than the edits
    before and after allow together, and the edits of the stretches add up to those of the line at most. The
    numbers of letters run together at times, which only makes fewer edits.
    """
    keep = np.ones(len(i), bool)
    n, m = (np.array([r["chars"] for r in side], np.int64) for side in (left, right))
    most, longer = np.maximum(n[i], m[j]) // 10, m[j] - n[i]
    keep &= np.abs(longer) <= most
    order = np.flatnonzero(keep)[np.argsort(most[keep], kind="stable")]
    steps = np.searchsorted(most[order], 8 * 1.5 ** np.arange(1, 32))  # windows of a block are about as wide
    cuts = np.unique(np.r_[steps, np.arange(0, len(order), AT_ONCE), len(order)])
    for at in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)):
        used, own = np.unique(i[at], return_inverse=True)
        met, other = np.unique(j[at], return_inverse=True)
        x, y, wide = _coded([left[r]["head"][:HEAD] for r in used]), _coded([right[r]["head"][:HEAD] for r in met]), int(most[at].max())
        each, around = x.shape[1] // STRETCH, np.full((len(met), wide + 1), STRETCH, np.uint8)
        y = np.ascontiguousarray(np.hstack([around, y, np.full((len(met), max(0, x.shape[1] - y.shape[1])), STRETCH, np.uint8), around, around]).T)
        x = x[:, : each * STRETCH].reshape(-1, STRETCH)
        table, row = np.zeros((len(x), STRETCH + 1), U64), np.arange(len(x))
        for place in range(STRETCH):
            table[row, x[:, place]] |= U64(1) << U64(place)
        table[:, STRETCH] = 0
        size, limit, low, whole = np.minimum(n[i[at]], HEAD), most[at], (longer[at] - most[at]) // 2, m[j[at]] <= HEAD
        edits, apart = np.zeros(len(at), np.int64), max(1, each * 20 // (wide + 20))
        for few in (np.arange(0, each, apart), np.setdiff1d(np.arange(each), np.arange(0, each, apart))):  # some show most
            pair, begin = np.repeat(np.flatnonzero(edits <= limit), len(few)), np.tile(few * STRETCH, (edits <= limit).sum())
            known = (begin + STRETCH <= size[pair]) & (whole[pair] | (begin + STRETCH + low[pair] + limit[pair] + 1 <= HEAD))
            pair, begin = pair[known], begin[known]
            for k in range(0, len(pair), 2 * AT_ONCE):
                p, b = pair[k : k + 2 * AT_ONCE], begin[k : k + 2 * AT_ONCE]
                found = _stretch_edits(table, own[p] * each + b // STRETCH, y, other[p], b + low[p] + wide + 1, STRETCH + wide + 1)
                np.add.at(edits, p, found)
        keep[at] = edits <= limit
    return keep


def _whole(line: dict) -> bool:
    return line["chars"] <= len(line["head"])


def _alike(left: list[dict], right: list[dict], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs of places in lists of lines (see _not_far) have an edit similarity of 0.9; where more than the head is to be seen, whether they may have."""
    chars = np.maximum(np.array([r["chars"] for r in left], np.int64)[i], np.array([r["chars"] for r in right], np.int64)[j])
    keep = chars <= NARROW
    far = np.flatnonzero(~keep)
    keep[far] = _not_far(left, right, i[far], j[far])
    told = [k for k in np.flatnonzero(keep).tolist() if _whole(left[i[k]]) and _whole(right[j[k]])]
    keep[told] = _close([(left[i[k]]["head"], right[j[k]]["head"]) for k in told])
    return keep


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of up to NARROW characters are compared as they are. Of most longer ones that are similar the words show it; of the others stretches show most that are not, and the unlike parts of the rest are compared."""

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        each = np.arange(len(rows))
        left, right = ([{"head": r[k][:HEAD], "chars": len(r[k])} for r in rows] for k in (2, 3))
        return links([rows[k] for k in each[_not_far(left, right, each, each)].tolist()])

    def links(tried: list[tuple], known: list[tuple] = ()) -> pa.RecordBatch:
        found = [*known, *(tried[k] for k in np.flatnonzero(_close([r[2:] for r in tried])).tolist())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows, short, size = [], [], 0
    for batch in batches:
        found = []
        for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            most = max(len(x), len(y)) // 10
            if max(len(x), len(y)) <= NARROW:
                short.append((a, b, x, y))
            elif edits_at_most(x, y, most) <= most:
                found.append((a, b))
            else:
                rows.append((a, b, x, y))
                size += len(x) + len(y)
        full = short if len(short) >= AT_ONCE else []
        short = [] if full else short
        yield links(full, found)
        if len(rows) >= AT_ONCE or size > 1 << 22:
            yield compared(rows)
            rows, size = [], 0
    yield links(short)
    if rows:
        yield compared(rows)


def similar(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, lines x and y) with an edit similarity of 0.9 or more: at most a tenth of the longer line's characters are edits."""
    return pairs.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long")


def _rows_of(docs: DataFrame) -> DataFrame:
    """id and key of every row, by which rows are told apart: rows that share both are equal in id and text."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(docs["text"]).alias("key"), docs["text"].alias("text"))


def repeated_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, key and n_lines of every text, and id, key and line (from 0) of every line that goes (see _rows_of; once a row or more often).

    Lines without a word always stay. Unlike rows of one doc_id are rows of their own; rows that
    repeat a doc_id and a text lose the same lines, so a line stays in all of them or in none. Rows
    with a null doc_id come after all others. Null texts have no lines.
    """
    spark = docs.sparkSession
    parts = BUCKETS * shuffle_partitions(spark)
    rows = _rows_of(docs)
    dealt = rows.select("id", "key", "text").mapInArrow(_deal(parts), "kind int, id long, key long, line int, ref long, n long, data binary")
    every = materialize(dealt, "lines", by="kind")
    texts = every.where("kind = 1").select("id", "key", F.col("n").alias("n_lines"))
    lines = every.where("kind in (0, 3)").select("id", "key", "line", "ref")
    packed = every.where("kind = 2").select(F.col("line").alias("bucket"), "data")
    found = materialize(packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_candidates, "kind int, a long, b long, n long, sim long"), "line-candidates")
    discard(every, part="kind=2")  # the keys are most of that table
    pairs = found.where("kind = 1").select("a", "b")
    sets = materialize(found.where("kind = 2").select(F.col("a").alias("name"), F.col("b").alias("ref"), "n", "sim").distinct(), "sets")
    wanted = found.select(F.explode(F.array("a", "b")).alias("ref")).distinct()  # a set bears the name of a member
    # Of a line that a task has seen before, another row is looked up. The side that is built has a key once; rows with texts and the many lines need no sort then.
    first = every.where("kind = 0").select("id", "key", "line", "ref").join(wanted.hint("shuffle_hash"), "ref").groupBy("ref").agg(F.min(F.struct("id", "key", "line")).alias("first"))
    where = first.groupBy(F.col("first.id").alias("id"), F.col("first.key").alias("key")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "ref")).alias("wanted"))
    bodies = rows.join(where.hint("shuffle_hash"), ["id", "key"]).select("text", "wanted").mapInArrow(_texts, "ref long, body string").dropDuplicates(["ref"])
    bodies = materialize(bodies, "bodies", ROWS)

    def verify(edges: DataFrame) -> DataFrame:
        left, right = bodies.select(F.col("ref").alias("a"), F.col("body").alias("x")), bodies.select(F.col("ref").alias("b"), F.col("body").alias("y"))
        return similar(edges.join(right, "b").join(left, "a"))

    def screen(star: DataFrame) -> DataFrame:
        return star.select("a", "b", "n_a", "n_b", "sim_a", "sim_b").mapInArrow(_screened, "a long, b long")

    def finer(refs: DataFrame) -> DataFrame:
        # Lengths of similar lines are in the same step of a tenth, or in neighbouring ones.
        step = F.floor(F.log("n") / F.log(F.lit(10 / 9)) / 1.0001)
        return sets.select("ref", "n").distinct().join(refs.distinct(), "ref").select("ref", F.explode(F.array(step, step + 1)).alias("key"))

    heads = bodies.select("ref", F.substring("body", 1, WHOLE).alias("head"), F.length("body").alias("chars"))
    labels = linked(pairs, sets, screen, verify, _partners, finer, (heads.select("ref", F.struct("head", "chars").alias("head")), _whole, _alike))
    repeated = lines.groupBy("ref").agg(F.count("*").alias("times")).where("times > 1").select("ref")
    marked = repeated.join(labels.withColumnRenamed("node", "ref"), "ref", "full").select("ref", F.coalesce("comp", "ref").alias("comp"))
    places = materialize(lines.join(marked.hint("shuffle_hash"), "ref").select("id", "key", "line", "comp"), "places")
    discard(labels, bodies, found, sets)
    keep = places.groupBy("comp").agg(F.min(F.struct("id", "key", "line")).alias("keep"))
    return texts, places.join(keep, "comp").where("struct(id, key, line) <> keep").select("id", "key", "line")


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_kept, dropped (line numbers from 0, ascending).

    n_lines: line feeds plus one, 0 for a null text. An empty table gives no rows.
    """
    texts, gone = repeated_lines(docs)
    gone = gone.groupBy("id", "key").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    out = texts.join(gone, ["id", "key"], "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select(F.when(F.col("id") < NO_ID, F.col("id")).alias("doc_id"), "n_lines", (F.col("n_lines") - F.size(dropped)).alias("n_kept"), dropped.alias("dropped"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with the texts that are left when the repeated lines go."""
    gone = repeated_lines(docs)[1].groupBy(F.col("id").alias("_mr_id"), F.col("key").alias("_mr_key")).agg(F.collect_set("line").alias("_mr_gone"))
    own = docs.withColumn("_mr_id", F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))).withColumn("_mr_key", F.xxhash64(docs["text"]))
    out = own.join(gone, ["_mr_id", "_mr_key"], "left")
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_mr_gone", i)), "\n")
    return out.withColumn("text", F.when(F.col("_mr_gone").isNull(), F.col("text")).otherwise(rest)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
