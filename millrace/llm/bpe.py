"""Byte-level BPE encoding and decoding by merge replay over a corpus.

A block of texts is cut into words by the tokenizer's pattern. All distinct words of the block that
the worker has not met before are laid out end to end as linked tokens. An inverted index leads from
the rank of a pair of neighbours to the places where it stands; ranks are replayed in ascending
order, each applied at all its places from the left, and only the neighbours of a merged place get
new index entries. Words are independent, so blocks need no exchange of data between tasks.

Merges learned in order never make a pair of a lower rank than the one at hand. A rank file that was
not made so can; the words in which that happens are replayed alone, lowest rank first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import keep_alone

MAX_WORDS = 1 << 18
FEW = 24  # places, below which they are merged one by one
BLOCK_CHARS = 1 << 21
_CODECS: dict[str, Codec] = {}


class MergeReplay:
    """Encodes many words at once. ranks: token bytes to id; a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self._single = [ranks[bytes([b])] for b in range(256)]
        pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self._pairs = pairs
        self._keys = np.array(sorted(pairs) or [-1], np.int64)
        self._values = np.array([pairs.get(k, -1) for k in self._keys.tolist()], np.int32)

    def _rank(self, a: int, b: int) -> int:
        """The rank of two neighbours; -1 if they do not merge, or one is none."""
        return self._pairs.get(a << 32 | b, -1) if a >= 0 and b >= 0 else -1

    def _rank_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._values[at], -1)

    def encode(self, words: Sequence[bytes]) -> list[list[int]]:
        out: list = [[r] if (r := self.ranks.get(w)) is not None else [] for w in words]
        rest = [k for k, w in enumerate(words) if w and not out[k]]
        if not rest:
            return out
        # Words stand end to end, each after an empty place (-1), and there is one more at the end.
        size = np.fromiter((len(words[k]) for k in rest), np.int64, len(rest))
        starts = np.cumsum(size + 1) - size
        ids = np.full(int(size.sum()) + len(rest) + 1, -1, np.int32)
        filled = np.ones(len(ids), bool)
        filled[starts - 1] = filled[-1] = False
        ids[filled] = np.array(self._single, np.int32)[np.frombuffer(b"".join([words[k] for k in rest]), np.uint8)]
        nxt, prv = np.arange(1, len(ids) + 1), np.arange(-1, len(ids) - 1)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []
        odd: list[np.ndarray] = []

        def note(places: np.ndarray, ranks: np.ndarray, current: int) -> None:
            """Index pairs by rank; words in which a pair ranks before the one at hand are odd."""
            if (ranks < current).any():
                odd.append(places[(ranks < current) & (ranks >= 0)])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else ranks
            for r, part in zip(ranks[cuts].tolist(), np.split(places, cuts[1:]), strict=False):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(queue, r)

        note(np.arange(len(ids) - 1), self._rank_all(ids[:-1], ids[1:]), -1)
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            if sum(map(len, parts)) < FEW:
                self._merge_few(r, sorted({i for p in parts for i in p.tolist()}), ids, nxt, prv, index, queue, odd)
                continue
            at = np.unique(np.concatenate(parts))
            at = at[ids[at] >= 0]
            at = at[self._rank_all(ids[at], ids[nxt[at]]) == r]
            if not len(at):
                continue
            # Where places overlap, every other one of a run is taken, from the left.
            chained = np.r_[False, at[1:] == nxt[at[:-1]]]
            run = np.flatnonzero(~chained)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            between = self._rank_all(np.full(len(at), r, np.int32), ids[after])  # with what follows, before that merges itself
            odd.append(at[(between >= 0) & (between < r)])
            ids[at], ids[gone] = r, -1
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            note(np.r_[before, at], np.r_[self._rank_all(ids[before], ids[at]), self._rank_all(ids[at], ids[after])], r)
        places = np.concatenate(odd) if odd else np.zeros(0, np.int64)
        alone = set((np.searchsorted(starts, places, side="right") - 1).tolist())
        left = ids >= 0
        flat = ids[left].tolist()
        ends = np.cumsum(left)[starts + size - 1]
        begin = 0
        for n, (k, end) in enumerate(zip(rest, ends.tolist(), strict=True)):
            out[k] = self._alone(words[k]) if n in alone else flat[begin:end]
            begin = end
        return out

    def _merge_few(self, r: int, at: list[int], ids, nxt, prv, index: dict, queue: list, odd: list) -> None:
        """The same for few places, one by one from the left."""
        rank = self._rank
        for i in at:
            j = int(nxt[i])
            if ids[i] < 0 or rank(int(ids[i]), int(ids[j])) != r:
                continue
            after, before = int(nxt[j]), int(prv[i])
            ids[i], ids[j], nxt[i], prv[after] = r, -1, after, i
            for place, new in ((before, rank(int(ids[before]), r)), (i, rank(r, int(ids[after])))):
                if new >= 0:
                    here = np.array([place])
                    if new < r:
                        odd.append(here)
                    if new in index:
                        index[new].append(here)
                    else:
                        index[new] = [here]
                        heapq.heappush(queue, new)

    def _alone(self, word: bytes) -> list[int]:
        ids = [self._single[b] for b in word]
        nxt, prv = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        queue = [(r, i) for i in range(len(ids) - 1) if (r := self._rank(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = nxt[i]
            if ids[i] < 0 or j < 0 or self._rank(ids[i], ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b >= 0 and (new := self._rank(ids[a], ids[b])) >= 0:
                    heapq.heappush(queue, (new, a))
        out, at = [], 0
        while at >= 0:
            out.append(ids[at])
            at = nxt[at]
        return out


class Codec:
    """A rank file and a pattern. Ids of a word are kept as little-endian bytes, for the worker's life."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        import regex

        ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in rank_file.splitlines() if line)}
        self.replay = MergeReplay(ranks)
        self.words = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        parts = [self.words(t) for t in texts]
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        fresh = list({w for p in parts for w in p}.difference(self.known))
        for w, ids in zip(fresh, self.replay.encode([w.encode() for w in fresh]), strict=True):
            self.known[w] = b"".join([i.to_bytes(4, "little") for i in ids])
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


def codec(rank_file: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    keep_alone("bpe", _CODECS.clear)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, n = [], 0
    for t in texts:
        block.append(t)
        n += len(t)
        if n >= BLOCK_CHARS:
            yield block
            block, n = [], 0
    if block:
        yield block


def _mapped(docs: DataFrame, rank_file: bytes, pattern: str, schema: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        names = [part.split()[0] for part in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
        types = [kinds[part.split()[1]] for part in schema.split(", ")]
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1).to_pylist()):
                rows = list(zip(*(row(c, ids) for ids in c.encode(block)), strict=True))
                columns = [batch.column(0).slice(at, len(block)).cast(types[0]), *(pa.array(x, t) for x, t in zip(rows, types[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(block)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).mapInArrow(run, schema)


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver; its size is that of a fixed vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text. A null or empty text has no ids."""
    return _mapped(docs, rank_file, pattern, "doc_id long, ids array<int>", lambda c, ids: (memoryview(ids).cast("i").tolist(),))


def decode(encoded: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """doc_id and bytes of every row of ids; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(rank_file, pattern).replay.tokens
        for batch in batches:
            texts = [b"".join([tokens[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"]).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256. Null text counts as empty; an empty table gives no rows."""

    def row(c: Codec, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return _mapped(docs, rank_file, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def tokenized(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), lossless (the ids decode to the text's bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1).to_pylist()):
                ids = c.encode(block)
                same = [c.decode(x) == t.encode() for x, t in zip(ids, block, strict=True)]
                columns = [batch.column(0).slice(at, len(block)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "lossless"])
                at += len(block)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, lossless boolean")


def default_tokenizer() -> tuple[bytes, str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_tokenizer())


SQL: dict[str, str] = {}
