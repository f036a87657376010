"""Packing by concatenate and cut.

First pass: every partition encodes its documents, each with an end id, numbers their tokens from 0, and
writes them down. The totals of the partitions, summed up in blocks, give each partition its place in
the one stream of all tokens. Second pass: the stream is cut into windows of equal length. A task hands
out the windows that it holds whole; what it holds of others, at the ends of its rows, goes as boundary
records to where these windows are put together. So tokens are shuffled at partition ends alone, and
only the last window of all can be short.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._work import discard, keep_alone, materialize

LENGTH, END = 1024, 0
#: The pattern of byte-level files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS, BATCH_ROWS = 1 << 21, 1000
MAX_WORDS, GROUP = 1 << 19, 1000
PARTS = 1024  # partitions in a block of the prefix sums
MANY_PARTS = 1 << 17  # partitions up to which their places are sent to all tasks: 2 MB

_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
_WINDOW = pa.schema([("sequence_id", pa.int64()), ("at", pa.int32()), ("ids", pa.binary()), ("pieces", pa.list_(_PIECE))])
_PIECES = "array<struct<doc_id:long,start:long,length:long,doc_tokens:long,offset:long>>"
_ENCODERS: dict[str, Encoder] = {}


def _byte_of() -> dict[str, int]:
    """The characters by which byte-level files write bytes: visible ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _pair_encoder(read: dict):
    """A byte-pair encoder that gives the ids of a byte-level file word by word, several times as fast as the file's own library; None where ids are not in the order of merges, which is what it goes by."""
    import tiktoken

    model, byte_of = read["model"], _byte_of()
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"].get(m, -1) for m in merged]
    special = {t["content"] for t in read["added_tokens"]}
    words = {t: i for t, i in model["vocab"].items() if t not in special}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or not plain or any(a >= b for a, b in zip(ids, ids[1:])) or ids[:1] == [-1] or {t for t in words if len(t) == 1} != set(byte_of) or {*merged, *byte_of} != set(words):
        return None
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in words.items()}
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """A tokenizer's file. Where it is byte-level, texts are cut before blanks that follow no white space, where its pattern cuts in any case, and the ids of words are kept for the worker's life."""

    _cut, _double = re.compile(r"(?<=[^\s\u180e]) "), re.compile(r"[\s\u180e] ")
    #: Characters whose kind is the same in every edition of Unicode that is in use.
    _settled = re.compile("[\t\n\r!-~\u00a1-\u052f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*[!-~\u00a1-\u052f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]").fullmatch

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(definition)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        read = json.loads(definition)
        cutter = read.get("pre_tokenizer") or {}
        self._by_words = not read.get("normalizer") and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        self._pairs = _pair_encoder(read) if self._by_words else None
        vocabulary = self._tokenizer.get_vocab()
        self._bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self._bytes[list(vocabulary.values())] = list(map(len, vocabulary))  # in byte-level files a character stands for a byte
        self._words: defaultdict[str, int] = defaultdict(count().__next__)  # to places in the list of ids
        self._ids: list[bytes] = []
        self._old: dict[str, bytes] = {}

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, words: list[str]) -> list[bytes]:
        """Ids of words, each after a blank: those that end in no white space and have settled characters by pairs, in texts that are cut again by the bytes of the tokens."""
        out: list = [None] * len(words)
        plain = [k for k, w in enumerate(words) if self._settled(w)] if self._pairs else []
        for at in range(0, len(plain), GROUP):
            group = plain[at : at + GROUP]
            text = " " + " ".join([words[k] for k in group])
            ids, data = np.array(self._pairs.encode_ordinary(text), "<u4"), np.frombuffer(text.encode(), np.uint8)
            after, ends = np.cumsum(self._bytes[ids]), np.r_[np.flatnonzero(data == ord(" "))[1:], len(data)]
            cuts = 4 * np.searchsorted(after, ends) + 4
            data, begin = ids.tobytes(), 0
            for k, end in zip(group, cuts.tolist(), strict=True):
                out[k] = data[begin:end]
                begin = end
        left = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(left, self._whole([" " + words[k] for k in left]), strict=True):
            out[k] = x
        return out

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        whole = [not self._by_words or any(s in t for s in self._special) for t in texts]
        parts = [[""] if w else (self._cut.split(t) if self._double.search(t) else t.split(" ")) for t, w in zip(texts, whole, strict=True)]
        heads = self._whole([t if w else p[0] for t, p, w in zip(texts, parts, whole, strict=True)])
        if len(self._ids) > MAX_WORDS:  # words not met again since the time before are forgotten
            self._old = dict(zip(self._words, self._ids, strict=True))
            self._words, self._ids = defaultdict(count().__next__), []
        place, known = self._words.__getitem__, len(self._ids)
        places = [list(map(place, p[1:])) for p in parts]
        met = list(islice(reversed(self._words), len(self._words) - known))[::-1]
        found = list(map(self._old.get, met))
        fresh = [w for w, ids in zip(met, found, strict=True) if ids is None]
        new = iter(self._fresh(fresh))
        self._ids += [next(new) if ids is None else ids for ids in found]
        ids = self._ids.__getitem__
        return [h + b"".join(map(ids, p)) for h, p in zip(heads, places, strict=True)]


def _encoder(definition: str) -> Encoder:
    keep_alone("packing", _ENCODERS.clear)
    if definition not in _ENCODERS:
        _ENCODERS[definition] = Encoder(definition)
    return _ENCODERS[definition]


def _encoded(definition: str, end: int):
    """Rows (doc_id, text) to doc_id, ids with the end id, and where they stand: part, and at, the number of the partition's tokens before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = _encoder(definition), TaskContext.get().partitionId(), 0
        mark = int(end).to_bytes(4, "little")
        for batch in batches:
            texts, begin, size = batch.column(1).to_pylist(), 0, 0
            for k, text in enumerate(texts, 1):
                size += len(text)
                if size < BLOCK_CHARS and k < len(texts):
                    continue
                ids = [x + mark for x in encode(texts[begin:k])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, k - begin), pa.array(np.full(len(ids), part)), pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "at", "n", "ids"]
                )
                at, begin, size = at + int(n.sum()), k, 0

    return run


def encoded(docs: DataFrame, definition: str, end: int = END) -> DataFrame:
    """A table, in the shared folder, of doc_id, part, at, n and ids (see pack) of every row of docs."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_encoded(definition, end), "doc_id long, part long, at long, n long, ids binary")
    return materialize(rows, "packing", BATCH_ROWS, "zstd")


def part_places(tokens: DataFrame) -> DataFrame:
    """part and base, the number of tokens in the parts before it. No task sums more than PARTS parts, or more blocks of them than there are."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("part") / PARTS))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = totals.withColumn("inside", F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(before.orderBy("block")), F.lit(0)).alias("ahead"))
    return inside.join(blocks, "block").select("part", (F.col("ahead") + F.col("inside")).alias("base"))


def _windows(length: int):
    """Rows (doc_id, place, n, ids) to windows, or parts of such: sequence_id, at, ids, pieces. Rows that follow each other in the stream are put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []  # of the window at hand: ids, and the documents they are of
        pieces: list[dict] = []
        begin = place = 0  # of what is held
        made: list[tuple] = []

        def close() -> None:
            if held:
                made.append((begin // length, begin % length, b"".join(held), pieces.copy()))
                held.clear()
                pieces.clear()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), _WINDOW.types, strict=True)], schema=_WINDOW)
            made.clear()
            return out

        for batch in batches:
            for doc_id, at, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != place:
                    close()
                start = 0
                while start < n:
                    place = at + start
                    if not held:
                        begin = place
                    take = min(n - start, length - place % length)
                    held.append(ids[4 * start : 4 * (start + take)])
                    pieces.append({"doc_id": doc_id, "start": start, "length": take, "doc_tokens": n, "offset": place % length})
                    start += take
                    place += take
                    if place % length == 0:
                        close()
                if len(made) >= 1024:
                    yield batch_of()
        close()
        if made:
            yield batch_of()

    return run


def pack(docs: DataFrame, definition: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Sequences of all documents: sequence_id, n_tokens, ids (little-endian unsigned 32-bit integers), pieces.

    docs: doc_id, text. definition: the content of a tokenizer's JSON file. A document's tokens are its
    ids, without special tokens, and the end id; a null or empty text has the end id alone. Documents
    stand in the order of the partitions of docs; every token is in one sequence, and every sequence but
    the last has length tokens. pieces: which tokens of which document stand where: doc_id, start (tokens
    of the document before), length, doc_tokens, offset. Rows that repeat are packed each; doc_id is
    carried along, null or not. An empty table gives no rows.
    """
    tokens = encoded(docs, definition, end)
    places = part_places(tokens)
    if (tokens.agg(F.max("part")).first()[0] or 0) < MANY_PARTS:
        places = F.broadcast(places)
    placed = tokens.join(places, "part").select("doc_id", (F.col("base") + F.col("at")).alias("place"), "n", "ids")
    cut = materialize(placed.mapInArrow(_windows(length), f"sequence_id long, at int, ids binary, pieces {_PIECES}"), "windows", BATCH_ROWS, "zstd")
    discard(tokens)
    whole = F.octet_length("ids") == 4 * length
    full = cut.where(whole).select("sequence_id", F.lit(length).alias("n_tokens"), "ids", "pieces")
    # A window at a boundary has at most one record a token.
    records = cut.where(~whole).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids", "pieces"))).alias("r"))
    joined = records.select("sequence_id", F.aggregate("r", F.lit(b""), lambda x, y: F.concat(x, y["ids"])).alias("ids"), F.flatten("r.pieces").alias("pieces"))
    return full.union(joined.select("sequence_id", (F.octet_length("ids") / 4).cast("int").alias("n_tokens"), "ids", "pieces"))


def piece_digests(sequences: DataFrame) -> DataFrame:
    """Of the rows of pack, a row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    digest = F.transform("pieces", lambda p: F.struct(p.alias("p"), F.crc32(F.substring(F.col("ids"), (4 * p["offset"] + 1).cast("int"), (4 * p["length"]).cast("int"))).alias("crc")))
    rows = sequences.select("sequence_id", F.explode(digest).alias("x"))
    return rows.select("x.p.doc_id", "x.p.start", "x.p.length", F.col("x.crc").alias("ids_crc32"), "x.p.doc_tokens", "sequence_id", "x.p.offset")


def read_definition(path: str) -> str:
    """The tokenizer's file, read on the driver; its size is that of a fixed vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_definition() -> str:
    import public_tokenizers

    return read_definition(public_tokenizers.path("byte_bpe_50k.json"))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    return piece_digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_definition()))


SQL: dict[str, str] = {}
