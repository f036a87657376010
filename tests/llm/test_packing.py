"""Packing by its laws, and against the library that it takes its ids from."""

from __future__ import annotations

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import packing


@pytest.fixture(scope="module")
def definition():
    return packing.default_definition()


@pytest.fixture(scope="module")
def library(definition):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


TRICKY = ["", " ", "  ", "a ", " a", "a  b", "a\n b", "a \nb", "it's we'll 'tis", "x᠎ y", "é è  ü", "z  y", "<|endoftext|> x", "y<|endoftext|>", "x\x1c y", "tab\t b ", "日本 語 ok", "👩‍👩‍👧 a", "1 2  3", "á b", "end ᠎"]


def test_encoder(definition, library):
    encode, rng = packing.Encoder(definition), random.Random(2)
    texts = TRICKY + ["".join(rng.choice(" \n\t'aAé1.!ñ  ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for part in (texts[:50], texts, texts[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(part)] == [library(t) for t in part]


def test_words_are_forgotten(definition, library, monkeypatch):
    monkeypatch.setattr(packing, "MAX_WORDS", 5)
    encode = packing.Encoder(definition)
    for k in range(40):
        text = " ".join(f"w{j}" for j in range(k % 7, k % 7 + 9))
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == library(text)
    assert len(encode._words) < 30 and len(encode._old) < 30


def test_other_tokenizers(definition):
    """A file with a normalizer is not cut into words."""
    from tokenizers import Tokenizer

    lower = json.dumps(json.loads(definition) | {"normalizer": {"type": "Lowercase"}})
    t = Tokenizer.from_str(lower)
    texts = ["Some Words of TEXT", *TRICKY]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(lower)(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def checked(rows, docs, library, length):
    """Every token of every document once, sequences gapless and full but for the last."""
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    sizes = {}
    for k, pieces in sequences.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        sizes[k] = at
    assert sorted(sizes) == list(range(len(sizes))) and all(n == length for k, n in sizes.items() if k < len(sizes) - 1) and all(0 < n <= length for n in sizes.values())
    want, got = Counter(), Counter()
    for doc_id, text in docs:
        ids = np.array([*library(text), 0], "<u4")
        want.update((doc_id, int(x)) for x in ids)
        mine = [r for r in whole[doc_id] if r.doc_tokens == len(ids)]
        if sum(d == doc_id for d, _ in docs) == 1:
            at = 0
            for r in sorted(mine, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
    for r in rows:
        got[r.doc_id] += r.length
    assert got == Counter({d: sum(n for (e, _), n in want.items() if e == d) for d, _ in want})


def test_laws(spark, edge_rows, edge_docs, definition, library):
    out = packing.piece_digests(packing.pack(edge_docs, definition)).collect()
    checked(out, [(i, t) for i, t, *_ in edge_rows], library, 1024)


@pytest.mark.parametrize(("length", "parts"), [(7, 1), (64, 13), (100, 60)])
def test_lengths(spark, definition, library, length, parts):
    """Windows over several partitions, some of them empty."""
    rng = random.Random(length)
    rows = [(k, rng.choice(TRICKY) + " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(30)))) for k in range(40)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    sequences = packing.pack(docs, definition, length)
    checked(packing.piece_digests(sequences).collect(), rows, library, length)
    for r in sequences.collect():
        assert r.n_tokens == len(r.ids) // 4 == sum(p.length for p in r.pieces)


def test_places(spark):
    """Prefix sums over more partitions than a block has."""
    tokens = spark.range(5000).select(F.col("id").alias("part"), (F.col("id") % 7).alias("n"))
    sums = np.cumsum([0, *(k % 7 for k in range(4999))])
    assert {r.part: r.base for r in packing.part_places(tokens).collect()} == dict(enumerate(sums.tolist()))


def test_empty(no_docs, definition):
    assert packing.pack(no_docs, definition).count() == 0
