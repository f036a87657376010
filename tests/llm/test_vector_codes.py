"""Vector codes against rounds that take every distance."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import vector_codes


def brute(rows, entries=256, rounds=4):
    """(vec_id, embedding, label) to sorted rows of the query, in whole numbers of any size, for vectors of one length."""
    kept = [(i, [math.floor(1024 * x) for x in v], b) for i, v, b in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1])
    edges = [k * d // 4 for k in range(5)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))[:entries]
    books = [[list(r[1][a:b]) for r in first] for a, b in zip(edges, edges[1:], strict=False)]

    def nearest(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for step in range(rounds + 1):
        found = [[nearest(x[a:b], books[k]) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))] for _, x, _ in kept]
        if step < rounds:
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                groups = defaultdict(list)
                for (_, x, _), f in zip(kept, found, strict=True):
                    groups[f[k][1]].append(x[a:b])
                for j, xs in groups.items():
                    books[k][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    by_label = defaultdict(int)
    for (_, _, b), f in zip(kept, found, strict=True):
        by_label[b] += sum(e for e, _ in f)
    return sorted((str(i), bytes(j for _, j in f).hex(), sum(e for e, _ in f), by_label[b], digest) for (i, _, b), f in zip(kept, found, strict=True))


def answered(spark, rows, entries=256, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("code", F.lit("clash")).withColumn("d", F.lit(1)).repartition(parts)
    out = vector_codes.code_digests(*vector_codes.compress(df, entries=entries)).collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in out)


@pytest.mark.parametrize("kind", ["clusters", "ties", "wide"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(20, 8)), 30, 0) + rng.normal(size=(600, 8)) * 0.05
    elif kind == "ties":  # few values: many equal distances and equal entries
        x = rng.integers(-2, 3, size=(500, 6)) / 1024
    else:
        x = rng.normal(size=(150, 300)) * 100
    rows = [(int(k), v, rng.choice(["a", "b", None])) for k, v in zip(rng.permutation(len(x)), x.tolist(), strict=True)]
    assert answered(spark, rows, 40) == brute(rows, 40)


def test_edges(spark):
    rng = random.Random(5)
    rows = [(k % 90, [rng.choice([0.0, -0.0, 0.5, -0.25, 1e-9]) for _ in range(8)], rng.choice(["x", None])) for k in range(120)]
    rows += [(1, None, "x"), (2, [1.0] * 7 + [None], "x"), (3, [float("nan")] * 8, "x"), (4, [float("inf")] + [0.0] * 7, None), (None, [0.5] * 8, "y"), (None, [0.5] * 8, "y"), (5, [131072.0] * 8, "y"), (5, [-131072.0] * 8, "y")]
    assert answered(spark, rows) == brute(rows)


def test_lengths_apart(spark):
    """Each length has codebooks of its own; empty vectors and huge components are answered too."""
    rng = random.Random(6)
    groups = {d: [(k, [rng.uniform(-1, 1) for _ in range(d)], str(d)) for k in range(30)] for d in (1, 5, 8)}
    got = answered(spark, [r for g in groups.values() for r in g] + [(7, [], "none"), (8, [1e300] * 4, "huge"), (9, [-1e300] * 4, "huge")], 10)
    for d, g in groups.items():
        assert [r for r in got if r in set(want := brute(g, 10))] == want, d
    assert len(got) == 93 and [r[1:4] for r in got if r[0] == "7" and r[2] == 0][0] == ("00000000", 0, 0)


def test_empty(spark):
    assert answered(spark, []) == [] and answered(spark, [(1, None, "a")]) == []


def test_pruning_changes_nothing():
    """Rounds with bounds equal rounds without; on grouped vectors few distances are taken."""
    rng = np.random.default_rng(1)
    x = (np.repeat(rng.normal(size=(64, 16)) * 2000, 60, 0) + rng.normal(size=(3840, 16)) * 300).astype(np.int64)
    book = x[rng.permutation(len(x))[:64]]
    bounds, shares = vector_codes.assign_all(x, vector_codes.Geometry(book, None)), []
    for _ in range(5):
        before, book = book, np.array([np.floor(x[bounds.code == j].mean(0)) if (bounds.code == j).any() else book[j] for j in range(64)]).astype(np.int64)
        data, step = vector_codes._packed(bounds.lower)
        kept = vector_codes._unpacked(data, step)
        assert (kept <= bounds.lower).all()
        bounds, taken = vector_codes.assign_again(x, bounds._replace(lower=kept), vector_codes.Geometry(book, before))
        squared = vector_codes._squared(x, book)
        assert (bounds.code == squared.argmin(1)).all()
        assert (bounds.lower**2 <= squared * (1 + 1e-9)).all() and (bounds.upper**2 >= squared.min(1)).all()
        shares.append(taken / squared.size)
    assert max(shares) < 0.25


def test_decode(spark):
    rows = [(k, [((k * j) % 7) / 8 for j in range(8)], None) for k in range(40)]
    codes, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    error = {r.vec_id: r.error for r in codes.collect()}
    for r in vector_codes.decode(codes, books).collect():
        given = [math.floor(1024 * x) for x in rows[r.vec_id][1]]
        assert sum((a - 1024 * b) ** 2 for a, b in zip(given, r.embedding, strict=True)) == error[r.vec_id]
