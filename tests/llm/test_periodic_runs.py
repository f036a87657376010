"""Periodic runs against a brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from millrace.llm import periodic_runs


def runs_brute(words):
    """Every stretch that keeps some period, of four periods and six words at least, under its smallest period."""
    found, n = {}, len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            begin = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - begin >= max(6, 4 * p):
                found.setdefault((begin, i + p - begin), p)
            i += 1
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed_brute(words):
    gone = {i for s, m, p in runs_brute(words) for i in range(s + p, s + m)}
    return [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("seed", range(6))
def test_block_runs(seed):
    """Words of few kinds hold nested, touching and overlapping runs."""
    rng = random.Random(seed)
    docs = [[rng.randrange(1 + seed % 3 + rng.randrange(2)) for _ in range(rng.randrange(0, 90))] for _ in range(60)]
    for _ in range(60):
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
        docs.append([rng.randrange(3) for _ in range(rng.randrange(5))] + (unit * 9)[: rng.randrange(4, 80)] + [rng.randrange(3) for _ in range(rng.randrange(5))])
    docs.append([0] * 700)
    docs.append([0, 1] * 300 + [0, 0, 1] * 200)
    assert periodic_runs.block_runs([np.array(d, np.int64) for d in docs]) == [runs_brute(d) for d in docs]


def test_extensions():
    rng = random.Random(3)
    words = [rng.randrange(2) for _ in range(300)] * 2 + [7]
    lce = periodic_runs.Extensions(np.array(words))
    pairs = [(i, j) for _ in range(3000) if (i := rng.randrange(len(words))) != (j := rng.randrange(len(words)))]

    def brute(i, j):
        k = 0
        while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
            k += 1
        return k

    i, j = np.array(pairs).T
    assert lce(i, j).tolist() == [brute(*p) for p in pairs]


def test_edges(spark, edge_rows, edge_docs, no_docs):
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(edge_docs).collect())
    small = [r for r in edge_rows if len(r[1] or "") < 30_000]
    want = [(str(i), len(w := (t or "").encode().split()), runs_brute(w), b" ".join(collapsed_brute(w)).decode()) for i, t, *_ in small]
    assert [r for r in got if r in want] == sorted(want) and len(got) == len(edge_rows)
    assert periodic_runs.periodic_runs(no_docs).count() == 0
    assert periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(no_docs))).count() == 0


def test_long_text(spark):
    """One text of 400,000 words, a third of them one run, among empty ones and white space beyond ASCII."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(90_000)}" for _ in range(140_000)] + [f"v{k % 1300}" for k in range(130_000)] + [f"x{rng.randrange(90_000)}" for _ in range(130_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None), (4, "a\u00a0b " * 9), (5, "a\u2003a a\x1fa " * 3)], "doc_id long, text string")
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(r) for r in found[1].runs] == [(140_000, 130_000, 1300)] and len(found[1].collapsed.split()) == 271_300
    assert [tuple(r) for r in found[4].runs] == [(0, 9, 1)] and found[4].collapsed == "a\u00a0b"
    assert found[5].n_words == 6 and found[5].runs == [] and found[2].collapsed == found[3].collapsed == ""


def test_query_rows(spark, edge_rows, edge_docs):
    """The query's rows, planted runs included, by their definition."""

    def want(doc_id, text):
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        return (str(doc_id), len(runs), *map(str, longest), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed_brute(words))).hexdigest())

    docs = edge_docs.where("doc_id is null or doc_id not in (9, 10)")
    more = spark.createDataFrame([(1000 + k, " ".join(f"u{k * j % 17}" for j in range(k % 70))) for k in range(300)], "doc_id long, text string")
    rows = [(i, t) for i, t, *_ in edge_rows if i not in (9, 10)] + [tuple(r) for r in more.collect()]
    out = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(docs.select("doc_id", "text").union(more)))).collect()
    got = [(str(r.doc_id), r.n_runs, str(r.start), str(r.length), str(r.period), str(r.exponent_milli), r.runs_sha256, r.collapsed_sha256) for r in out]
    assert sorted(got) == sorted(want(*r) for r in rows)
