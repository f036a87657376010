"""Sharding and mixing by their laws."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, sharding


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, fill = (low + high) // 2, 1, 0
        for s in sizes:
            if fill + s > mid:
                used, fill = used + 1, 0
            fill += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize(("groups", "shards", "hot"), [(3000, 16, 0), (40, 16, 0), (5, 16, 0), (2000, 7, 40_000), (1, 3, 0)])
def test_minimax(spark, groups, shards, hot):
    rng = random.Random(groups)
    sizes = {f"{rng.randrange(16**32):032x}": rng.randrange(1, 300) for _ in range(groups)}
    if hot:
        sizes[f"{5 << 124:032x}"] = hot
    cuts = sharding.minimax_cuts(spark.createDataFrame(list(sizes.items()), "g string, bytes long"), shards)
    load = Counter()
    for g, s in sizes.items():
        load[sum(c <= g for c in cuts)] += s
    assert max(load.values()) == least_capacity([sizes[g] for g in sorted(sizes)], shards)


def test_shard_laws(edge_rows, edge_docs):
    out = sharding.shard(edge_docs, 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and 0 <= r.shard < 4 and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = defaultdict(set)
    for r in out:
        if r["size"] > 1:  # a null text and an empty one are two groups
            homes[r.text_crc32, r["size"]].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())


def targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(w[s] for s in names if s not in capped)
        t = {s: most * sizes[s] if s in capped else left * w[s] / share for s in names}
        over = {s for s in names if s not in capped and t[s] > most * sizes[s]}
        if not over:
            return t
        capped |= over


def count(text):
    return len((text or "").encode().split())


def test_mix_laws(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "B", "é", None, "c", "rare"] if k % 50 else ["rare"])) for k in range(700)]
    rows = [r for r in rows if r[2] != "rare" or r[0] % 9 == 0]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    want = targets(sizes)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, again = (mixing.mix(df.repartition(n)).collect() for n in (3, 5))
    key = lambda r: (r.doc_id, r.taken, r.position)
    assert sorted(map(str, map(key, out))) == sorted(map(str, map(key, again)))
    source, taken = {i: s for i, _, s in rows}, Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r["size"]
        assert (r.copies > 0) == (r.taken > 0) == (r.position is not None) and -(-r.taken // max(1, r["size"])) == r.copies
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_inverse(spark):
    y = [k / 20 for k in range(21)]
    df = spark.createDataFrame([(v, a) for v in y for a in (-0.5, 0.0, 0.5)], "y double, a double")
    for r in df.withColumn("t", mixing._inverse(F.col("y"), F.col("a"))).collect():
        assert r.t + r.a * (r.t * r.t - r.t) == pytest.approx(r.y)


def test_training_order(spark):
    rows = [(k, " ".join(["w"] * (k % 7 + 1)), "abc"[k % 3]) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    out = mixing.training_order(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: c for i, c in copies.items() if c})


def test_training_order_goes_by_rows(spark):
    """Null ids, equal rows, and unlike rows of one id: each comes as often as its places say."""
    rows = [(k, " ".join([f"w{k}"] * (k % 7 + 1)), "ab"[k % 2], {"m": k}) for k in range(40)]
    rows += [(None, "lost words", "a", None), (None, "more lost words", "a", None), (None, "lost words", "b", None), (None, "lost words", "b", None)]
    rows += [(5, "another text", "b", {"m": 1}), (5, "another text", "b", {"m": 2}), rows[3], rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string, int>").withColumn("key", F.lit("clash")).repartition(3)
    plan = mixing._plan(df, (5, 2, 1), (-0.5, 0.0, 0.5), 3, 17).withColumnRenamed("key", "k")
    want = Counter()
    for r in plan.join(df.withColumn("k", mixing.row_key(df)).select("k", "text", "source", "more").dropDuplicates(["k"]), "k").collect():
        want[r.doc_id, r.text, r.source, str(r.more)] += r.copies
    assert plan.count() == len(rows) and min(want[None, "lost words", s, "None"] for s in "ab") > 0
    out = mixing.training_order(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text, r.source, str(r.more)) for r in out.collect()) == +want


def test_mix_edge_cases(edge_rows, edge_docs):
    out = mixing.mix(edge_docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, count(t)) for i, t, *_ in edge_rows)
    ordered = mixing.training_order(edge_docs)
    assert ordered.columns == edge_docs.columns and ordered.count() == sum(r.copies for r in out)


def test_empty(no_docs):
    assert sharding.shard(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert mixing.training_order(no_docs).count() == 0
