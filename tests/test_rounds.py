"""Warm rounds against runs from nothing."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import rounds

SCHEMA = "group long, value long"


def summing(inputs):
    """A group's result is its own number and the largest result that it reads; zero gives no row."""

    def run_with(reads):
        def run(groups, results):
            seen = reads.join(results.select(F.col("group").alias("read"), "value"), "read").groupBy("group").agg(F.max("value").alias("above"))
            rows = inputs.join(groups, "group").join(seen, "group", "left")
            return rows.select("group", F.least(F.lit(60), F.col("n") + F.coalesce("above", F.lit(0))).alias("value")).where("value > 0")

        return run

    return run_with


def rows(df):
    return sorted(tuple(r) for r in df.select("group", "value").collect())


def test_a_chain_takes_rounds_and_cuts_off(spark):
    reads = spark.createDataFrame([(k, k - 1) for k in range(1, 12)], "group long, read long")
    before = spark.createDataFrame([(k, 1) for k in range(12)], "group long, n long")
    after = before.withColumn("n", F.when(F.col("group") == 4, 3).when(F.col("group") == 8, -1).otherwise(F.col("n")))
    prior, _ = rounds.cold(before.select("group"), reads, summing(before)(reads), SCHEMA)
    assert rows(prior) == [(k, k + 1) for k in range(12)]
    now, history = rounds.warm(prior, reads, after.where("group in (4, 8)").select("group"), summing(after)(reads))
    assert rows(now) == rows(rounds.cold(after.select("group"), reads, summing(after)(reads), SCHEMA)[0])
    seen = {(r.group, r.round): r.changed for r in history.collect()}
    assert max(n for _, n in seen) >= 4 and {g for g, _ in seen} == {4, 5, 6, 7, 8, 9, 10, 11}
    # 8 took away what 4 gave: once it has run on the news the rest has nothing new to read
    assert seen[8, 5] and rows(now)[8:] == [(k, k + 1) for k in range(8, 12)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_run_from_nothing(spark, seed):
    """Groups that come, go, and change on a graph without circles; results that vanish."""
    rng = random.Random(seed)
    reads = spark.createDataFrame([(k, j) for k in range(1, 60) for j in rng.sample(range(k), min(k, rng.randrange(3)))], "group long, read long")
    old = {k: rng.randrange(-2, 9) for k in range(50)}
    new = {k: rng.randrange(-2, 9) if rng.random() < 0.1 else n for k, n in old.items() if k % 17 != 5} | {k: 4 for k in range(50, 60)}
    a, b = (spark.createDataFrame(sorted(d.items()), "group long, n long") for d in (old, new))
    prior, _ = rounds.cold(a.select("group"), reads, summing(a)(reads), SCHEMA)
    dirty = spark.createDataFrame([(k,) for k in range(60) if old.get(k) != new.get(k)], "group long")
    now, history = rounds.warm(prior, reads, dirty, summing(b)(reads))
    full, _ = rounds.cold(b.select("group"), reads, summing(b)(reads), SCHEMA)
    assert rows(now) == rows(full)
    assert history.select("group").distinct().count() < 60


def test_nothing_dirty_runs_nothing(spark):
    prior = spark.createDataFrame([(1, 2)], SCHEMA)
    none = spark.createDataFrame([], "group long")
    now, history = rounds.warm(prior, spark.createDataFrame([], "group long, read long"), none, lambda g, r: 1 / 0)
    assert rows(now) == [(1, 2)] and history.count() == 0


def test_circles(spark):
    """A circle that settles does; one that grows is found out."""
    reads = spark.createDataFrame([(1, 2), (2, 1)], "group long, read long")
    one = spark.createDataFrame([(1, 1), (2, 1)], "group long, n long")
    assert rows(rounds.cold(one.select("group"), reads, summing(one.withColumn("n", F.lit(25).cast("long")))(reads), SCHEMA)[0]) == [(1, 60), (2, 60)]

    def growing(groups, results):
        return groups.join(results, "group", "left").select("group", (F.coalesce("value", F.lit(0)) + 1).alias("value"))

    with pytest.raises(ValueError, match="circle"):
        rounds.cold(one.select("group"), reads, growing, SCHEMA, rounds=4)


def test_changed(spark):
    a = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (3, None), (4, 1), (4, 1)], SCHEMA)
    b = spark.createDataFrame([(1, 6), (1, 5), (2, 8), (3, None), (4, 1), (5, 1)], SCHEMA)
    assert Counter(r.group for r in rounds.changed(a, b).collect()) == {2: 1, 4: 1, 5: 1}


def test_what_a_round_joins_is_not_broadcast(spark, monkeypatch):
    plans, cut = [], rounds.cut
    monkeypatch.setattr(rounds, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    groups = spark.createDataFrame([(k,) for k in range(4)], "group long")
    reads = spark.createDataFrame([(1, 0), (2, 0)], "group long, read long")
    now, _ = rounds.cold(groups, reads, lambda g, _: g.withColumn("value", F.lit(1).cast("long")), SCHEMA)
    assert rows(now) == [(k, 1) for k in range(4)]
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
