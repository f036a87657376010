"""Operators on small tables: their rules, empty inputs, shuffled inputs."""

from __future__ import annotations

import os
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import changes, facts, gates, grouping, hierarchy, incremental, linking

CLAIM = "subject long, key string, value string, authority int, turn int, plugin string, ord int"


def best(claims):
    out = {}
    for c in claims:
        rank = (-c[3], c[4], c[5], c[6], c[2])
        if (c[0], c[1]) not in out or rank < out[c[0], c[1]][0]:
            out[c[0], c[1]] = (rank, c[2])
    return {k: v for k, (_, v) in out.items()}


claim = st.tuples(st.integers(0, 2), st.sampled_from("kl"), st.sampled_from("abcd"), st.integers(0, 2), st.integers(0, 2), st.sampled_from(["alpha", "beta"]), st.integers(0, 3))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(claim, max_size=32))
def test_arbitration_does_not_depend_on_order(spark, claims):
    for rows in (claims, claims[::-1], random.sample(claims, len(claims))):
        found = {(r.subject, r.key): r.value for r in facts.winners(spark.createDataFrame(rows, CLAIM)).collect()}
        assert found == best(claims)


def test_floor_does_not_fall_through(spark):
    c = spark.createDataFrame([(1, "k", "strong", 2, 0, "p", 0), (1, "k", "weak", 0, 0, "p", 0), (2, "k", "weak", 0, 0, "p", 0)], CLAIM)
    assert [(r.subject, r.value) for r in facts.winners_at_least(c, 1).collect()] == [(1, "strong")]


def test_admission_and_withdrawal(spark):
    c = spark.createDataFrame([(1, "k", "a", 0, 0, "p", 0), (1, "k", "b", 0, 0, "p", 0), (1, "k", "c", 0, 0, "q", 0), (1, "k", "c", 0, 0, "q", 0)], CLAIM)
    assert facts.conflicts(c).count() == 1
    assert [r.value for r in facts.admitted(c).collect()] == ["c"]
    gone = spark.createDataFrame([("p",)], "plugin string")
    assert [r.value for r in facts.winners(facts.withdrawn_sources(c, gone, ["plugin"])).collect()] == ["c"]


def test_tombstone_compares_the_whole_rank(spark):
    c = facts.winners(spark.createDataFrame([(1, "k", "a", 1, 2, "p", 0), (2, "k", "a", 1, 0, "p", 0), (3, "k", "a", 1, 1, "p", 0)], CLAIM))
    t = spark.createDataFrame([(s, 1, 1, "p", 0) for s in (1, 2, 3)], "subject long, authority int, turn int, plugin string, ord int")
    assert sorted(r.subject for r in facts.present(c, t).collect()) == [2, 3]


def test_facts_of_nothing(spark):
    empty = spark.createDataFrame([], CLAIM)
    assert facts.winners(empty).count() == facts.ranked(empty).count() == facts.cutoff(empty, empty).count() == 0


def test_skips(spark):
    m = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p"), (3, "p")], "subject long, plugin string")
    s = spark.createDataFrame([(1, "p"), (2, None)], "subject long, plugin string")
    assert sorted(map(tuple, gates.not_skipped(m, s).collect())) == [(1, "q"), (3, "p")]


@pytest.mark.parametrize(("pattern", "path", "inside"), [("a", "a", True), ("a", "a/b", False), ("a/...", "a/b", True), ("a/...", "ab", False), ("...", "x", True)])
def test_directory_patterns(spark, pattern, path, inside):
    assert spark.range(1).select(gates.in_directory(F.lit(path), pattern)).first()[0] is inside


def test_resolution_takes_the_first_tier(spark):
    refs = spark.createDataFrame([(1, ["a", "b"]), (2, ["x", "b"]), (3, ["x"]), (4, [])], "ref long, candidates array<string>")
    decls = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21)], "name string, id long")
    assert sorted(map(tuple, linking.resolved(refs, decls).collect())) == [(1, 10, False), (2, 20, True), (3, None, False), (4, None, False)]


def test_a_name_that_many_declare_is_one_row_of_the_join(spark):
    refs = spark.createDataFrame([(r, ["hot", "x"]) for r in range(50)], "ref long, candidates array<string>")
    decls = spark.createDataFrame([("hot", d) for d in range(50)] + [("x", None)], "name string, id long")
    found = linking.resolved(refs, decls)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[name#\d+\], \[name#\d+, min\(id", plan)
    assert set(map(tuple, found.select("target", "ambiguous").collect())) == {(0, True)}
    assert [tuple(r) for r in linking.resolved(refs.where("ref = 1").withColumn("candidates", F.array(F.lit("x"))), decls).collect()] == [(1, None, False)]


def test_clashes(spark):
    p = spark.createDataFrame([(x,) for x in ("a/b", "a/B", "c", "c/d", "e/f/g", "h")], "path string")
    assert dict(map(tuple, linking.clashes(p).collect())) == {"a/b": "case", "a/B": "case", "c": "directory", "c/d": "file", "e/f/g": "none", "h": "none"}


def test_longest_prefix_and_nearest_ancestor(spark):
    p = spark.createDataFrame([("a/b/c",), ("ab",), ("x",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",), ("ab/c",)], "root string")
    assert [tuple(r) for r in linking.longest_prefix(p, F.col("path"), roots).collect()] == [("a/b/c", "a/b")]
    marks = spark.createDataFrame([("a",), ("x",)], "dir string")
    assert dict(map(tuple, linking.nearest_ancestor(p, "path", marks).collect())) == {"a/b/c": "a", "ab": None, "x": "x"}


def test_unicode_paths_and_wildcards_are_text(spark):
    p = spark.createDataFrame([("a_/x",), ("ab/x",)], "path string")
    assert [tuple(r) for r in linking.longest_prefix(p, F.col("path"), spark.createDataFrame([("a_",)], "root string")).collect()] == [("a_/x", "a_")]


def test_compared_members(spark):
    m = spark.createDataFrame([(1, "get", "int"), (1, "put", "int"), (2, "get", "text")], "owner long, name string, sig string")
    w = spark.createDataFrame([("get", "int"), ("put", "text"), ("del", "int")], "name string, sig string")
    assert sorted(map(tuple, linking.compared(m, w).collect())) == [(1, 1, 1, 1), (2, 0, 1, 2)]


def test_directive_faults(spark):
    i = spark.createDataFrame([(1, "a", False), (1, "a", False), (2, "a", False), (2, "a", True), (3, "b", False), (4, "c", False), (4, "d", False), (5, "r", False), (5, "r", False)], "subject long, name string, negated boolean")
    found = sorted(map(tuple, grouping.validated(i, ["r"], [("b", "a")], [("c", "d")]).collect()))
    assert found == [(1, "duplicate", "a"), (2, "polarity", "a"), (3, "requires", "b"), (4, "conflicts", "c")]


def test_merged_index_equals_a_new_one(spark):
    old = spark.createDataFrame([(1, 10), (2, 10), (2, 20)], "edge long, record long")
    new = spark.createDataFrame([(3, 10), (2, 20)], "edge long, record long")
    touched = spark.createDataFrame([(10,)], "record long")
    assert sorted(map(tuple, grouping.merged_index(old, new.where("record = 10"), touched).collect())) == sorted(map(tuple, new.collect()))


NODE = "id long, parent long, name string, sig string"


def members(spark):
    nodes = spark.createDataFrame([(1, 0, "root", "s"), (2, 1, "a", "s"), (3, 1, "a", "t"), (4, 2, "b", "s"), (5, 2, "root", "s"), (6, 3, "c", "s")], NODE)
    return hierarchy.walked(nodes.where("id = 1"), nodes)


def test_shadowing(spark):
    m = members(spark)
    assert sorted((r.name, r.id) for r in hierarchy.promoted(m).collect()) == [("b", 4), ("c", 6), ("root", 1)]
    assert sorted((r.name, r.sig, r.id) for r in hierarchy.overridden(m).collect()) == [("a", "s", 2), ("a", "t", 3), ("b", "s", 4), ("c", "s", 6), ("root", "s", 1)]
    assert sorted((r.name, r.id) for r in hierarchy.merged(m).collect()) == [("a", 2), ("a", 3), ("b", 4), ("c", 6), ("root", 1)]


def test_a_cycle_ends(spark):
    nodes = spark.createDataFrame([(1, 2, "a", "s"), (2, 1, "b", "s")], NODE)
    assert hierarchy.walked(nodes.where("id = 1"), nodes).count() == 2
    links = spark.createDataFrame([(2, 1), (1, 9)], "id long, target long")
    assert sorted((r.id, r.reason) for r in hierarchy.gaps(hierarchy.walked(nodes.where("id = 1"), nodes), links, nodes).collect()) == [(1, "unresolved"), (2, "cyclic")]


def test_c3():
    bases = {"d": ["b", "c"], "b": ["a"], "c": ["a"]}
    assert hierarchy.linearised(bases, "d") == ["d", "b", "c", "a"]
    assert hierarchy.linearised({"x": ["a", "b"], "y": ["b", "a"], "z": ["x", "y"]}, "z") is None
    assert hierarchy.linearised({"a": ["b"], "b": ["a"]}, "a") is None


def test_topological():
    assert hierarchy.topological([1, 2, 3], {1: {3}}) == [2, 3, 1]
    assert hierarchy.topological([1, 2], {1: {2}, 2: {1}}) == [1, 2]


def test_diffs_keep_multiplicity(spark):
    lines = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "line long, text string")
    assert sorted(r.line for r in changes.lost_lines(lines, spark.createDataFrame([("y",)], "text string"), "text").collect()) == [1, 2, 4]


def test_diff_sees_nulls(spark):
    was = spark.createDataFrame([(1, None), (2, "a"), (3, "a")], "id long, v string")
    now = spark.createDataFrame([(1, None), (2, None), (4, "a")], "id long, v string")
    assert sorted(map(tuple, changes.generation_diff(was, now, ["id"], ["v"]).collect())) == [(2, "changed"), (3, "removed"), (4, "added")]


def test_first_free(spark):
    wanted = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["a"])], "id long, c array<string>")
    taken = spark.createDataFrame([(x,) for x in ("a", "a0", "b", "b0")], "name string")
    assert dict(map(tuple, changes.first_free(wanted, taken, F.col("c")).collect())) == {1: "b1", 2: "c", 3: "a1"}


def test_numbers_of_names_are_looked_up(spark):
    wanted = spark.createDataFrame([(1, ["a"]), (2, ["b1"]), (3, ["b"]), (4, ["full"]), (5, [None, "a"]), (None, ["a"])], "id long, c array<string>")
    names = ["a", "a00", "a1", "b1", "b", "b0", "b10", "b2", "full", *[f"full{k}" for k in range(64)]]
    found = changes.first_free(wanted, spark.createDataFrame([(n,) for n in names], "name string"), F.col("c"))
    assert dict(map(tuple, found.collect())) == {1: "a0", 2: "b11", 3: "b3", 5: None, None: "a0"}
    assert "posexplode(concat" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_reached(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "id long, next long")
    assert dict(map(tuple, incremental.reached(spark.createDataFrame([(1,)], "id long"), edges).collect())) == {1: 0, 2: 1, 3: 2}


def test_a_shared_edge_is_not_squared(spark):
    reads = spark.createDataFrame([(0, r) for r in range(3000)] + [(1, 7), (1, 5000), (2, 5000), (2, 5001), (3, 6000)], "edge long, record long")
    dirty = {r.record: r.hop for r in incremental.dirty_records(reads, spark.createDataFrame([(2,)], "edge long")).collect()}
    assert dirty[5000] == dirty[5001] == 0 and dirty[7] == 1 and dirty[8] == 2 and len(dirty) == 3002


def test_warm_equals_cold(spark):
    c = spark.createDataFrame([(s, "k", f"v{s}{a}", a, 0, "p", 0) for s in range(20) for a in range(3)], CLAIM)
    run = lambda rows: rows.where("authority < 2")
    rerun = c.where("subject % 3 = 0")
    warm, changed = incremental.warm_winners(c, c, rerun, run)
    cold = facts.winners(c.where("subject % 3 <> 0 or authority < 2"))
    assert sorted(map(tuple, warm.select("subject", "value").collect())) == sorted(map(tuple, cold.select("subject", "value").collect()))
    assert changed.count() == 7
    assert incremental.warm_winners(c, c, c.limit(0), run)[1].count() == 0


def order_brute(bases, node, path=()):
    """C3 by its definition, each base's order found anew."""
    if node in path:
        return None
    parts = [order_brute(bases, b, (*path, node)) for b in bases.get(node, ())]
    if None in parts:
        return None
    parts, out = [list(p) for p in (*parts, bases.get(node, ())) if p], [node]
    while parts:
        heads = [p[0] for p in parts if not any(p[0] in q[1:] for q in parts)]
        if not heads:
            return None
        out.append(heads[0])
        parts = [q for p in parts if (q := [x for x in p if x != heads[0]])]
    return out


def test_linear_orders_of_all_ancestors(spark):
    from millrace import catalog

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    got = {}
    for r in sorted(catalog.queries()["c3_orders"](spark, folder).collect(), key=lambda r: (r.root, r.at)):
        got.setdefault(r.root, []).append(r.owner)
    nodes = [r[0] for r in spark.read.parquet(f"{folder}/part.parquet").select("p_partkey").collect() if r[0] > 0]
    bases = {n: [b for b in dict.fromkeys((n // 2, n // 3)) if b > 0] for n in nodes}
    want = {n: order for n in nodes if bases[n] and (order := order_brute(bases, n))}
    assert got == want and len(got) > 10 and max(map(len, got.values())) > 5


def test_level_orders(spark):
    """Orders level by level equal those from the root down; circles, and what stands above them or above a clash, have none."""
    rng = random.Random(12)
    bases = {n: list(dict.fromkeys(rng.choice(range(max(1, n - 6), n)) for _ in range(rng.randrange(1, 3)))) for n in range(2, 40)} | {1: [], 50: [51], 51: [50], 52: [50, 3], 60: [1, 2], 61: [2, 1], 62: [60, 61], 63: [62]}
    edges = spark.createDataFrame([(n, b, k) for n, bs in bases.items() for k, b in enumerate(bs)] * 2, "node long, base long, pos long")
    got = {}
    for r in sorted(hierarchy.level_orders(spark.createDataFrame([(n,) for n in (1, 7, 70)], "node long"), edges).collect(), key=lambda r: (r.root, r.at)):
        got.setdefault(r.root, []).append(r.owner)
    want = {n: order for n in (*bases, 70) if (order := hierarchy.linearised(bases, n)) is not None}
    assert got == want and len(want) < len(bases) - 4 and want[70] == [70]
    assert hierarchy.level_orders(spark.createDataFrame([], "node long"), edges.limit(0)).count() == 0


def test_walk_joins_once_a_level(spark):
    """A walk and what uses it several times have no join of the walk left in their plans."""
    nodes = spark.createDataFrame([(k, k // 2, f"n{k % 3}", "s") for k in range(1, 60)], "id long, parent long, name string, sig string")
    walk = hierarchy.walked(nodes, nodes)
    assert walk._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert hierarchy.promoted(walk)._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3
    want = sum(1 for k in range(1, 60) for d in range(7) for j in range(1, 60) if j >> d == k)
    assert walk.count() == want


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8, 13, 21])
def test_seen_keeps_few_parts(spark, length):
    from millrace.operators import incremental

    seen = incremental.Seen(incremental.cut(spark.range(0, 1)))
    for k in range(1, length):
        seen.add(incremental.cut(spark.range(k, k + 1)))
    assert sorted(r.id for r in seen.rows().collect()) == list(range(length)) and len(seen._parts) <= 2 + length.bit_length()


def test_topological_orders(spark):
    rng = random.Random(4)
    units = {u: (list(range(rng.randrange(1, 9))), {(rng.randrange(9), rng.randrange(9)) for _ in range(5)}) for u in range(60)}
    items = spark.createDataFrame([(u, x, (x * 7) % 9) for u, (xs, _) in units.items() for x in xs], "unit long, item long, pos long")
    needs = spark.createDataFrame([(u, a, b) for u, (_, es) in units.items() for a, b in es], "unit long, item long, need long")
    got = {}
    for r in sorted(hierarchy.topological_orders(items, needs).collect(), key=lambda r: (r.unit, r.at)):
        got.setdefault(r.unit, []).append(r.item)
    for u, (xs, es) in units.items():
        given = sorted(xs, key=lambda x: ((x * 7) % 9, x))
        left, out, after = list(given), [], {x: {b for a, b in es if a == x and b in xs and b != x} for x in xs}
        while free := [x for x in left if not after[x] - set(out)]:
            out.append(free[0])
            left.remove(free[0])
        assert got[u] == (given if left else out)


def test_without_an_order_the_nearest_owner_counts(spark):
    members = spark.createDataFrame([(1, "m", 10, 1, 5), (1, "m", 11, 1, 4), (1, "m", 12, 2, 3), (2, "m", 20, 1, 9), (2, "m", 21, 1, 9), (2, "m", 22, 1, 8)], "root long, name string, id long, depth int, owner long")
    order = spark.createDataFrame([(1, 3, 0), (1, 4, 1), (1, 5, 2)], "root long, owner long, at int")
    assert {r.id for r in hierarchy.first_owner(members, order).collect()} == {12, 20, 21}


def test_closure_of_a_long_chain(spark):
    members = spark.createDataFrame([(k, f) for k in range(400) if k != 300 for f in (k, k + 1)], "group long, file long")
    found = incremental.closure_of_groups(spark.createDataFrame([(250,)], "group long"), members)
    assert {r.group for r in found.collect()} == set(range(300))


def test_levels_of_a_walk_are_not_broadcast(spark, monkeypatch):
    plans, cut = [], incremental.cut
    monkeypatch.setattr(incremental, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    nodes = spark.createDataFrame([(1, 0, "a", "s"), (2, 1, "b", "s"), (3, 2, "c", "s")], "id long, parent long, name string, sig string")
    assert hierarchy.walked(nodes, nodes).count() == 6
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)


def test_reexported(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(300)}
    rows = spark.createDataFrame([*pairs, (7, None), (None, 5)], "package long, exported long")
    wanted, level = {p: 0 for p in pairs}, pairs
    for hop in (1, 2):
        level = {(a, d) for a, b in level for c, d in pairs if b == c}
        for p in level:
            wanted.setdefault(p, hop)
    found = {(r.package, r.exported): r.hop for r in hierarchy.reexported(rows, 2).collect()}
    assert {k: v for k, v in found.items() if None not in k} == wanted and found[7, None] == found[None, 5] == 0


def test_reexports_meet_sets_not_pairs(spark, monkeypatch):
    rows, cut = [], incremental.cut
    monkeypatch.setattr(incremental, "cut", lambda df: (rows.append(df.count()), cut(df))[1])
    hub = spark.createDataFrame([(a, b) for a in range(64) for b in range(64)], "package long, exported long")
    assert hierarchy.reexported(hub.where("package <> exported"), 2).where("hop > 0").count() == 64
    assert max(rows[1:]) <= 64


def test_units_are_gathered_once(spark):
    items = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2), (2, 20, 1), (2, 21, 0), (None, 1, 0), (None, 2, 1)], "unit long, item long, pos int")
    needs = spark.createDataFrame([(1, 10, 12), (1, 10, 12), (3, 1, 2), (None, 1, 2)], "unit long, item long, need long")
    found = hierarchy.topological_orders(items, needs)
    assert " Join " not in found._jdf.queryExecution().optimizedPlan().toString().replace("\n", " ")
    orders = {}
    for r in sorted(found.collect(), key=lambda r: r.at):
        orders.setdefault(r.unit, []).append(r.item)
    assert orders == {1: [11, 12, 10], 2: [21, 20], None: [1, 2]}
