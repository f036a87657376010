"""Typed keys, fingerprints of compositions, and outputs that are checked before they are published."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.operators import facts
from millrace.plans.fingerprint import fingerprint, resumed
from millrace.plans.rules import Plugin, condition, emits, on, where
from millrace.sources.checked import ClaimsBroken, publish


def registry():
    r = keys.Registry()
    r.claim("n", "me")
    r.claim("other", "you")
    return r


@pytest.mark.parametrize(
    ("args", "why"),
    [
        (("me", "n.", "string", "d"), "no local part"), (("me", "n", "string", "d"), "no namespace"), (("me", "other.k", "string", "d"), "you's, not me's"), (("me", "free.k", "string", "d"), "None's"),
        (("me", "n.k", "map", "d"), "no type"), (("me", "n.k", "string", ""), "meaning"), (("me", "n.k", "bigint", "d", ("a",)), "only strings"), (("me", "n.k", "string", "d", ("a", "a")), "repeated"),
        (("me", "n.held", "bigint", "d"), "another type"), (("me", "n.g", "string", "d"), "share a name"), (("me", "n.k", "string", "d", (), "n.held"), "share a name"),
    ],
)
def test_registration_is_refused(args, why):
    r = registry()
    held = r.register("me", "n.held", "string", "d", group="n.g")
    assert r.register("me", "n.held", "string", "d", group="n.g") == held and r.group("n.g") == ["n.held"]
    with pytest.raises(ValueError, match=why):
        r.register(*args)
    with pytest.raises(ValueError, match="ended"):
        r.seal().register("me", "n.late", "string", "d")
    with pytest.raises(ValueError, match="ended"):
        r.claim("m", "me")


def test_six_types(spark):
    """Values of every type go in and come out as they were; another type is refused before a job runs, narrower numbers are widened."""
    r, day = registry(), datetime.datetime(2024, 1, 2, 3, 4, 5)
    values = {"boolean": False, "bigint": 7, "double": 0.5, "string": "", "timestamp": day, "array<string>": ["x", None]}
    known = {kind: r.register("me", f"n.k{k}", kind, "d") for k, kind in enumerate(values)}
    rows = spark.createDataFrame([(1, *values.values(), 3), (2, *[None] * 7)], "subject long, " + ", ".join(f"v{k} {kind}" for k, kind in enumerate(values)) + ", small int")
    claims = None
    for k, (kind, key) in enumerate(known.items()):
        own = keys.stamped(rows, key, F.col(f"v{k}"), "p")[0]
        claims = own if claims is None else claims.unionByName(own)
        for j, other in enumerate(values):
            if other != kind:
                with pytest.raises(TypeError, match=f"takes {kind}"):
                    keys.lifted(rows, key, F.col(f"v{j}"))
    won = facts.winners(claims)
    for kind, key in known.items():
        assert [(x.subject, x.value) for x in keys.read(won, key).collect()] == [(1, values[kind])]
        assert dict(keys.read(won, key).dtypes)["value"] == kind
    only = keys.table(won, list(known.values())).collect()
    assert len(only) == 1 and list(only[0])[1:] == list(values.values())
    assert keys.stamped(rows, known["bigint"], F.col("small"), "p")[0].select("value.l").collect()[0].l == 3
    weaker = keys.stamped(rows, known["double"], F.col("v2") + 1, "a", authority=-1)[0]
    assert [x.value for x in keys.read(facts.winners(claims.unionByName(weaker)), known["double"]).collect()] == [0.5]


def test_choices(spark):
    key = registry().register("me", "n.c", "string", "d", ("a", "b"))
    rows = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "subject long, v string")
    held, refused = keys.stamped(rows, key, F.col("v"), "p")
    assert [r.subject for r in held.collect()] == [1] and [tuple(r) for r in refused.collect()] == [(2, "n.c", "z")]


def composed(size=3, name="p", bonus=1, out="name"):
    def handler(batches):
        for b in batches:
            yield b.assign(value=b["size"] + bonus)

    return [Plugin(name).handle(where(condition(F.col("size") > size), on("struct", handler, "value long")), on("enum", emits(F.col("subject"), F.col(out))))]


def test_every_change_changes_the_fingerprint(spark):
    def known(kind="string", **more):
        r = registry()
        r.register("me", "n.k", kind, **({"doc": "d"} | more))
        return r

    table, wider = spark.createDataFrame([], "a long"), spark.createDataFrame([], "a long, b long")
    base = lambda **x: fingerprint(x.get("plugins", composed()), x.get("keys", known()), x.get("schemas", {"t": table}), x.get("settings", {"depth": 8}))
    assert base() == base()
    changes = [
        {"plugins": composed(4)}, {"plugins": composed(name="q")}, {"plugins": composed(bonus=2)}, {"plugins": composed(out="other")}, {"plugins": [Plugin("p", requires=["z"]), *composed(name="z")]}, {"plugins": []},
        {"keys": known("bigint")}, {"keys": known(doc="e")}, {"keys": known(choices=("a",))}, {"keys": known(group="n.g")}, {"schemas": {"t": wider}}, {"schemas": {"u": table}}, {"settings": {"depth": 9}},
    ]
    marks = [base(**c) for c in changes]
    assert len({base(), *marks}) == 1 + len(changes)
    two = [*composed(name="a"), *composed(name="b")]
    assert base(plugins=two) == base(plugins=two[::-1])


def test_a_change_makes_a_cold_run(spark, tmp_path):
    calls = []

    def cold():
        calls.append("cold")
        return spark.range(3)

    def warm(last):
        calls.append("warm")
        return last.union(spark.range(100, 101))

    one, was_warm = resumed(spark, f"file://{tmp_path}/r", "mark", cold, warm)
    assert one.count() == 3 and not was_warm
    two, was_warm = resumed(spark, f"file://{tmp_path}/r", "mark", cold, warm)
    assert two.count() == 4 and was_warm
    os.remove(f"{tmp_path}/r/mark/1/_SUCCESS")  # the second run broke off
    assert resumed(spark, f"file://{tmp_path}/r", "mark", cold, warm)[0].count() == 4
    assert not resumed(spark, f"file://{tmp_path}/r", "other", cold, warm)[1] and calls == ["cold", "warm", "warm", "cold"]


def test_a_fault_in_one_partition_is_not_published(spark, tmp_path):
    good, bad = spark.range(100).repartition(7), spark.range(100).withColumn("id", F.when(F.col("id") == 55, -1).when(F.col("id") != 56, F.col("id"))).repartition(7)
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    claims = {a: {"positive": F.col("id") >= 0}, b: {"positive": F.col("id") >= 0, "known": F.col("id").isNotNull()}}
    with pytest.raises(ClaimsBroken) as e:
        publish({a: good, b: bad}, claims)
    assert e.value.broken == {"positive": 2, "known": 1} and e.value.rows == 200 and os.listdir(tmp_path) == []
    with pytest.raises(ClaimsBroken, match="balanced"):
        publish({a: good, b: good.limit(3)}, {}, {"balanced": F.col(a) == F.col(b)})
    with pytest.raises(Exception, match="boom"):
        publish({a: good, b: good.select(F.assert_true(F.col("id") < 9, "boom"))}, claims)
    assert os.listdir(tmp_path) == []
    assert publish({a: good, b: good.limit(0)}, claims, {"more": F.col(a) > F.col(b)}) == {a: 100, b: 0}
    assert sorted(os.listdir(tmp_path)) == ["a", "b"] and spark.read.parquet(a).count() == 100
    with pytest.raises(FileExistsError):
        publish({a: good}, {})
    assert publish({}, {}) == {}
