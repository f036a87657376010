"""Rules of many kinds in one pass, and rules over what rules emit."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.plans.rules import KINDS, Plugin, condition, dispatched, emits, emitting, gated, has_key, key_equals, lacks_key, on, staged, where

SCHEMA = "subject long, key string, value string"


@pytest.fixture
def world(spark):
    symbols = spark.createDataFrame([(k, KINDS[k % 13], f"n{k % 5}") for k in range(130)] + [(200, "other", "x"), (201, None, None)], "subject long, kind string, name string")
    holding = spark.createDataFrame([(k, "a", str(k % 2)) for k in range(0, 130, 3)] + [(1, "b", None)], "subject long, key string, value string")
    marks = spark.createDataFrame([(k, "m", j, j == 2) for k in range(0, 130, 7) for j in (1, 2, 3)], "subject long, name string, instance long, negated boolean")
    skips = spark.createDataFrame([(13, None), (26, "p0"), (26, None), (39, "p0")], "subject long, plugin string")
    return symbols, holding, marks, skips


def expressions(key, value="name"):
    return emits(F.col("subject"), F.lit(key).alias("key"), F.col(value).cast("string").alias("value"))


def frames(key, value="name"):
    def handler(batches):
        for b in batches:
            yield pd.DataFrame({"subject": b["subject"], "key": key, "value": b[value].astype(str)})

    return handler


@pytest.mark.parametrize("made", [expressions, frames])
def test_gates(spark, world, made):
    """All kinds of gates on several kinds, as Spark expressions and as functions over frames."""
    plugins = [
        Plugin("p0").handle(on("struct", made("all")), where(has_key("a"), on("enum", made("has")))),
        Plugin("p1").handle(where(key_equals("a", "1"), on("sum", made("equals"))), where(lacks_key("a"), on("field", made("lacks"))), where(condition(F.col("name") == "n1"), on("method", made("named")))),
        Plugin("p2").handle(gated("m", on("struct", made("marked", "instance"))), where(has_key("a"), *gated("m", on("alias", made("both", "instance"))))),
    ]
    out = dispatched(plugins, *world, SCHEMA)
    got = Counter(tuple(r) for r in out.select("plugin", *SCHEMA.replace(",", " ").split()[::2]).collect())
    kind = {k: KINDS[k % 13] for k in range(130)}
    facts = {k: str(k % 2) for k in range(0, 130, 3)}
    want = []
    for k in range(130):
        name = f"n{k % 5}"
        if kind[k] == "struct":
            want += [("p0", k, "all", name)] * (k not in (13, 26, 39)) + [("p2", k, "marked", str(j)) for j in (1, 3) if k % 7 == 0]
        want += [("p0", k, "has", name)] * (kind[k] == "enum" and k in facts)
        want += [("p1", k, "equals", name)] * (kind[k] == "sum" and facts.get(k) == "1")
        want += [("p1", k, "lacks", name)] * (kind[k] == "field" and k not in facts)
        want += [("p1", k, "named", name)] * (kind[k] == "method" and name == "n1")
        want += [("p2", k, "both", str(j)) for j in (1, 3) if kind[k] == "alias" and k in facts and k % 7 == 0]
    assert got == Counter(want)


def test_one_scan(spark, tmp_path, world):
    """Thirteen rules read the symbols once."""
    symbols, *rest = world
    symbols.write.parquet(f"{tmp_path}/symbols")
    plugins = [Plugin(f"p{k}").handle(on(kind, expressions(kind))) for k, kind in enumerate(KINDS)]
    out = dispatched(plugins, spark.read.parquet(f"{tmp_path}/symbols"), *rest, SCHEMA)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("subject#") and plan.count("parquet") == 1
    assert out.count() == 130 - 3


def test_both_sorts_of_handlers_and_no_rows(spark, world):
    plugins = [Plugin("p").handle(on("struct", expressions("e")), on("struct", frames("f")), on("enum", emits(F.col("subject"), F.lit("no").alias("key"), F.col("name").alias("value"), when=F.col("name") == "none")))]
    assert Counter(r.key for r in dispatched(plugins, *world, SCHEMA).collect()) == {"e": 8, "f": 8}
    assert dispatched(plugins, *[t.limit(0) for t in world], SCHEMA).count() == 0
    with pytest.raises(ValueError, match="kinds that do not exist"):
        dispatched([Plugin("q").handle(on("nothing", expressions("e")))], *world, SCHEMA)


EMITTED = "subject long, kind string, name string"


def made(kind, name):
    return emits(F.col("subject"), F.lit(kind).alias("kind"), F.concat("name", F.lit(name)).alias("name"))


def test_stages(world):
    """Two rules of the second stage match what two of the first have emitted, by the gates of the origin."""
    plugins = [
        Plugin("one").handle(emitting(["x"], on("struct", made("x", "1"))), emitting(["x", "y"], on("enum", made("y", "1")))),
        Plugin("two").handle(where(has_key("a"), *emitting(["z"], on("x", made("z", "2")))), emitting(["z"], on("y", made("z", "3")))),
        Plugin("three").handle(emitting(["w"], on("z", made("w", "4")))),
    ]
    out = Counter((r.stage, r.plugin, r.kind) for r in staged(plugins, *world, EMITTED).collect())
    held = sum(k % 3 == 0 and k not in (13, 26) for k in range(0, 130, 13))
    assert out == {(1, "one", "x"): 8, (1, "one", "y"): 10, (2, "two", "z"): held + 10, (3, "three", "w"): held + 10}


@pytest.mark.parametrize(
    ("steps", "why"),
    [([("x", "y"), ("y", "x")], "feed themselves: x -> y -> x"), ([("x", "x")], "feed themselves: x -> x"), ([("x", None)], "does not state"), ([(f"k{i}", f"k{i + 1}") for i in range(9)], "9 stages; 8")],
)
def test_stages_are_refused(world, steps, why):
    plugins = [Plugin(a).handle(on(a, made(b or "x", "")) if b is None else emitting([b], on(a, made(b, "")))) for a, b in steps]
    with pytest.raises(ValueError, match=why):
        staged(plugins, *world, EMITTED)
