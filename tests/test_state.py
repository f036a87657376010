"""Generations, manifests, trees, streams and plugins."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.plans import rules
from millrace.sources import frontend, state, trees
from millrace.streaming import watch

ROW = "key long, value string, dead boolean"


def run(spark, *rows):
    return spark.createDataFrame([(k, v, v is None) for k, v in rows], ROW)


def content(store, table="t"):
    found = store.table(table)
    return None if found is None else {r.key: r.value for r in found.collect()}


def test_generations(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/s")
    assert content(store) is None
    store.commit({"t": run(spark, *((k, f"v{k}") for k in range(30)))})
    store.commit({"t": run(spark, (1, "new"), (2, None))})
    assert content(store) == {k: f"v{k}" for k in range(30) if k not in (1, 2)} | {1: "new"}
    assert len(store.generation()["t"]) == 2 and store.get("t", 1).first().value == "new" and store.get("t", 2).count() == 0
    store.commit({"t": run(spark, *((k, "again") for k in range(40)))})
    assert len(store.generation()["t"]) == 1 and content(store) == {k: "again" for k in range(40)}
    assert store.collect_garbage() > 0
    assert content(store) == {k: "again" for k in range(40)} and store.collect_garbage() == 0


def test_many_small_runs_are_merged(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/s")
    store.commit({"t": run(spark, *((k, "v") for k in range(100)))})
    for k in range(state.MAX_RUNS):
        store.commit({"t": run(spark, (k, f"n{k}"))})
    assert len(store.generation()["t"]) == 1
    assert content(store) == {k: f"n{k}" if k < state.MAX_RUNS else "v" for k in range(100)}


def test_lock(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/s")
    assert store.lock("one") and not store.lock("two")
    store.unlock()
    assert store.lock("two")


def test_manifest_refuses_a_wrong_bucket(spark, tmp_path):
    m = spark.createDataFrame([("a/b", 1), ("c", 2)], "path string, n long")
    state.write_manifest(m, f"file://{tmp_path}/m")
    schema = "path string, n long, bucket string"
    assert sorted(map(tuple, state.read_manifest(spark, f"file://{tmp_path}/m", schema).collect())) == [("a/b", 1), ("c", 2)]
    m.withColumn("bucket", F.lit("zz")).write.partitionBy("bucket").json(f"file://{tmp_path}/w")
    with pytest.raises(Exception, match="wrong bucket"):
        state.read_manifest(spark, f"file://{tmp_path}/w", schema).collect()


def test_writes_only_what_differs(spark):
    staged = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, digest string")
    found = spark.createDataFrame([("a", "1", True), ("b", "x", True), ("c", "y", False)], "path string, digest string, own boolean")
    assert sorted(r.path for r in state.to_write(staged, found, owned="own").collect()) == ["b", "d"]
    assert sorted(r.path for r in state.to_write(staged, found, owned="own", overwrite=True).collect()) == ["b", "c", "d"]


def test_trees(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.go").write_text("one\ntwo\n")
    (tmp_path / "y.ts").write_text("x")
    files = trees.listing(spark, f"file://{tmp_path}").withColumn("rel", F.regexp_replace("path", rf"^file:/+{str(tmp_path).lstrip('/')}/", ""))
    assert {(r.rel, r.size) for r in files.collect()} == {("a/x.go", 8), ("y.ts", 1)}
    claimed = trees.claims(files, {"go": ["**/*.go"], "all": ["**", "!y.ts"]}, "rel")
    assert {r.rel: r.claimants for r in claimed.collect()} == {"a/x.go": ["go", "all"], "y.ts": []}
    frontend.register(spark)
    lines = spark.read.format("millrace_lines").option("paths", f"{tmp_path}/a/x.go").load()
    assert [(r.line, r.body) for r in lines.orderBy("line").collect()] == [(1, "one"), (2, "two")]


def test_unit_keys_follow_contents(spark):
    f = spark.createDataFrame([("u", "b", "2"), ("u", "a", "1"), ("v", "c", "3")], "unit string, path string, digest string")
    key = lambda d: {r.unit: r.unit_key for r in trees.units(d, ["unit"]).collect()}
    same, other = key(f.orderBy("path")), key(f.withColumn("digest", F.when(F.col("path") == "a", "9").otherwise(F.col("digest"))))
    assert same == key(f) and same["u"] != other["u"] and same["v"] == other["v"]


def test_report_changes_across_batches(spark, tmp_path):
    schema, out = "event_id long, user_id long, event_type string", f"file://{tmp_path}/out"
    batches = [[(1, 1, "a"), (2, 1, "a"), (3, 2, "b")], [(4, 1, "a"), (5, 1, "b"), (6, 2, "b")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        changed = watch.report_changes(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
        keep = lambda batch, n: batch.write.mode("append").parquet(out)
        changed.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 1, "a"), (1, 5, "b"), (2, 3, "b")]


def test_plugins_run_in_order(spark):
    symbols = spark.createDataFrame([(1, "Struct", "A"), (2, "Struct", "B"), (3, "Field", "C")], "subject long, kind string, name string")
    marks = spark.createDataFrame([(1, "mark", 0, False), (1, "mark", 1, True), (2, "mark", 0, False)], "subject long, name string, instance int, negated boolean")
    skips = spark.createDataFrame([(2, "first")], "subject long, plugin string")
    empty = spark.createDataFrame([], rules.CLAIMS)

    def first(frames):
        for f in frames:
            yield pd.DataFrame({"subject": f["subject"], "key": "seen", "value": f["name"], "authority": 0, "turn": 0, "plugin": "first", "ord": f["instance"]})

    def second(rows):
        return rows.select("subject", F.lit("marked").alias("key"), F.lit("x").alias("value"), F.lit(0).alias("authority"), F.lit(1).alias("turn"), F.lit("second").alias("plugin"), F.col("instance").cast("long").alias("ord"))

    one = rules.Plugin("first").handle(rules.on("Struct", first, rules.CLAIMS))
    two = rules.Plugin("second", requires=["first"]).handle(rules.where(rules.has_key("seen"), *rules.gated("mark", rules.on("Struct", second))))
    out = rules.run([two, one], symbols, empty, marks, skips)
    assert sorted((r.subject, r.key) for r in out.collect()) == [(1, "marked"), (1, "seen")]
    with pytest.raises(ValueError, match="require each other"):
        rules.run([rules.Plugin("a", requires=["b"]), rules.Plugin("b", requires=["a"])], symbols, empty, marks, skips)
    assert rules.selected_plans(["c"], {"c": ["a", "b"], "b": ["a"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="depend on each other"):
        rules.selected_plans(["a"], {"a": ["a"]})


def test_a_crash_before_publishing_keeps_the_old_generation(spark, tmp_path, monkeypatch):
    store = state.Store(spark, f"file://{tmp_path}/s")
    rows = lambda v: {"t": spark.createDataFrame([(1, v, False)], "key long, value string, dead boolean")}
    store.commit(rows("old"))
    write = store._write

    def fails(name, text):
        write(name, text[:1])  # half of it, then the end
        raise OSError

    monkeypatch.setattr(store, "_write", fails)
    with pytest.raises(OSError):
        store.commit(rows("new"))
    fresh = state.Store(spark, f"file://{tmp_path}/s")
    assert [r.value for r in fresh.table("t").collect()] == ["old"]
    fresh.commit(rows("newer"))
    assert [r.value for r in fresh.table("t").collect()] == ["newer"] and fresh.collect_garbage() > 0
    assert [r.value for r in fresh.table("t").collect()] == ["newer"]
