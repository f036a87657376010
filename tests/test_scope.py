"""A source that reads the packages in scope alone."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import gates
from millrace.sources import frontend


@pytest.fixture
def files(spark, tmp_path):
    found = {}
    for p in ("a", "b", "b/inner", "bc", "c"):
        for k in range(2):
            path = tmp_path / f"{p.replace('/', '-')}{k}.txt"
            path.write_text(f"{p} {k}\nsecond\n")
            found.setdefault(p, []).append(str(path))
    found["lost"] = [str(tmp_path / "nowhere.txt")]  # fails where it is opened
    frontend.register(spark)
    return found


@pytest.mark.parametrize(
    ("scope", "seen"),
    [(["a"], {"a"}), (["a", "c"], {"a", "c"}), (["b/..."], {"b", "b/inner"}), (["b"], {"b"}), (["b/...", "b/inner"], {"b", "b/inner"}), (["z"], set()), ([], set()), (["b..."], set())],
)
def test_unseen_packages_are_no_partitions(spark, files, scope, seen):
    rows = spark.read.format("millrace_packages").option("files", json.dumps(files)).option("scope", json.dumps(scope)).load()
    assert rows.rdd.getNumPartitions() == max(1, 2 * len(seen))
    assert {r.package for r in rows.select("package").collect()} == seen and rows.count() == 4 * len(seen)
    assert rows.where("package = 'b' and line = 1").count() == 2 * ("b" in seen) and rows.where("line = 1").count() == 2 * len(seen)


def test_the_rule_is_that_of_the_column(spark, files):
    patterns = ["...", "a", "b/...", "b", "b...", "c/..."]
    names = spark.createDataFrame([(p,) for p in files], "p string")
    for pattern in patterns:
        assert {r.p for r in names.where(gates.in_directory(F.col("p"), pattern)).collect()} == {p for p in files if frontend.covers(pattern, p)}, pattern


def test_everything_is_seen_without_a_scope(spark, files):
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("millrace_packages").option("files", json.dumps(files)).load().collect()
