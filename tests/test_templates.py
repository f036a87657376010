"""Functions for SQL texts, and the one output of a plan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.templates import Templates
from millrace.operators import emitting


def test_kernel_functions(spark):
    Templates().register(spark)
    row = spark.sql(r"""select tpl_quote('a"\\b\nc') as q, tpl_indent('a\n\nb', 2) as i, tpl_comment('a\n\nb') as c, tpl_exported('élan') as e, tpl_params(array('x', 'y'), array('int', 'T')) as p, tpl_exported('') as n""").first()
    assert row.q == '"a\\"\\\\b\\nc"' and row.i == "\t\ta\n\n\t\tb" and row.c == "// a\n//\n// b" and row.e == "Élan" and row.p == "x int, y T" and row.n == ""
    assert [tuple(r) for r in spark.sql(r"select * from tpl_lines('a\n\nb') order by at").collect()] == [(1, "a"), (2, ""), (3, "b")]
    assert spark.sql("select tpl_quote(null) as q").first().q is None


def test_the_optimizer_sees_through_them(spark):
    Templates().register(spark)
    spark.createDataFrame([("abc", 1)], "s string, n int").createOrReplaceTempView("mr_names")
    plan = spark.sql("select tpl_exported(s) as e from mr_names where tpl_exported('x') = 'X'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and "upper(substring(" in plan  # the constant condition is gone, the body is in its place


def test_names_and_types_are_refused(spark):
    own = Templates()
    own.add("p", "tpl_mine", [("s", "string")], "string", "upper(s)")
    assert own.add("p", "tpl_mine", [("s", "string")], "string", "lower(s)").body == "lower(s)"
    with pytest.raises(ValueError, match="p's"):
        own.add("q", "tpl_mine", [], "string", "''")
    with pytest.raises(ValueError, match="kernel's"):
        own.add("q", "tpl_quote", [("s", "string")], "string", "s")
    with pytest.raises(ValueError, match="no name"):
        own.add("q", "x; drop", [], "string", "''")
    own.add("q", "tpl_wrong", [("s", "string")], "int", "array(s)")
    with pytest.raises(Exception, match="(?i)type|cast"):
        own.register(spark)


@pytest.mark.parametrize("parts", [1, 7])
def test_one_output_in_ranges(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(k, None if k % 11 == 0 else rng.choice("aéb") * rng.randrange(6)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, body string").repartition(parts)
    whole = "".join(b or "" for _, b in rows).encode()
    got = emitting.concatenated(df, ["k"], "body").collect()
    assert len(got) == 300 and all(whole[r.at : r.at + r["size"]] == (r.body or "").encode() for r in got)
    assert emitting.concatenated(df.limit(0), ["k"], "body").count() == 0
    descending = emitting.concatenated(df, [F.desc("k")], "body").where("k = 299").first()
    assert descending["at"] == 0
