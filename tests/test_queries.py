"""Every query with SQL against DuckDB on the same tables; the others for a stable result."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb
import pytest

from millrace import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[: -len('.parquet')]} as from '{path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return str(v)
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def rows(columns, found):
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns, wanted = sorted(df.columns), duck.sql(catalog.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    assert rows(columns, df.collect()) == rows(columns, [dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall()])
    types = dict(zip(wanted.columns, map(str, wanted.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == types


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_is_stable(spark, name):
    one, two = (catalog.queries()[name](spark, FOLDER) for _ in range(2))
    assert one.dtypes == two.dtypes
    columns = sorted(one.columns)
    first = rows(columns, one.collect())
    assert first and first == rows(columns, two.collect())


@pytest.mark.parametrize("partitions", ["1", "13"])
@pytest.mark.parametrize("name", ["claim_winner", "shadow_promote", "dirty_fixpoint", "accumulate", "first_tier"])
def test_partitions_do_not_matter(spark, name, partitions):
    columns = None
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in (before, partitions):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = catalog.queries()[name](spark, FOLDER)
        columns = columns or sorted(df.columns)
        found.append(rows(columns, df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
