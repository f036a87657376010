"""From matches to files: outputs, slots, references, rendering."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .incremental import cut


def appended(values: DataFrame, slot: Sequence[str], seq: Sequence[str], value: str) -> DataFrame:
    """Values of each slot with their place (from 1), in canonical order whatever order they came in."""
    return values.withColumn("at", F.row_number().over(Window.partitionBy(*slot).orderBy(*seq, value)))


def translated(refs: DataFrame, mapping: DataFrame, on: Sequence[str], spelling: str = "spelling") -> tuple[DataFrame, DataFrame]:
    """References with their spelling in the target, and those that the target cannot spell."""
    known = mapping.select(*on, spelling)
    return refs.join(known, list(on)), refs.join(known.select(*on), list(on), "left_anti")


def mirrored(methods: DataFrame, host: Column) -> DataFrame:
    """Methods copied to another host; abstract ones get a body of their own there."""
    return methods.withColumn("host", host).withColumn("mirrored", F.lit(True))


def unique_params(params: DataFrame, by: Sequence[str], name: str = "name", pos: str = "pos") -> DataFrame:
    """Parameters with names: an empty or repeated one becomes `p` and its position."""
    nth = F.row_number().over(Window.partitionBy(*by, name).orderBy(pos))
    fresh = (F.col(name) == "") | F.col(name).isNull() | (nth > 1)
    return params.withColumn("settled", F.when(fresh, F.concat(F.lit("p"), F.col(pos).cast("string"))).otherwise(F.col(name)))


def rendered(rows: DataFrame, unit: str, render: Callable[[list[dict]], str], order: Sequence[str]) -> DataFrame:
    """unit and body of each file. A file's rows are one group; render gets them in order."""
    kind = dict(rows.dtypes)[unit]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order), kind="stable")
        return pd.DataFrame({unit: [frame[unit].iloc[0]], "body": [render(frame.to_dict("records"))]})

    return rows.groupBy(unit).applyInPandas(one, f"{unit} {kind}, body string")


def per_group(rows: DataFrame, by: Sequence[str], handler: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A handler that gets a whole package at once; use an aggregation where one expresses it, since a group is held in one task."""
    return rows.groupBy(*by).applyInPandas(handler, schema)


def witnessed(params: DataFrame, constraints: DataFrame, on: str = "constraint", default: str = "string") -> DataFrame:
    """Type parameters with a concrete type: that of their constraint, else the default."""
    return params.join(constraints, on, "left").withColumn("witness", F.coalesce("witness", F.lit(default)))


def concatenated(rows: DataFrame, order: Sequence, body: str) -> DataFrame:
    """rows with at (byte at which each begins) and size, where all bodies stand one after the other in one order.

    No task has more than a range of the order: ranges are sorted and written down, their bytes are
    summed, and each range begins where those before it end. A null body takes no room. order settles the
    place of every row, up to rows that are equal in it.
    """
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long")
    ranged = cut(rows.orderBy(*order).withColumn("size", size).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    totals = ranged.groupBy(part.alias("_part")).agg(F.sum("size").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    begins = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inside = F.sum("size").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("_part", part).withColumn("_inside", F.coalesce(inside, F.lit(0))).join(begins, "_part")
    return placed.withColumn("at", F.col("_begin") + F.col("_inside")).drop("_part", "_row", "_begin", "_inside")

