"""Watching for changes: Structured Streaming around the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changed_only(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is not that of the row before, within each group: the batch form of report_changes."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def report_changes(stream: DataFrame, key: str = "user_id", order: str = "event_id", value: str = "event_type") -> DataFrame:
    """A stream of the rows whose value differs from the last one reported for the key. The state is one value a key.

    Rows are taken in order within a micro-batch; what comes in a later batch counts as later.
    """

    def step(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        last = state.get[0] if state.exists else None
        before = rows[value].shift(1)
        before.iloc[0] = last
        out = rows[rows[value] != before]
        state.update((rows[value].iloc[-1],))
        yield pd.DataFrame({"key": [key_[0]] * len(out), "id": out[order].to_numpy(), "value": out[value].to_numpy()})

    return stream.groupBy(key).applyInPandasWithState(step, "key long, id long, value string", "last string", "append", GroupStateTimeout.NoTimeout)


def watch(spark: SparkSession, source: str, schema, run: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Call run with every new batch of Parquet files in source: all that are there and stop, or with an interval go on polling."""
    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def tee(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch to several sinks; it is computed once."""

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, number)
        finally:
            held.unpersist()

    return run
