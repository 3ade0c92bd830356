"""Ordered folds per key, streamed through the partition with bounded state.

A busy key is cut wherever its state is known to be empty: between two active days of the key when the silence is longer
than the state lives. The cut table has one row per key and day, so finding it needs no per-key sort of the events.
"""
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import epoch_millis, pacific_day, seconds_between


def with_segments(events: DataFrame, keys: list[str], silence_seconds: float) -> DataFrame:
    """events carry ts (zone-free UTC). Adds day and segment; folds of different segments are independent."""
    dated = events.withColumn("day", pacific_day(F.col("ts")))
    days = dated.groupBy(*keys, "day").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    by_day = Window.partitionBy(*keys).orderBy("day")
    quiet = F.coalesce(seconds_between(F.lag("last").over(by_day), F.col("first")) > silence_seconds, F.lit(True))
    cut = days.withColumn("fresh", quiet.cast("int")).withColumn("segment", F.sum("fresh").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    return dated.join(cut.select(*keys, "day", "segment"), [*keys, "day"])


def fold(events: DataFrame, keys: list[str], order: list[str], silence_seconds: float, new_state: Callable, step: Callable,
         id_column: str, result_schema: str) -> DataFrame:
    """Run ``step(state, row) -> tuple`` over each key's events in order. The result row is the id followed by the tuple."""
    ready = with_segments(events, keys, silence_seconds).withColumn("ms", epoch_millis(F.col("ts")))
    names = [f.strip().split(" ")[0] for f in result_schema.split(",")]

    def run(batches):
        current, state = None, None
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys) + (row.segment,)
                if key != current:
                    current, state = key, new_state()
                out.append((getattr(row, id_column), *step(state, row)))
            yield pd.DataFrame(out, columns=names)

    return ready.repartition(*keys, "segment").sortWithinPartitions(*keys, "segment", *order).mapInPandas(run, result_schema)
