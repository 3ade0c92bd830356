"""Running counters with a floor and a ceiling, as a parallel scan of clamp functions.

An event moves a counter by ``step`` and keeps it within ``low`` and ``high``: x -> min(high, max(low, x + step)). Two such
functions in a row are one of the same form, so a stretch of events is three numbers whatever its length, and stretches of
one key can be handled by different tasks.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# Wide enough to leave a counter as it is, far from the ends of a 64-bit number.
OPEN = 1 << 60


def then(first: tuple, second: tuple) -> tuple:
    """The clamp function that applies ``first`` and then ``second``; each is (step, low, high), numbers or arrays."""
    step, low, high = second
    within = lambda x: np.minimum(high, np.maximum(low, x))
    return np.clip(first[0] + step, -OPEN, OPEN), within(first[1] + step), within(first[2] + step)


def composed(steps: np.ndarray, low: int, high: int, starts: np.ndarray) -> tuple:
    """For each event the function of all events from its run's start to it. starts: where each event's run starts."""
    total = (steps.astype(np.int64), np.full(len(steps), low, np.int64), np.full(len(steps), high, np.int64))
    place, reach = np.arange(len(steps)), 1
    while len(steps) and reach <= int((place - starts).max()):
        later = np.flatnonzero(place - starts >= reach)
        joined = then(tuple(part[later - reach] for part in total), tuple(part[later] for part in total))
        total = tuple(part.copy() for part in total)
        for part, new in zip(total, joined):
            part[later] = new
        reach *= 2
    return total


def running_clamp(events: DataFrame, keys: list[str], order: list[str], step: Column, low: int, high: int) -> DataFrame:
    """Add ``before`` and ``after``: each key's counter around each event. A counter starts at 0; a null step moves nothing.

    Events are sorted over all tasks by key and order (nulls first; events that are equal in both are taken by step, the
    smallest first), so a busy key lies in as many tasks as it fills. Each task writes, once, the function of what the key
    did before each event in that task. Only the first key of a task can have started in an earlier one, so the starting
    values that are joined back are at most as many as there are tasks. Needs low <= 0 <= high.
    """
    if not low <= 0 <= high:
        raise ValueError("a counter starts at 0, which must lie between low and high")
    moves = events.select(*events.columns, F.coalesce(step.cast("long"), F.lit(0)).alias("_step"))
    spread = moves.repartitionByRange(*keys, *order, "_step").sortWithinPartitions(*keys, *order, "_step")
    added = ["_block", "_place", "_c", "_low", "_high"]
    schema = T.StructType([*moves.schema.fields, *[T.StructField(n, T.LongType()) for n in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, held, entry = TaskContext.get().partitionId(), 0, None, (0, -OPEN, OPEN)
        for rows in batches:
            if not rows.num_rows:
                continue
            at = np.arange(rows.num_rows)
            first = at == 0
            for key in keys:
                codes = rows.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
                first[1:] |= codes[1:] != codes[:-1]
            starts = np.maximum.accumulate(np.where(first, at, 0))
            label = lambda i: repr([rows.column(k)[i].as_py() for k in keys])  # noqa: E731,B023
            if held != label(0):
                entry = (0, -OPEN, OPEN)
            inclusive = composed(rows.column("_step").to_numpy(), low, high, starts)
            carried = starts == 0
            for part, new in zip(inclusive, then(entry, tuple(p[carried] for p in inclusive))):
                part[carried] = new
            outside = [np.where(first, empty, np.roll(part, 1)) for part, empty in zip(inclusive, (0, -OPEN, OPEN))]
            for part, value in zip(outside, entry):
                part[0] = value
            held, entry = label(rows.num_rows - 1), tuple(int(part[-1]) for part in inclusive)
            yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, [np.full(rows.num_rows, block), place + at, *outside])], names=[*rows.schema.names, *added])
            place += rows.num_rows

    known = cut_lineage(spread.mapInArrow(run, schema))
    clamp = lambda x, lo, hi: F.least(hi, F.greatest(lo, x))
    lows, highs = F.lit(low).cast("long"), F.lit(high).cast("long")
    last = F.max_by(F.struct((F.col("_c") + F.col("_step")).alias("c"), clamp(F.col("_low") + F.col("_step"), lows, highs).alias("lo"),
                             clamp(F.col("_high") + F.col("_step"), lows, highs).alias("hi")), "_place").alias("f")
    parts = known.groupBy(*keys, "_block").agg(last).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_block", "f"))).alias("parts"))
    zero = F.lit(0).cast("long")
    values = F.aggregate("parts", F.array(zero), lambda seen, p: F.concat(seen, F.array(clamp(F.element_at(seen, -1) + p.f.c, p.f.lo, p.f.hi))))
    entered = (parts.where(F.size("parts") > 1).select(*keys, F.posexplode("parts").alias("at", "p"), values.alias("values"))
               .where("at > 0").select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("p._block").alias("_in"), F.col("values")[F.col("at")].alias("_start")))
    same = F.col("_block") == F.col("_in")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_key_{key}"))
    before = clamp(F.coalesce("_start", zero) + F.col("_c"), F.col("_low"), F.col("_high"))
    return (known.join(F.broadcast(entered), same, "left").withColumn("before", before)
            .withColumn("after", clamp(F.col("before") + F.col("_step"), lows, highs)).select(*events.columns, "before", "after"))
