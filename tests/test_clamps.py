"""Counters with a floor and a ceiling against a plain loop."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.streaming import admission
from codestrata.streaming.clamps import composed, running_clamp

START = dt.datetime(2024, 1, 1)


def plain(rows, low, high):
    """rows: (key, event_id, ms, step). A counter per key, over ms, event_id, step with nulls first."""
    state, out = {}, []
    first = lambda v: (v is not None, v if v is not None else 0)
    for key, event, ms, step in sorted(rows, key=lambda r: (first(r[2]), first(r[1]), r[3] or 0)):
        before = state.get(key, 0)
        state[key] = min(high, max(low, before + (step or 0)))
        out.append((key, event, ms, step, before, state[key]))
    return out


def test_composition_equals_the_loop():
    rng = random.Random(3)
    for size in (1, 2, 7, 100, 1000):
        steps = np.array([rng.randint(-3, 3) for _ in range(size)])
        starts = np.zeros(size, np.int64)
        cut = size // 3
        starts[cut:] = cut
        c, low, high = composed(steps, -2, 4, starts)
        for begin, end in ((0, cut), (cut, size)):
            for start in (-2, 0, 4):
                x = start
                for i in range(begin, end):
                    x = min(4, max(-2, x + int(steps[i])))
                    assert x == min(high[i], max(low[i], start + c[i]))


@pytest.mark.parametrize("seed", [1, 2])
def test_a_busy_key_over_many_tasks(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([i, i // 2, None]) if rng.random() < 0.1 else i, rng.randint(0, 900), rng.choice([1, 1, 1, -1, -2, None])) for i in range(3000)]
    rows += rows[:20]
    held = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    for name, value in zip(held, ("false", "37", "11")):
        spark.conf.set(name, value)
    try:
        table = spark.createDataFrame(rows, "key string, event_id long, ms long, step long")
        got = running_clamp(table, ["key"], ["ms", "event_id"], F.col("step"), 0, 3)
        assert got.columns == ["key", "event_id", "ms", "step", "before", "after"]
        found = [tuple(r) for r in got.collect()]
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
    order = lambda r: tuple((v is not None, v if v is not None else 0) if i else str(v) for i, v in enumerate(r))
    assert sorted(found, key=order) == sorted(plain(rows, 0, 3), key=order)


def test_refunds(spark):
    rng = random.Random(5)
    rows = [(i, START + dt.timedelta(seconds=rng.randint(0, 500)), "hot" if i % 3 else f"u{i % 7}", rng.choice([True, False, False, None])) for i in range(1200)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user string, refund boolean")
    got = {r.event_id: (r.granted, r.used) for r in admission.counted_allowance_with_refunds(table, ["user"], 5).collect()}
    used, want = {}, {}
    for event, _, user, refund in sorted(rows, key=lambda r: (r[1], r[0])):
        now = used.get(user, 0)
        granted = bool(refund) or now < 5
        used[user] = max(0, now - 1) if refund else now + granted
        want[event] = (granted, used[user])
    assert got == want and any(not g for g, _ in got.values())


def test_wide_ids_beside_nulls(spark):
    wide = 2**62 + 1
    table = spark.createDataFrame([(wide, 1, 1), (wide + 1, 1, 1), (None, 2, 1), (wide, 3, 1)], "key long, ms long, step long")
    got = sorted((str(r.key), r.ms, r.after) for r in running_clamp(table, ["key"], ["ms"], F.col("step"), 0, 9).collect())
    assert got == sorted([(str(wide), 1, 1), (str(wide + 1), 1, 1), ("None", 2, 1), (str(wide), 3, 2)])


def test_no_events(spark):
    empty = spark.createDataFrame([], "event_id long, ts timestamp_ntz, user string, refund boolean")
    assert admission.counted_allowance_with_refunds(empty, ["user"], 5).count() == 0
    with pytest.raises(ValueError):
        running_clamp(empty, ["user"], ["ts"], F.lit(1), 1, 5)
