"""Quota, rate and allowance gates."""
import math
from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.clock import epoch_millis, pacific_reset_seconds
from ..functions.ranking import top_per_group
from .clamps import running_clamp
from .folds import fold

WINDOW_MS = 60_000
QUOTA_FRACTION = 0.70


@dataclass(frozen=True)
class Limits:
    rpm: int = 70
    tpm: int = 21_000
    rpd: int = 700
    index_rpm: int = 60
    index_tpm: int = 18_000
    index_rpd: int = 675


def quota_limits(rows: DataFrame) -> DataFrame:
    """Effective limits from provider figures: rpm, tpm, rpd (nullable), daily_budget and the three query reserves."""
    share = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * QUOTA_FRACTION)).cast("long")
    less = lambda c, reserve: F.greatest(F.lit(1), F.col(c) - F.col(reserve)).cast("long")
    rows = rows.withColumn("limit_rpm", share("rpm")).withColumn("limit_tpm", share("tpm"))
    rows = rows.withColumn("limit_daily", F.when(F.col("rpd") > 0, F.least(F.col("daily_budget"), share("rpd"))).otherwise(F.col("daily_budget")).cast("long"))
    valid = (F.floor(F.col("rpm") * QUOTA_FRACTION) > F.col("rpm_reserve")) & (F.floor(F.col("tpm") * QUOTA_FRACTION) > F.col("tpm_reserve")) & (
        F.col("limit_daily") > F.col("daily_reserve"))
    return (rows.withColumn("index_rpm", less("limit_rpm", "rpm_reserve")).withColumn("index_tpm", less("limit_tpm", "tpm_reserve"))
            .withColumn("index_daily", less("limit_daily", "daily_reserve")).withColumn("valid", valid))


@dataclass
class QuotaState:
    log: deque = field(default_factory=deque)
    day: object = None
    day_count: int = 0
    day_index_count: int = 0


def quota_step(limits: Limits):
    """One admission decision. Rows have ms, day, requests, tokens, indexing, day_wait."""
    def step(state: QuotaState, row) -> tuple:
        indexing, now = bool(row.indexing), row.ms
        if row.requests > (limits.index_rpm if indexing else limits.rpm) or row.tokens > (limits.index_tpm if indexing else limits.tpm):
            return False, "too_large", None
        while state.log and state.log[0][0] <= now - WINDOW_MS:
            state.log.popleft()
        if state.day != row.day:
            state.day, state.day_count, state.day_index_count = row.day, 0, 0
        all_n, all_t = sum(e[1] for e in state.log), sum(e[2] for e in state.log)
        wait = lambda oldest: math.ceil(max(1000, oldest + WINDOW_MS + 1 - now) / 1000) if oldest is not None else 60
        if all_n + row.requests > limits.rpm or all_t + row.tokens > limits.tpm:
            return False, "minute", wait(state.log[0][0] if state.log else None)
        if indexing:
            mine = [e for e in state.log if e[3]]
            if sum(e[1] for e in mine) + row.requests > limits.index_rpm or sum(e[2] for e in mine) + row.tokens > limits.index_tpm:
                return False, "minute", wait(mine[0][0] if mine else None)
        if limits.rpd > 0 and state.day_count + row.requests > limits.rpd:
            return False, "day", int(row.day_wait)
        if indexing and limits.index_rpd > 0 and state.day_index_count + row.requests > limits.index_rpd:
            return False, "day", int(row.day_wait)
        state.log.append((now, int(row.requests), int(row.tokens), indexing))
        state.day_count += int(row.requests)
        state.day_index_count += int(row.requests) * indexing
        return True, "ok", 0
    return step


ADMISSION = "admitted boolean, reason string, wait_seconds long"


def admit(requests: DataFrame, keys: list[str], limits: Limits = Limits()) -> DataFrame:
    """Sliding-minute and Pacific-day admission. requests: keys, event_id, ts, requests, tokens, indexing."""
    ready = requests.withColumn("day_wait", pacific_reset_seconds(F.col("ts")))
    return fold(ready, keys, ["ms", "event_id"], 60, QuotaState, quota_step(limits), "event_id", "event_id long, " + ADMISSION)


def admit_stream(requests: DataFrame, key: str, limits: Limits = Limits()) -> DataFrame:
    """The same gate over a stream: the admitted log and the day counts are the key's state."""
    step = quota_step(limits)

    def run(name, batches, state: GroupState):
        kept = QuotaState()
        if state.exists:
            log, day, count, index_count = state.get
            kept = QuotaState(deque((e["ms"], e["n"], e["t"], e["i"]) for e in log), day, count, index_count)
        for rows in batches:
            out = [(r.event_id, *step(kept, r)) for r in rows.sort_values(["ms", "event_id"]).itertuples(index=False)]
            yield pd.DataFrame(out, columns=["event_id", "admitted", "reason", "wait_seconds"])
        state.update(([{"ms": e[0], "n": e[1], "t": e[2], "i": e[3]} for e in kept.log], kept.day, kept.day_count, kept.day_index_count))

    from ..functions.clock import pacific_day
    ready = (requests.withColumn("day_wait", pacific_reset_seconds(F.col("ts"))).withColumn("day", pacific_day(F.col("ts")).cast("string"))
             .withColumn("ms", epoch_millis(F.col("ts"))))
    return ready.groupBy(key).applyInPandasWithState(run, "event_id long, " + ADMISSION,
                                                     "log array<struct<ms:long,n:int,t:int,i:boolean>>, day string, n int, i int", "append", GroupStateTimeout.NoTimeout)


def reconcile(reservations: DataFrame, usage: DataFrame) -> DataFrame:
    """Reserved tokens replaced by the reported use plus a quarter; the time of the reservation stays."""
    revised = F.ceil(F.col("actual_tokens") * 1.25).cast("long")
    joined = reservations.join(usage.where("actual_tokens > 0").select("event_id", "actual_tokens"), "event_id", "left")
    return joined.withColumn("tokens", F.coalesce(revised, F.col("tokens"))).drop("actual_tokens")


def submissions(events: DataFrame, keys: list[str], limit: int = 2, window_seconds: int = 86_400) -> DataFrame:
    """A window opens with the first submission; ``limit`` fit into it, later ones are told how long it still runs."""
    def step(state: dict, row) -> tuple:
        if "start" not in state or row.ms >= state["start"] + window_seconds * 1000:
            state.update(start=row.ms, count=0)
        state["count"] += 1
        left = math.ceil((state["start"] + window_seconds * 1000 - row.ms) / 1000)
        return (True, 0) if state["count"] <= limit else (False, max(1, left))
    return fold(events, keys, ["ms", "event_id"], window_seconds, dict, step, "event_id", "event_id long, admitted boolean, wait_seconds long")


def rate_limit(events: DataFrame, keys: list[str], chat_limit: int = 30, other_limit: int = 12) -> DataFrame:
    """Sliding minute per client and path; only accepted requests count. events: keys, event_id, ts, is_chat."""
    def step(log: deque, row) -> tuple:
        while log and log[0] < row.ms - WINDOW_MS:
            log.popleft()
        if len(log) >= (chat_limit if row.is_chat else other_limit):
            return (False,)
        log.append(row.ms)
        return (True,)
    return fold(events, keys, ["ms", "event_id"], 60, deque, step, "event_id", "event_id long, admitted boolean")


def counted_allowance(events: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` uses of each key."""
    return top_per_group(events, keys, order, limit, "used")


def counted_allowance_with_refunds(events: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Uses and refunds in order: a use is granted below the limit, a refund never goes below zero.

    events: keys, event_id, ts, refund (null: a use). The counter is a clamp between 0 and the limit, so a key of any size
    is spread over tasks. Of a use and a refund that are equal in ts and event_id the refund comes first.
    """
    plain = events.select(*keys, "event_id", "ts", F.coalesce("refund", F.lit(False)).alias("refund"))
    counted = running_clamp(plain, keys, ["ts", "event_id"], F.when(F.col("refund"), -1).otherwise(1), 0, limit)
    return counted.select("event_id", (F.col("refund") | (F.col("before") < limit)).alias("granted"), F.col("after").alias("used"))
