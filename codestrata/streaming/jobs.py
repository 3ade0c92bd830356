"""Job progress, lease recovery, retry times, and incremental intake."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import seconds_between
from ..session import cut_lineage

STALE_SECONDS = 120


def latest_progress(events: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """Latest state per job; works on a stream in update mode."""
    return events.groupBy(key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("latest")).select(key, "latest.*")


def progress_changes(events: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """Only the events that differ from the one before, per job."""
    before = F.lag(F.struct(*value)).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | ~F.struct(*value).eqNullSafe(F.col("_before"))).drop("_before")


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    """What the sweep does with each job: launch, requeue, cancel, or nothing.

    jobs: id, status, heartbeat_at, next_attempt_at, cancel_requested.
    """
    waiting = F.coalesce(F.col("next_attempt_at") > now, F.lit(False))
    stale = F.coalesce(seconds_between(F.col("heartbeat_at"), now) > STALE_SECONDS, F.lit(True))
    live = F.col("status").isin("queued", "running") & ~waiting
    running, cancel = F.col("status") == "running", F.coalesce("cancel_requested", F.lit(False))
    action = (F.when(~live, "none").when(cancel & running & ~stale, "none").when(cancel, "cancel")
              .when(running & ~stale, "none").when(running, "requeue").otherwise("launch"))
    after = F.when(action == "cancel", "cancelled").when(action == "requeue", "queued").otherwise(F.col("status"))
    return jobs.withColumn("action", action).withColumn("status_after", after)


def retry_times(log: DataFrame, key: str) -> DataFrame:
    """When to try again after each failure: twice as long after each one in a row, at most five minutes, or as told.

    log: key, event_id, ts, failed, provider_delay (seconds, nullable).
    """
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    run = log.withColumn("_run", F.sum((~F.col("failed")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "_run").orderBy("ts", "event_id")
    attempt = F.row_number().over(inside) - F.when(F.col("_run") > 0, 2).otherwise(1)
    tried = run.withColumn("attempt", attempt).where("failed")
    base = F.least(F.lit(300.0), 60 * F.pow(F.lit(2.0), F.least("attempt", F.lit(10))))
    delay = F.greatest(base, F.coalesce("provider_delay", F.lit(0.0)))
    return tried.withColumn("delay_seconds", delay).withColumn("next_attempt_at", F.timestamp_add("SECOND", F.col("delay_seconds").cast("int"), F.col("ts"))).drop("_run")


def task_retry_delay(attempt: Column, rate_limited: Column, provider_delay: Column) -> Column:
    base = F.least(F.lit(240.0), F.when(rate_limited, 60).otherwise(10) * F.pow(F.lit(2.0), attempt))
    return F.greatest(base, F.coalesce(provider_delay, F.lit(0.0)))


def user_retry_allowed(now: Column, retry_at: Column) -> Column:
    ahead = seconds_between(now, retry_at)
    return (ahead > 0) & (ahead <= 2 * 86_400)


def arrival_windows(events: DataFrame, key: str) -> dict[str, DataFrame]:
    """Requests and tokens per tumbling minute, sliding minute and session of each key. events: key, ts, tokens."""
    sums = [F.count("*").alias("requests"), F.sum("tokens").alias("tokens")]
    spans = {"minute": F.window("ts", "1 minute"), "sliding": F.window("ts", "60 seconds", "10 seconds"), "session": F.session_window("ts", "30 minutes")}
    return {name: events.groupBy(key, span.alias("w")).agg(*sums).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "tokens")
            for name, span in spans.items()}


def watermarked(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream ready for windows: zone-free times become instants, rows later than the watermark are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work of a stage: inputs without output yet. A repeated run finds nothing to do."""
    return inputs.join(done.select(*keys), keys, "left_anti")


def incremental_intake(stream: DataFrame, stage, target: str, checkpoint: str, keys: tuple[str, ...] = ("analysis_id", "path")):
    """New members flow through ``stage`` into snapshot partitions. The rows of a snapshot may arrive over several batches.

    A batch is merged by ``keys`` with the partitions it touches, its rows before theirs, and these are replaced; a replay
    of a batch leaves the same rows.
    """
    def write(batch: DataFrame, _epoch: int) -> None:
        fresh = cut_lineage(stage(batch))
        session = batch.sparkSession
        if session._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(session._jsc.hadoopConfiguration()).exists(session._jvm.org.apache.hadoop.fs.Path(target)):
            touched = fresh.select("analysis_id").distinct()
            held = session.read.schema(fresh.schema).parquet(target).join(touched, "analysis_id", "left_semi")
            fresh = cut_lineage(fresh.unionByName(held.join(fresh.select(*keys), list(keys), "left_anti")))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(target)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
