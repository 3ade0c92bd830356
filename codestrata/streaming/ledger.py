"""Staged incremental intake: each stage's finished snapshots stand in a ledger, so a crash between stages repeats nothing.

Below one shared folder lie ``ledger`` and a folder per stage with a ``version=…`` folder per run. A run first writes its
rows as a version that nobody reads yet and then adds its snapshots to the ledger; readers take, for each snapshot, the rows
of the newest version in the ledger. A version without a ledger row (a run that died) is never read. If the run dies while
it adds its snapshots, those added are done, as their rows are whole, and the others are found again.

A ledger row says which version of the stage before it was the input. A stage is due for a snapshot when its input's newest
version is not in its own rows, so members that arrive later pass through all stages again, for their snapshots only.
"""
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import cut_lineage

LEDGER = "stage string, analysis_id string, version string, input string"
INTAKE = "intake"


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What is done: a row per stage, snapshot and version."""
    path = f"{folder}/ledger"
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def newest(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    """analysis_id, version: each snapshot's newest finished version of a stage. Versions sort by their number."""
    return ledger(spark, folder).where(F.col("stage") == stage).groupBy("analysis_id").agg(F.max("version").alias("version"))


def current(spark: SparkSession, folder: str, stage: str, wanted: DataFrame | None = None) -> DataFrame | None:
    """The rows of a stage's newest versions, of all snapshots or of those in ``wanted`` (analysis_id); None before its first run."""
    done = newest(spark, folder, stage)
    if wanted is not None:
        done = done.join(wanted.select("analysis_id"), _same(done, wanted, ["analysis_id"]), "left_semi")
    if done.isEmpty():
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(f"{folder}/{stage}")
    return rows.join(done, _same(rows, done, ["analysis_id", "version"]), "left_semi").drop("version")


def _finish(rows: DataFrame, stage: str, snapshots: DataFrame, folder: str) -> None:
    """snapshots: analysis_id, input. Rows are sorted by snapshot, so that a reader of few snapshots skips row groups."""
    spark = rows.sparkSession
    number = spark.read.schema(LEDGER).parquet(f"{folder}/ledger").agg(F.max(F.substring("version", 2, 12).cast("long"))).first()[0]
    version = f"v{(number or 0) + 1:012d}-{uuid.uuid4().hex}"
    rows.sortWithinPartitions("analysis_id").write.parquet(f"{folder}/{stage}/version={version}")
    snapshots.select(F.lit(stage).alias("stage"), "analysis_id", F.lit(version).alias("version"), "input").write.mode("append").parquet(f"{folder}/ledger")


def take_members(batch: DataFrame, arrival: str, folder: str, keys: tuple[str, ...]) -> None:
    """Merge a batch with the members its snapshots have: its rows replace those with equal keys (null equals null).

    ``arrival`` names the batch; what an arrival has already brought to a snapshot is not taken again. Rows of one batch
    stay as they are, also equal ones.
    """
    spark = batch.sparkSession
    seen = ledger(spark, folder).where((F.col("stage") == INTAKE) & (F.col("input") == arrival))
    fresh = cut_lineage(batch.join(seen, _same(batch, seen, ["analysis_id"]), "left_anti"))
    if fresh.isEmpty():
        return
    touched = fresh.select("analysis_id").distinct()
    held = current(spark, folder, INTAKE, touched)
    rows = fresh if held is None else fresh.unionByName(held.join(fresh, _same(held, fresh, list(keys)), "left_anti"), allowMissingColumns=True)
    _finish(rows, INTAKE, cut_lineage(touched.withColumn("input", F.lit(arrival))), folder)


def run_stage(spark: SparkSession, folder: str, name: str, before: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Run ``work`` over all snapshots whose newest version of ``before`` this stage has not had.

    work takes rows with analysis_id and returns rows with analysis_id; a snapshot for which it returns none is done as well.
    """
    inputs, done = newest(spark, folder, before).withColumnRenamed("version", "input"), ledger(spark, folder).where(F.col("stage") == name)
    due = cut_lineage(inputs.join(done, _same(inputs, done, ["analysis_id", "input"]), "left_anti"))
    if not due.isEmpty():
        _finish(work(current(spark, folder, before, due)), name, due, folder)


def staged_intake(stream: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], folder: str, checkpoint: str,
                  keys: tuple[str, ...] = ("analysis_id", "path")) -> StreamingQuery:
    """Members (analysis_id, the other keys and any more columns) flow through the stages; see ``current`` for the results.

    Streams may feed one folder in turn, but not at once. A batch is known by the checkpoint and its number: a repeated batch
    brings nothing new, and finds what the run before it left undone.
    """
    names = [INTAKE, *[name for name, _ in stages]]
    if len(set(names)) < len(names) or "ledger" in names:
        raise ValueError(f"stage names must differ from each other, {INTAKE!r} and 'ledger'")

    def batch(rows: DataFrame, number: int) -> None:
        take_members(rows, f"{checkpoint}#{number}", folder, keys)
        for before, (name, work) in zip(names, stages):
            run_stage(rows.sparkSession, folder, name, before, work)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
