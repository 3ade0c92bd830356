"""Staged intake: crashes between stages, late members, repeated batches."""
import os

import pytest
from pyspark.sql import functions as F

from codestrata.streaming import ledger

SCHEMA = "analysis_id string, path string, v int"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def double(rows):
    return rows.withColumn("twice", F.col("v") * 2)


def total(rows):
    return rows.where("twice >= 0").groupBy("analysis_id").agg(F.count("*").alias("files"), F.sum("twice").alias("twice"))


def run(spark, tmp_path, stages, checkpoint="state"):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = ledger.staged_intake(stream, stages, str(tmp_path / "out"), str(tmp_path / checkpoint))
    query.awaitTermination(120)
    if query.exception():
        raise query.exception()


def totals(spark, tmp_path):
    return {tuple(r) for r in ledger.current(spark, str(tmp_path / "out"), "totals").select("analysis_id", "files", "twice").collect()}


def versions(tmp_path, stage):
    return len([n for n in os.listdir(tmp_path / "out" / stage) if n.startswith("version=")])


def test_a_crash_between_stages_repeats_nothing(spark, tmp_path):
    add(spark, str(tmp_path / "in"), [("a", "p", 1), ("a", "q", 2), ("b", "p", 5), (None, "p", 7), ("gone", "p", -1)])

    def broken(rows):
        raise RuntimeError("lost")
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, [("doubled", double), ("totals", broken)])
    assert ledger.current(spark, str(tmp_path / "out"), "totals") is None
    run(spark, tmp_path, [("doubled", double), ("totals", total)])
    assert totals(spark, tmp_path) == {("a", 2, 6), ("b", 1, 10), (None, 1, 14)}
    assert (versions(tmp_path, "intake"), versions(tmp_path, "doubled"), versions(tmp_path, "totals")) == (1, 1, 1)
    run(spark, tmp_path, [("doubled", broken), ("totals", broken)])  # nothing is due, not even for the snapshot without totals


def test_late_members_rerun_their_snapshot_only(spark, tmp_path):
    stages, folder = [("doubled", double), ("totals", total)], str(tmp_path / "out")
    add(spark, str(tmp_path / "in"), [("a", "p", 1), ("b", "p", 5)])
    run(spark, tmp_path, stages)
    first = {r.analysis_id: r.version for r in ledger.newest(spark, folder, "totals").collect()}
    add(spark, str(tmp_path / "in"), [("a", "q", 2), ("a", "p", 3)])
    run(spark, tmp_path, stages)
    second = {r.analysis_id: r.version for r in ledger.newest(spark, folder, "totals").collect()}
    assert totals(spark, tmp_path) == {("a", 2, 10), ("b", 1, 10)} and first["b"] == second["b"] and first["a"] < second["a"]
    run(spark, tmp_path, stages, "another")  # the same files through another stream
    assert totals(spark, tmp_path) >= {("b", 1, 10)} and len(totals(spark, tmp_path)) == 2


def test_a_version_without_a_ledger_row_is_not_read(spark, tmp_path):
    add(spark, str(tmp_path / "in"), [("a", "p", 1)])
    run(spark, tmp_path, [("doubled", double), ("totals", total)])
    stray = str(tmp_path / "out" / "totals" / "version=v999999999999-dead")
    spark.createDataFrame([("a", 9, 9)], "analysis_id string, files long, twice long").write.parquet(stray)
    assert totals(spark, tmp_path) == {("a", 1, 2)}


def test_names_of_stages(spark, tmp_path):
    add(spark, str(tmp_path / "in"), [("a", "p", 1)])
    with pytest.raises(ValueError):
        run(spark, tmp_path, [("intake", double)])
