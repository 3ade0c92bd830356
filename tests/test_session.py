"""Written intermediate tables: shuffle files go when the table is whole, superseded tables can be dropped."""
import glob
import os

import pyarrow as pa
from pyspark.sql import functions as F

from codestrata.session import ARROW_BYTES, SHUFFLE_CLEANUP, checkpoint_folder, cut_lineage, release


def test_written_table_is_whole_and_setting_is_restored(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    rows = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count()
    assert {(r["k"], r["count"]) for r in cut_lineage(rows).collect()} == {(k, 143 - (k == 6)) for k in range(7)}
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == before
    assert rows.count() == 7                       # the plan itself can run again


def test_release_drops_only_its_own_table(spark, tmp_path):
    first, second = cut_lineage(spark.range(3).toDF("a")), cut_lineage(spark.range(4).toDF("a"))
    folder = os.path.dirname(first.inputFiles()[0].removeprefix("file://"))
    release(first)
    assert not glob.glob(f"{folder}/*")
    assert second.count() == 4
    other = f"{tmp_path}/kept"
    spark.range(5).write.parquet(other)
    release(spark.read.parquet(other))
    assert spark.read.parquet(other).count() == 5
    assert checkpoint_folder(spark)


def test_python_tasks_of_a_written_table_get_bounded_batches(spark):
    before = spark.conf.get(ARROW_BYTES)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["size"])
    rows = spark.range(0, 40, 1, 1).select(F.expr("repeat('x', 1048576)").cast("binary").alias("text"))
    found = [r["size"] for r in cut_lineage(rows.mapInArrow(sizes, "size long")).collect()]
    assert sum(found) >= 40 << 20 and max(found) <= 10 << 20
    assert spark.conf.get(ARROW_BYTES) == before
