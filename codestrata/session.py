"""Session helpers: a local session for tests and bench, and lineage cuts that survive executor loss."""
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "8m"             # a batch of texts is held by the executor and by its Python worker at once
ROWS_PER_TASK = 500_000


def local_session(app: str = "codestrata", cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch folder only in local mode."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="codestrata-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result as a table in the shared checkpoint folder and continue from it.

    It is computed once, survives the loss of executors, and its known size lets the planner choose the joins that follow.
    The shuffle files behind it are removed as soon as the table is whole: later steps read the table. Python tasks get
    batches of some BATCH_BYTES, however long the rows are.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/codestrata/{uuid.uuid4().hex}"
    before = {SHUFFLE_CLEANUP: spark.conf.get(SHUFFLE_CLEANUP, "false"), ARROW_BYTES: spark.conf.get(ARROW_BYTES)}
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    spark.conf.set(ARROW_BYTES, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tasks_by_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles that run inside get a task for every ``ROWS_PER_TASK`` of ``rows``.

    Adaptive execution merges tasks by compressed bytes, so rows that compress well would meet in ever larger tasks.
    """
    number = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    wanted = {"spark.sql.shuffle.partitions": str(number), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def release(written: DataFrame) -> None:
    """Delete a table that ``cut_lineage`` returned and that a later written table has superseded."""
    spark = written.sparkSession
    own = f"{checkpoint_folder(spark)}/codestrata/"
    folders = {f.rpartition("/")[0] for f in written.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(own).toUri().getPath()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
