"""Small helpers shared by the training-data operators."""
import os

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import checkpoint_folder, cut_lineage, release  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case and nothing else; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)


def utf8(name: str) -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def utf8_slices(batches, limit: int = 4 << 20):
    """From Arrow batches of (key..., bytes): lists of rows with some ``limit`` bytes of text together, whole texts only."""
    for batch in batches:
        sizes = batch.column(batch.num_columns - 1)
        rows, held = 0, 0
        for at in range(batch.num_rows):
            held += len(sizes[at].as_buffer() or b"")
            if held >= limit:
                yield batch.slice(rows, at + 1 - rows)
                rows, held = at + 1, 0
        if rows < batch.num_rows:
            yield batch.slice(rows)


def giving_back(task):
    """A task over batches that returns its freed memory to the system at its end; workers live on from stage to stage."""
    from functools import wraps

    @wraps(task)
    def run(batches):
        import ctypes

        import pyarrow
        try:
            yield from task(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
    return run


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared checkpoint folder, as a URI that pyarrow's file systems understand."""
    import uuid
    root = checkpoint_folder(spark)
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[5:]
    return f"{root}/codestrata/{purpose}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def new_file(folder: str, name: str):
    """Open a new file of this task attempt: (URI, stream). Attempts never share a name; a manifest says which files count."""
    import uuid
    uri = f"{folder}/{name}-{uuid.uuid4().hex}"
    system, path = file_system(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return uri, system.open_output_stream(path)
