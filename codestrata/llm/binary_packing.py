"""Packing by power-of-two decomposition: no sequence crosses documents, and equal lengths share a bucket.

A document of n tokens is cut into as many pieces of ``capacity`` (a power of two) as fit and, for the rest, one piece for
each binary digit of it, longest first. Every piece is a sequence of its own whose length is a power of two, so nothing is
padded. Sequences are numbered bucket by bucket, longest first and without gaps, so that a trainer reads batches of equal
length as ranges of sequence_id.

Numbers need no shuffle of the pieces by length: each task counts its own pieces per bucket, and a piece's number is its
place in its task plus what the buckets and tasks before it hold. A length that a third of all pieces share is split by task.

Results for odd input: null text is an empty text, an empty text is one sequence that holds only the end id; null or
repeated doc_ids are packed like others, each row for itself; an empty table gives an empty result; columns besides doc_id
and text are not read. Very long texts are cut like others; a text is the unit of work.
"""
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage, utf8, utf8_slices
from codestrata.llm.pieces import piece_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
KINDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]


def binary_lengths(tokens: int, capacity: int) -> list[int]:
    """Whole sequences first, then the binary digits of what is left, longest first."""
    whole, rest = divmod(tokens, capacity)
    return [capacity] * whole + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Every piece of every document, numbered by bucket inside its task: ``_task`` and ``_nth``; ``ids`` as bytes if asked."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, words, end = TaskContext.get().partitionId(), piece_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        met: dict[int, int] = {}
        for some in utf8_slices(batches, 2 << 20):
            rows = []
            for doc_id, ids in zip(some.column(0).to_pylist(), words.encode(some.column(1).to_pylist()), strict=True):
                ids += end
                tokens, start = len(ids) // 4, 0
                for length in binary_lengths(tokens, capacity):
                    part, nth = ids[4 * start:4 * (start + length)], met.get(length, 0)
                    rows.append((doc_id, start, length, zlib.crc32(part), tokens, task, nth, *([part] if with_ids else [])))
                    met[length] = nth + 1
                    start += length
            kinds = [*KINDS, ("_task", pa.int32()), ("_nth", pa.int64()), *([("ids", pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             [name for name, _ in kinds])
    schema = PIECES + ", _task int, _nth long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame) -> DataFrame:
    """Number the sequences: buckets from long to short, inside a bucket by task; offset is always 0."""
    held = cut_lineage(pieces)
    # A row for each task and bucket; the numbers before it come from the totals of the buckets and of the tasks.
    counts = held.groupBy("length", "_task").agg(F.count("*").alias("_number"))
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)      # at most 64 rows
    buckets = counts.groupBy("length").agg(F.sum("_number").alias("_all"))
    buckets = buckets.select("length", F.coalesce(F.sum("_all").over(longer), F.lit(0)).alias("_bucket"))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.join(buckets, "length").select(
        "length", "_task", (F.col("_bucket") + F.coalesce(F.sum("_number").over(earlier), F.lit(0))).alias("_first"))
    return held.join(first, ["length", "_task"]).withColumn("sequence_id", F.col("_first") + F.col("_nth")) \
               .withColumn("offset", F.lit(0).cast("long")).drop("_first", "_nth", "_task")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its sequence."""
    return pack(pieces(docs, tokenizer, capacity, end_id))


def write_buckets(docs: DataFrame, tokenizer: str, folder: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Write the sequences themselves, ids as little-endian unsigned 32-bit bytes, a folder for each length; read them back."""
    found = pack(pieces(docs, tokenizer, capacity, end_id, with_ids=True))
    found.write.partitionBy("length").parquet(folder)
    return docs.sparkSession.read.parquet(folder).withColumn("length", F.col("length").cast("long"))
