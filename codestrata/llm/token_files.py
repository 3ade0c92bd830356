"""Token ids in fixed-width bit-packed files with random access.

A file holds blocks of ids, each id in as many bits as the vocabulary needs, lowest bit first; then a footer with the byte
offset of every block and, for every document, its doc_id and first id; then the footer's length. Any id range is read by
unpacking only its blocks, with numpy and no loop over ids. Documents lie in ascending doc_id order, in a file and over the
files (nulls first). Files are written by tasks into the shared folder under names of their own attempt; the manifest, a table that Spark
commits, says which files count, so a lost executor or a second attempt leaves no wrong file behind.

Results for odd input: null text is an empty text and yields the end id alone; rows with equal or null doc_ids are all
written, ties in order of their text; an empty table gives no file; columns besides doc_id and text are not read.
"""
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage, file_system, new_file, shared_folder, utf8, utf8_slices
from codestrata.llm.tokens import encoder

MAGIC = b"BITPACK1"
BLOCK_IDS = 1 << 16
READ_BLOCKS = 32


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(flags[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, number: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", number).astype("<u4")
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=number * bits, bitorder="little").reshape(number, bits)
    wide = np.zeros((number, 32), np.uint8)
    wide[:, :bits] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Appends documents to a binary stream."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.held, self.waiting = [], 0
        self.offsets, self.at = [], len(MAGIC)
        self.doc_ids, self.starts, self.total = [], [], 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.total)
        self.total += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            ids = np.concatenate(self.held)
            whole = len(ids) - len(ids) % BLOCK_IDS
            for at in range(0, whole, BLOCK_IDS):
                self._block(ids[at:at + BLOCK_IDS])
            self.held, self.waiting = [ids[whole:].copy()], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.offsets.append(self.at)
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.held))
        footer = io.BytesIO()
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        known = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        footer.write(np.array([self.bits, BLOCK_IDS, self.total, len(self.offsets), len(known)], "<u8").tobytes())
        for part in (np.array([*self.offsets, self.at], "<u8"), known, null, np.array([*self.starts, self.total], "<u8")):
            footer.write(part.tobytes())
        self.stream.write(footer.getvalue())
        self.stream.write(np.array([footer.tell()], "<u8").tobytes() + MAGIC)
        self.stream.close()


class Reader:
    """Reads id ranges of one file; keeps the last run of blocks it unpacked."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no complete file of this format")
        length = int(np.frombuffer(tail[:8], "<u8")[0])
        footer = self.file.read_at(length, size - 16 - length)
        self.bits, self.block, self.total, blocks, docs = (int(x) for x in np.frombuffer(footer[:40], "<u8"))
        at = 40
        self.offsets = np.frombuffer(footer, "<u8", blocks + 1, at)
        at += 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(footer, "<i8", docs, at)
        at += 8 * docs
        self.null = np.frombuffer(footer, np.uint8, docs, at).astype(bool)
        self.starts = np.frombuffer(footer, "<u8", docs + 1, at + docs)
        self.run, self.ids = (0, 0), np.zeros(0, "<u4")

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the file."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block + 1
        if not (self.run[0] <= first and last <= self.run[1]):
            last = max(last, min(first + READ_BLOCKS, len(self.offsets) - 1))
            number = min(self.total, last * self.block) - first * self.block
            begin, end = int(self.offsets[first]), int(self.offsets[last])
            data = self.file.read_at(end - begin, begin)
            per = self.block * self.bits // 8        # whole blocks end on a byte
            self.ids = np.concatenate([unpack_bits(data[i * per:(i + 1) * per], min(self.block, number - i * self.block), self.bits)
                                       for i in range(last - first)])
            self.run = (first, last)
        base = self.run[0] * self.block
        return self.ids[start - base:stop - base]


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write all documents in ascending doc_id order; one manifest row per file: shard, uri, first (ids before it), n_docs, n_tokens."""
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, out, uri = encoder(tokenizer), np.array([end_id], "<u4"), None, None
        for some in utf8_slices(batches, 2 << 20):
            if out is None:
                uri, stream = new_file(folder, f"ids-{TaskContext.get().partitionId():06d}")
                out = Writer(stream, width(max(words.vocabulary, end_id + 1)))
            for doc_id, ids in zip(some.column(0).to_pylist(), words.encode(some.column(1).to_pylist()), strict=True):
                out.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "uri": [uri],
                                              "n_docs": [len(out.doc_ids)], "n_tokens": [out.total]})
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).repartitionByRange("doc_id")
    written = cut_lineage(ordered.sortWithinPartitions("doc_id", "text").mapInArrow(
        shard, "shard long, uri string, n_docs long, n_tokens long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)      # a row per file
    return written.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    def documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, first in zip(frame["uri"], frame["first"], strict=True):
                file = Reader(uri)
                for some in range(0, len(file.doc_ids), 50_000):
                    edges = file.starts[some:some + 50_001].astype(np.int64)
                    sums = []
                    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        crc = 0
                        for at in range(start, stop, 16 * BLOCK_IDS):
                            crc = zlib.crc32(file.read(at, min(stop, at + 16 * BLOCK_IDS)).tobytes(), crc)
                        sums.append(crc)
                    ids = pd.array(file.doc_ids[some:some + 50_000], dtype="Int64")
                    ids[file.null[some:some + 50_000]] = pd.NA
                    yield pd.DataFrame({"doc_id": ids, "start": edges[:-1] + first, "n_tokens": np.diff(edges), "ids_crc32": sums})
    # A task for each file: the manifest is small, but each of its rows stands for a file.
    tasks = manifest.select("uri", "first").repartition(max(1, manifest.count()), "uri")
    return tasks.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    return read(write(docs, tokenizer, end_id, shared_folder(spark, "token-files")))
