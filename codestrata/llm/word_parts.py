"""The words of a chunked corpus, dealt by their hashes to parts: what is known of a word meets it in its part, once.

A chunk lists its words by ascending hash, so the words of a part are a run of that list. ``dealt`` has a row per part: its
distinct words, their counts, and for each chunk which of them the chunk's run holds. Values of words then go to the chunks as
one packed array per part and chunk, and what chunks count of their words comes back the same way; no row is made per word
and chunk. There are as many parts as chunks, so a part holds a bounded share of the words however large the corpus is.
"""
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage, giving_back

DEALT = "part int, words array<long>, c array<long>, chunks array<long>, places array<binary>"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: most high bytes are zero."""
    return zlib.compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), 1)


def unpacked(data, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def part_bounds(words: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's run begins in words sorted by their unsigned hash, and their number last."""
    part = (words.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def number_of_parts(corpus: DataFrame) -> int:
    return max(corpus.sparkSession.sparkContext.defaultParallelism, corpus.count())


def dealt(corpus: DataFrame) -> DataFrame:
    """A row per part, from rows of chunk, words (by ascending unsigned hash) and counts."""
    parts = number_of_parts(corpus)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, counts = (batch.column(i)[row].values.to_numpy() for i in (1, 2))
                bounds = part_bounds(words, parts)
                there = np.flatnonzero(np.diff(bounds))
                runs = [slice(bounds[p], bounds[p + 1]) for p in there]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([batch.column(0)[row].as_py()] * len(there), pa.int64()),
                                                  pa.array([words[r].tobytes() for r in runs], pa.binary()), pa.array([packed(counts[r]) for r in runs], pa.binary())],
                                                 ["part", "chunk", "words", "counts"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                runs = batch.column(1)[row].values
                lists = [np.frombuffer(w.as_buffer(), np.uint64) for w in runs.field("words")]
                words, place = np.unique(np.concatenate(lists), return_inverse=True)
                counts = np.concatenate([unpacked(c.as_buffer(), np.int64) for c in runs.field("counts")])
                total = np.bincount(place, counts, len(words)).astype(np.int64)
                places = [packed(np.diff(p, prepend=0).astype(np.uint32)) for p in np.split(place, np.cumsum([len(x) for x in lists])[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([words.view(np.int64)], pa.list_(pa.int64())), pa.array([total], pa.list_(pa.int64())),
                                                  pa.array([runs.field("chunk").to_numpy()], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.binary()))],
                                                 ["part", "words", "c", "chunks", "places"])
    runs = corpus.select("chunk", "words", "counts").mapInArrow(giving_back(split), "part int, chunk long, words binary, counts binary")
    gathered = runs.repartition(parts, "part").groupBy("part").agg(F.collect_list(F.struct("chunk", "words", "counts")).alias("runs"))
    return cut_lineage(gathered.mapInArrow(giving_back(join), DEALT))


def places_of(packed_places) -> np.ndarray:
    """Which of a part's words a chunk's run holds."""
    return np.cumsum(unpacked(packed_places, np.uint32).astype(np.int64))


def to_chunks(parts: DataFrame, kinds: DataFrame, counts: bool = False) -> DataFrame:
    """(chunk, own): for each part that the chunk has words of, their kinds and, with ``counts``, their counts in training.
    kinds: part, kinds (16 bits for each word of the part)."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunks, c = batch.column(1)[row].values, batch.column(4)[row].values.to_numpy() if counts else None
                kind = unpacked(batch.column(3)[row].as_buffer(), np.uint16)
                found = [places_of(p.as_buffer()) for p in batch.column(2)[row].values]
                yield pa.RecordBatch.from_arrays([chunks, pa.array([batch.column(0)[row].as_py()] * len(chunks), pa.int32()), pa.array([packed(kind[p]) for p in found], pa.binary()),
                                                  pa.array([packed(c[p]) if counts else None for p in found], pa.binary())], ["chunk", "part", "kinds", "c"])
    rows = parts.select("part", "chunks", "places", *["c"] * counts).join(kinds, "part").select("part", "chunks", "places", "kinds", *["c"] * counts)
    return rows.mapInArrow(giving_back(spread), "chunk long, part int, kinds binary, c binary").groupBy("chunk").agg(F.collect_list(F.struct("part", "kinds", "c")).alias("own"))
