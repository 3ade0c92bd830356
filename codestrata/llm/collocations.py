"""Phrases whose words stand together more often than their parts lead one to expect, for each language.

Every place where a word begins is a suffix: that word and the words after it in its piece of text, to a maximum depth.
Tasks hold suffixes as pointers into arrays of word codes and sort them by multikey three-way quicksort, one word at a time;
a partition of equal words is a phrase and its size is the phrase's count.

First each task sorts the suffixes of a slice of text, so that every phrase of the slice is one entry with its count, however
often it occurs; this is all that a common phrase ever sends. Entries are routed by the hash of language and words, in blocks
of compressed lines, one for each route. A route's task codes the entries of all slices and sorts them again; a partition
whose counts together stay under the least count is abandoned at once, whatever words would still have told it apart.
What is left, phrases and words with at least the least count, is a table that ordinary joins turn into scores.

Results for odd input: null and empty texts have no words, a null language is ``und``, rows count as often as they stand in
the table, an empty table gives an empty result, and only text and lang are read. Very long texts are cut where a piece of
text ends; a single piece is the unit of work.
"""
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.ranking import top_per_group
from codestrata.llm.common import cut_lineage, utf8
from codestrata.llm.shingles import FACTORS, mixed

SLICE = 8 << 20                  # bytes of text sorted together
ROUTE_BYTES, LEAST_ROUTES = 2 << 20, 96      # text that a route stands for, routes at least
SMALL = 1 << 15                  # pointers that are sorted at once instead of being parted further
UPPER_BYTES = {b: b + 32 for b in range(65, 91)}
ENDS = b".,;:!?\n\x0b\x0c\r"     # what parts pieces; tab and space part words
TEXT_BYTES = bytes(46 if b in ENDS else 32 if b in b" \t" else UPPER_BYTES.get(b, b) for b in range(256))
END = re.compile(rb"[.,;:!?\x0A-\x0D]")


def equal_partitions(columns: list[np.ndarray], weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of pointers into ``columns`` (codes of the first, second, ... word).

    Returns a pointer to each distinct key whose weights sum to at least ``least``, in key order, and the sums. A partition
    whose weights sum to less is abandoned. Small partitions are finished by one sort over the columns not yet equal.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = [(np.arange(len(weights), dtype=np.int32), 0)]
    while waiting:
        pointers, depth = waiting.pop()
        if weights[pointers].sum() < least or not len(pointers):
            continue
        if depth == len(columns):
            found.append((pointers[:1], weights[pointers].sum(keepdims=True)))
        elif len(pointers) <= SMALL:
            order = pointers[np.lexsort([c[pointers] for c in columns[depth:][::-1]])]
            new = np.zeros(len(order), bool)
            new[0] = True
            for c in columns[depth:]:
                new[1:] |= np.diff(c[order]) != 0
            first = np.flatnonzero(new)
            sums = np.add.reduceat(weights[order], first)
            enough = sums >= least
            found.append((order[first[enough]], sums[enough]))
        else:
            keys = columns[depth][pointers]
            some = np.sort(keys[::max(1, len(keys) // 63)])
            pivot = some[len(some) // 2]
            # Last in, first out: the lower partition is taken up first, so partitions come out in key order.
            waiting.append((pointers[keys > pivot], depth))
            waiting.append((pointers[keys == pivot], depth + 1))
            waiting.append((pointers[keys < pivot], depth))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([s for _, s in found])


def coded_words(text: bytes, separators: tuple[int, ...]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes from 1 of the words between separators, the words in byte order, and where each word starts in the text."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.ones(len(raw) + 2, bool)
    inside[[0, -1]] = False
    for s in separators:
        inside[1:-1] &= raw != s
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2]).astype(np.int32)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(inside[1:-1] & ~inside[2:]).astype(np.int32) + 1 - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside[1:-1]].tobytes())])
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    codes = np.empty(len(order) + 1, np.int32)
    codes[order.to_numpy()] = np.arange(1, len(order) + 1)
    return codes[coded.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int32), coded.dictionary.take(order), starts


def suffixes(text: bytes, depth: int) -> tuple[list[np.ndarray], pa.Array]:
    """Word codes at each suffix's first, second, ... place (0 beyond the end of its piece), and the words."""
    text = text.translate(TEXT_BYTES)
    codes, words, starts = coded_words(text, (32, 46))
    piece = np.cumsum(np.frombuffer(text, np.uint8) == 46, dtype=np.int32)[starts] if len(starts) else starts
    columns = [codes]
    for k in range(1, depth):
        column = np.zeros_like(codes)
        column[:-k] = np.where(piece[:-k] == piece[k:], codes[k:], 0)
        columns.append(column)
    return columns, words


def phrases_of(text: bytes, depth: int) -> tuple[list[np.ndarray], np.ndarray, pa.Array]:
    """Every distinct phrase of 1 to ``depth`` words of a text: columns of codes in order (0: no word), counts, and the words."""
    columns, words = suffixes(text, depth)
    ones = np.ones(len(columns[0]), np.int64)
    parts, counts = [], []
    for size in range(1, depth + 1):
        long_enough = np.flatnonzero(columns[size - 1])
        first, number = equal_partitions([c[long_enough] for c in columns[:size]], ones[:len(long_enough)], 1)
        at = long_enough[first]
        parts.append([columns[k][at] if k < size else np.zeros(len(at), np.int32) for k in range(depth)])
        counts.append(number)
    return [np.concatenate([p[k] for p in parts]) for k in range(depth)], np.concatenate(counts), words


def lines(lang: bytes, columns: list[np.ndarray], words: pa.Array) -> pa.Array:
    """The phrases as lines of words parted by spaces, the language's bytes in hexadecimal digits in front."""
    spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.binary()), words, b"")
    spaced = pa.concat_arrays([pa.array([b""], pa.binary()), spaced])
    texts = [spaced.take(pa.array(c)) for c in columns]
    return pc.binary_join_element_wise(pa.scalar(lang.hex().encode(), pa.binary()), *texts, pa.scalar(b"\n", pa.binary()), b"")


def routed(lang: bytes, text: bytes, depth: int, routes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(route, lines, counts) of a slice of one language's text."""
    columns, counts, words = phrases_of(text, depth)
    if not len(counts):
        return
    seed = xxhash.xxh3_64_intdigest(lang)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in [b"", *words.to_pylist()]), np.uint64, len(words) + 1)
    total = np.zeros(len(counts), np.uint64)
    for column, factor in zip(columns, np.resize(FACTORS, depth), strict=True):
        total = mixed(total + hashes[column] * factor)
    route = (total % np.uint64(routes)).astype(np.int64)
    order = np.argsort(route, kind="stable")
    text_lines = lines(lang, [c[order] for c in columns], words)
    offsets, data = np.frombuffer(text_lines.buffers()[1], np.int32)[:len(order) + 1], text_lines.buffers()[2]
    counts, route = counts[order].astype("<i8"), route[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(route)) + 1, [len(route)]])
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        part = data.slice(offsets[low], offsets[high] - offsets[low])
        yield int(route[low]), _packed(part.to_pybytes()), _packed(counts[low:high].tobytes())


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """(language, text) of some SLICE bytes; texts end pieces, and a longer text is cut at the end of a piece."""
    held: dict[bytes, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text, at = lang.as_py(), text.as_py(), 0
            while at < len(text):
                cut = END.search(text, at + SLICE) if len(text) - at > SLICE else None
                end = cut.end() if cut else len(text)
                held[lang].append(text[at:end])
                size, at = size + end - at, end
                if size >= SLICE:
                    for name, texts in held.items():
                        yield name, b".".join(texts)
                    held, size = defaultdict(list), 0
    for name, texts in held.items():
        yield name, b".".join(texts)


def counted(docs: DataFrame, depth: int, least: int) -> DataFrame:
    """lang, phrase (null: all words of the language), n_words and n of every phrase that occurs ``least`` times at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = max(LEAST_ROUTES, size // ROUTE_BYTES)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in slices(batches):
            rows = list(routed(lang, text, depth, routes))
            pa.default_memory_pool().release_unused()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                                 ["route", "phrases", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        texts = b"".join(_unpacked(x.as_py()) for x in table.column("phrases"))
        weights = np.concatenate([np.frombuffer(_unpacked(x.as_py()), "<i8") for x in table.column("counts")])
        codes, words, starts = coded_words(texts, (32, 10))
        line = np.concatenate([[0], np.cumsum(np.frombuffer(texts, np.uint8) == 10, dtype=np.int32)])[starts]
        first = np.flatnonzero(np.diff(line, prepend=-1))
        sizes = np.diff(first, append=len(codes)) - 1
        columns = [codes[first]]
        for k in range(1, depth + 1):
            columns.append(np.where(sizes >= k, codes[np.minimum(first + k, len(codes) - 1)], 0))
        at, number = equal_partitions(columns, weights, least)
        names = [bytes.fromhex(w.decode()).decode("utf-8", "replace") for w in words.take(pa.array(columns[0][at] - 1)).to_pylist()]
        spaced = pa.concat_arrays([pa.array([b""], pa.binary()), pc.binary_join_element_wise(pa.scalar(b" ", pa.binary()), words, b"")])
        phrase = pc.binary_join_element_wise(*[spaced.take(pa.array(c[at])) for c in columns[1:]], b"")
        single = sizes == 1
        totals = np.zeros(len(words) + 1, np.int64)
        np.add.at(totals, columns[0][single], weights[single])
        langs = np.flatnonzero(totals)
        names += [bytes.fromhex(w.decode()).decode("utf-8", "replace") for w in words.take(pa.array(langs - 1)).to_pylist()]
        phrase = [p[1:].decode("utf-8", "replace") for p in phrase.to_pylist()] + [None] * len(langs)
        return pa.table([pa.array(names, pa.string()), pa.array(phrase, pa.string()),
                         pa.array(np.concatenate([sizes[at], np.zeros(len(langs), np.int64)]).astype(np.int32), pa.int32()),
                         pa.array(np.concatenate([number, totals[langs]]), pa.int64())], ["lang", "phrase", "n_words", "n"])

    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).cast("binary").alias("lang"), utf8("text").alias("text"))
    found = texts.mapInArrow(route, "route long, phrases binary, counts binary").groupBy("route").applyInArrow(merge, "lang string, phrase string, n_words int, n long")
    return cut_lineage(found)


def words_from(column: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split(column, " "), start, length), " ")


def mine(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language by their worst cut.

    A phrase inside a longer one that occurs at least ``percent`` of its times is dropped. All products are decimals of 38
    digits, which hold 1000000 * a * a for counts below 10**15.
    """
    found = counted(docs, longest, least)
    totals = found.where(F.col("phrase").isNull()).groupBy("lang").agg(F.sum("n").alias("n"))
    known = found.where(F.col("phrase").isNotNull())
    phrases = known.where(F.col("n_words") > 1).select("lang", "phrase", "n_words", F.col("n").alias("a"))
    part = known.select("lang", F.col("phrase").alias("_part"), F.col("n").alias("_of_part"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.withColumn("_first", words_from("phrase", F.lit(1), F.col("k"))).withColumn("_rest", words_from("phrase", F.col("k") + 1, F.col("n_words") - F.col("k")))
    cuts = cuts.join(part.withColumnsRenamed({"_part": "_first", "_of_part": "l"}), ["lang", "_first"])
    cuts = cuts.join(part.withColumnsRenamed({"_part": "_rest", "_of_part": "r"}), ["lang", "_rest"])
    exact = {name: F.col(name).cast("decimal(18,0)") for name in ("a", "l", "r")}
    above, below = exact["a"] * exact["a"] * F.lit(1_000_000).cast("decimal(7,0)"), exact["l"] * exact["r"]
    cuts = cuts.withColumn("_above", above.cast("decimal(38,0)")).withColumn("_below", below.cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("_above div _below"))
    best = cuts.groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    best = best.select("lang", "phrase", "n_words", "a", "_cut.l", "_cut.r", "_cut.score")
    inner = phrases.where(F.col("n_words") > 2).withColumn("_size", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
    inner = inner.withColumn("_start", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("_size") + 1)))
    inner = inner.select("lang", words_from("phrase", F.col("_start"), F.col("_size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < percent * F.col("a"), F.lit(True)))
    listed = top_per_group(kept.drop("n_words", "_longer"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return listed.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
