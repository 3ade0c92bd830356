"""Brown class-based n-grams: exchange clustering, class transitions, word emissions, and the log-probability of every text.

The corpus is written once as chunks of word codes. Words are dealt by hash to parts (``word_parts``), where the chunks' counts
of a word are added up; each chunk gets its own words' counts and classes back from the parts; nothing of the vocabulary is
broadcast.

The number of classes is the cube root of the number of training words, ``CLASSES`` at least. The most frequent words are
the seed, by the exchange algorithm: each in turn moves to the class where it adds most to the likelihood of the class
bigrams, until none moves. Spark counts which of them follow which; that table has at most UNITS squared cells, and rarer
words stand in it by the power of two of their count.

Then passes over all words seen more than once: Spark counts which classes stand before and after each word, and each word
goes where it adds most, given the class bigrams; what a pass did is kept if the likelihood of all training text rose. The
first pass deals every word, later ones one half or the other, since words that move together can undo each other's gain.
Words seen once have a class of their own, words never seen in training another, and the end of a text a third.

P(word | one before) = P(class | class before) * P(word | class). Transitions are smoothed by the classes' own frequency.
All words never seen in training are one event, as in the add-one base score: the V words of training and that event have
probabilities that sum to one after any word. It shares with the words seen once what training gives those, by Good-Turing:
once : unseen = 2 * (words seen twice) : (words seen once).

Words are told apart by 64-bit hashes. Results for odd input: null texts are empty and hold only the end; a null doc_id is
not held out; repeated ids are scored row by row; without training rows N and V are 0 and scores are those of the smoothing
alone; an empty table gives no rows; columns besides doc_id and text are not read.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage, giving_back, release, utf8, utf8_slices
from codestrata.llm.word_parts import dealt, packed, places_of, to_chunks, unpacked

CHUNK_BYTES = 8 << 20
CLUSTERED = 1000               # most frequent words that the exchange sorts into classes
CLASSES = 32                   # at least; number_of_classes gives more to a larger vocabulary
TIERS = 64                     # classes of rarer words, by the logarithm of their count
UNSEEN, END = CLUSTERED + TIERS - 1, CLUSTERED + TIERS
UNITS = CLUSTERED + TIERS + 1
TOTAL_CLASSES = CLASSES + TIERS + 1
SWEEPS = 12
PASSES = 3                     # over all words seen more than once
GAIN_CELLS = 1 << 20           # word neighbours times classes weighed at a time
SMOOTHING = 5.0
END_WORD = 0                   # the end's hash

CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<long>, codes binary, words array<long>, counts array<long>"
SEEDED = "held array<boolean>, lengths array<long>, units binary"
SCORED = "doc_ids array<long>, held array<boolean>, lengths array<long>, classes binary, base array<double>, known array<long>, emission array<double>"
NEIGHBOURS = "part int, chunk long, keys array<int>, counts array<long>, times binary, cells binary, many binary"


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def chunks(docs: DataFrame, held_out: Column) -> DataFrame:
    """A row per some CHUNK_BYTES of whole texts: codes into the chunk's own word list, and the words' training counts."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for some in utf8_slices(batches, CHUNK_BYTES):
            codes, parts, lengths = _Codes({b"": 0}), [], []
            for text in some.column(2).to_pylist():
                words = text.lower().split()
                words.append(b"")
                parts.append(np.fromiter(map(codes.__getitem__, words), np.uint32, len(words)))
                lengths.append(len(words))
            train = np.concatenate([p for p, held in zip(parts, some.column(1).to_pylist(), strict=True) if not held] or [np.zeros(0, np.uint32)])
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) if w else END_WORD for w in codes), np.uint64, len(codes))
            order = np.argsort(hashes)                     # the word list by hash, so a part's words are a run of it
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), *[pa.array([x], pa.list_(t)) for x, t in (
                    (some.column(0).to_pylist(), pa.int64()), (some.column(1).to_pylist(), pa.bool_()), (lengths, pa.int64()))],
                pa.array([packed(place[np.concatenate(parts)])]), pa.array([hashes[order].view(np.int64)], pa.list_(pa.int64())),
                pa.array([np.bincount(train, minlength=len(codes))[order]], pa.list_(pa.int64()))],
                ["chunk", "doc_ids", "held", "lengths", "codes", "words", "counts"])
            number += 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), utf8("text").alias("text"))
    return cut_lineage(rows.mapInArrow(giving_back(encode), CHUNK))


def count_words(corpus: DataFrame) -> tuple[DataFrame, list[int], dict]:
    """The parts of the words with their counts; the most frequent words; totals."""
    parts = dealt(corpus)
    counted = parts.select(F.explode(F.arrays_zip("words", "c")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.c").alias("c"))
    # CLUSTERED rows, a bound that does not depend on the corpus.
    top = [r["word"] for r in counted.filter((F.col("c") > 0) & (F.col("word") != END_WORD)).orderBy(F.desc("c"), "word").limit(CLUSTERED).collect()]
    ranked = corpus.sparkSession.createDataFrame([(w, i) for i, w in enumerate(top)], "word long, rank int")
    tier = F.when(F.col("word") == END_WORD, END).when(F.col("c") == 0, UNSEEN).otherwise(CLUSTERED + F.floor(F.log2(F.col("c").cast("double")) + 1e-9))
    words = counted.join(F.broadcast(ranked), "word", "left").select("c", F.coalesce("rank", tier).cast("int").alias("unit"))
    per_unit = words.groupBy("unit").agg(F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("long")).alias("types"), F.sum((F.col("c") == 1).cast("long")).alias("once"),
                                         F.sum((F.col("c") == 2).cast("long")).alias("twice")).collect()      # at most UNITS rows
    mass = np.zeros(UNITS)
    for r in per_unit:
        mass[r["unit"]] = r["c"]
    once, twice = sum(r["once"] for r in per_unit), sum(r["twice"] for r in per_unit)
    totals = {"N": int(mass.sum()), "V": sum(r["types"] for r in per_unit), "mass": mass, "unseen": once / max(1.0, once + 2.0 * twice) if once else 0.5}
    return parts, top, totals


def with_units(parts: DataFrame, top: list[int]) -> DataFrame:
    """(part, kinds): the unit of each word of a part, its rank among ``top`` or the tier of its count."""
    ranks = np.argsort(np.array(top, np.int64))
    known = np.append(np.array(top, np.int64)[ranks], np.iinfo(np.int64).max)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                words, c = (batch.column(i)[row].values.to_numpy() for i in (1, 2))
                unit = np.where(c == 0, UNSEEN, CLUSTERED + np.floor(np.log2(np.maximum(c, 1).astype(float)) + 1e-9).astype(np.int64))
                unit[words == END_WORD] = END
                at = np.searchsorted(known[:-1], words)
                there = (known[at] == words) & (at < len(ranks))
                unit[there] = ranks[at[there]]
                found.append(packed(unit.astype(np.uint16)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["part", "kinds"])
    return cut_lineage(parts.select("part", "words", "c").mapInArrow(name, "part int, kinds binary"))


def number_of_classes(v: int) -> int:
    return max(CLASSES, round(v ** (1 / 3)))


def with_own(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """Each chunk with what ``to_chunks`` found of its own words."""
    number = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), corpus.count() // 4)
    return corpus.select("chunk", "doc_ids", "held", "lengths", "codes").repartition(number, "chunk").join(found, "chunk").select("doc_ids", "held", "lengths", "codes", "own", "chunk")


def _each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, list[tuple[int, int]]]]:
    """(row, lengths, codes, kinds by code, counts by code if they were asked for, (part, words) of each part) of every chunk."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            own = one.column(4)[0].values
            order = np.argsort(own.field("part").to_numpy())
            kinds = [unpacked(own.field("kinds")[int(i)].as_buffer(), np.uint16) for i in order]
            counts = None if own.field("c").null_count else np.concatenate([unpacked(own.field("c")[int(i)].as_buffer(), np.int64) for i in order])
            runs = list(zip(own.field("part").to_numpy()[order].tolist(), map(len, kinds), strict=True))
            yield one, one.column(2).flatten().to_numpy(), unpacked(one.column(3)[0].as_buffer(), np.uint32), np.concatenate(kinds), counts, runs


def units(corpus: DataFrame, parts: DataFrame, named: DataFrame) -> DataFrame:
    """Each chunk as a sequence of units."""
    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, _, codes, unit, _, _ in _each_chunk(batches):
            yield pa.RecordBatch.from_arrays([one.column(1), one.column(2), pa.array([packed(unit[codes])])], ["held", "lengths", "units"])
    return with_own(corpus, to_chunks(parts, named)).mapInArrow(giving_back(translate), SEEDED)


def runs_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells and how often each is there; ``cells`` is sorted in place."""
    cells.sort()
    starts = np.flatnonzero(np.concatenate([[len(cells) > 0], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    return cells[starts], np.diff(np.append(starts, len(cells)))


def neighbours(corpus: DataFrame, parts: DataFrame, assigned: DataFrame, kinds: int, of_words: bool) -> DataFrame:
    """Counts in training text by chunk: a row without a part holds the class bigrams (class before * kinds + class); with
    ``of_words`` a row per part holds, for its words seen more than once, the classes before them and (kinds + class) after."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, lengths, codes, own, _, runs in _each_chunk(batches):
            kind = own.astype(np.int32)[codes]
            before = _before(kind, lengths, kinds - 1)
            train = np.repeat(~one.column(1).flatten().to_numpy(zero_copy_only=False).astype(bool), lengths)
            pairs = np.bincount((before * np.int32(kinds) + kind)[train], minlength=kinds * kinds)
            there = np.flatnonzero(pairs)
            part, keys, counts, times, cells_of, many = [None], [there], [pairs[there]], [None], [None], [None]
            if of_words:
                at = np.flatnonzero(train & (kind < kinds - 2) & (kind != kinds - TIERS - 1))       # never a text's last place, an end
                # Cells in as many bits as the chunk's words and the classes need: half the memory, and a quicker sort.
                bits = np.uint32 if len(own) * 2 * kinds < 1 << 32 else np.int64
                cells = np.empty(2 * len(at), bits)
                cells[:len(at)] = cells[len(at):] = codes[at].astype(bits) * bits(2 * kinds)
                cells[:len(at)] += before[at].astype(bits)
                cells[len(at):] += (kind[at + 1] + kinds).astype(bits)
                del at, kind, before, train, codes
                found, number = runs_of(cells)
                del cells
                first = 0
                for name, words in runs:
                    some = slice(*np.searchsorted(found, np.array([first, first + words], np.int64) * (2 * kinds)))
                    code, key = found[some] // bits(2 * kinds), found[some] % bits(2 * kinds)
                    if len(code):
                        part.append(name)
                        times.append(packed(np.bincount(code.astype(np.int64) - first, minlength=words).astype(np.uint32)))
                        cells_of.append(packed(key.astype(np.uint32)))
                        many.append(packed(number[some].astype(np.uint32)))
                    first += words
            rest = [None] * (len(part) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([one.column(5)[0].as_py()] * len(part), pa.int64()), pa.array(keys + rest, pa.list_(pa.int32())),
                                              pa.array(counts + rest, pa.list_(pa.int64())), *[pa.array(x, pa.binary()) for x in (times, cells_of, many)]],
                                             ["part", "chunk", "keys", "counts", "times", "cells", "many"])
    return with_own(corpus, to_chunks(parts, assigned)).mapInArrow(giving_back(count), NEIGHBOURS)


def class_pairs(counted: DataFrame, kinds: int) -> np.ndarray:
    """The class bigram table; it grows with the square of the classes, not with the corpus."""
    pairs = counted.filter("part IS NULL").select(F.explode(F.arrays_zip("keys", "counts")).alias("p")).groupBy("p.keys").agg(F.sum("p.counts").alias("n")).toPandas()
    table = np.zeros(kinds * kinds)
    table[pairs["keys"].to_numpy(np.int64)] = pairs["n"]
    return table.reshape(kinds, kinds)


def best_classes(table: np.ndarray, number: int, own: np.ndarray, row: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of each word to which it belongs most: its own or one of the first ``number``. An entry is (row of the word,
    class before or classes + class after, count), by row. Pairs with its own class are taken as they stand in the table."""
    kinds, new = len(table), own.copy()
    cells = np.concatenate([table[:, :number], table[:number].T])
    after, before = table.sum(1), table.sum(0)
    before_it = key < kinds
    cell = np.where(before_it, table[key % kinds, own[row]], table[own[row], key % kinds])
    stay = np.bincount(row, _log_sum(cell) - _log_sum(cell - n), len(own))
    left, right = np.bincount(row, n * before_it, len(own)), np.bincount(row, n * ~before_it, len(own))
    stay -= _log_sum(after[own]) - _log_sum(after[own] - right) + _log_sum(before[own]) - _log_sum(before[own] - left)
    starts = np.append(np.searchsorted(row, np.arange(len(own))), len(row))
    first = 0
    while first < len(own):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + GAIN_CELLS // number, "right")) - 1)
        some, words = slice(starts[first], starts[last]), slice(first, last)
        were = cells[key[some]]
        gain = np.add.reduceat(_log_sum(were + n[some, None]) - _log_sum(were), starts[words] - starts[first], axis=0)
        for margin, more in ((after[:number], right[words, None]), (before[:number], left[words, None])):
            gain -= _log_sum(margin + more) - _log_sum(margin)
        inside = np.flatnonzero(own[words] < number)
        gain[inside, own[words][inside]] = stay[words][inside]
        best = gain.argmax(1)
        better = gain[np.arange(len(best)), best] > stay[words] + 1e-9
        new[words] = np.where(better, best, own[words])
        first = last
    return new


def moved(counted: DataFrame, parts: DataFrame, assigned: DataFrame, table: np.ndarray, number: int, half: int | None) -> DataFrame:
    """(part, kinds) after the words that gain by it changed their class: of all, or of one half of them."""
    kinds = len(table)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = unpacked(batch.column(1)[row].as_buffer(), np.uint16).astype(np.int64)
                blocks = batch.column(4)[row].values
                if blocks is not None and len(blocks):
                    places = dict(zip(batch.column(2)[row].values.to_pylist(), batch.column(3)[row].values, strict=True))
                    cells = np.concatenate([np.repeat(places_of(places[chunk].as_buffer()), unpacked(times.as_buffer(), np.uint32)) * (2 * kinds) + unpacked(keys.as_buffer(), np.uint32)
                                            for chunk, times, keys in zip(blocks.field("chunk").to_pylist(), blocks.field("times"), blocks.field("cells"), strict=True)])
                    n = np.concatenate([unpacked(m.as_buffer(), np.uint32) for m in blocks.field("many")])
                    if half is not None:
                        mine = batch.column(5)[row].values.to_numpy(zero_copy_only=False)[cells // (2 * kinds)]
                        cells, n = cells[mine], n[mine]
                    cells, n = summed(cells, n)
                    words, place = np.unique(cells // (2 * kinds), return_inverse=True)
                    if len(words):
                        own[words] = best_classes(table, number, own[words], place, cells % (2 * kinds), n.astype(float))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([packed(own.astype(np.uint16))], pa.binary())], ["part", "kinds"])
    blocks = counted.filter("part IS NOT NULL").groupBy("part").agg(F.collect_list(F.struct("chunk", "times", "cells", "many")).alias("blocks"))
    # A part's words stay in its row; which half a word is in depends on the word alone.
    halves = [] if half is None else [F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(2)) == half).alias("mine")]
    rows = assigned.join(parts.select("part", "chunks", "places", *halves), "part").join(blocks, "part", "left")
    return rows.select("part", "kinds", "chunks", "places", "blocks", *["mine"] * len(halves)).mapInArrow(giving_back(choose), "part int, kinds binary")


def summed(cells: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells in order and the sum of each one's numbers."""
    order = np.argsort(cells, kind="stable")
    cells, n = cells[order], n[order].astype(np.int64)
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    return cells[starts], np.add.reduceat(n, starts) if len(n) else n


def cluster(corpus: DataFrame, parts: DataFrame, named: DataFrame, seed: np.ndarray, number: int) -> tuple[DataFrame, np.ndarray]:
    """((part, kinds) with the class of every word, class bigram table), from the class of each unit."""
    kinds = number + TIERS + 1

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(seed[unpacked(k.as_buffer(), np.uint16)].astype(np.uint16)) for k in batch.column(1)], pa.binary())], ["part", "kinds"])
    assigned, kept, table, best = cut_lineage(named.mapInArrow(begin, "part int, kinds binary")), None, None, -np.inf
    for step in range(PASSES + 1):
        counted = cut_lineage(neighbours(corpus, parts, assigned, kinds, step < PASSES))
        pairs = class_pairs(counted, kinds)
        if step and likelihood(pairs) <= best:
            release(counted)
            break
        kept, table, best = assigned, pairs, likelihood(pairs)
        if step < PASSES:
            assigned = cut_lineage(moved(counted, parts, assigned, table, number, step % 2 if step else None))
        release(counted)
    return kept, table


def classified(corpus: DataFrame, parts: DataFrame, assigned: DataFrame, totals: dict, table: np.ndarray) -> DataFrame:
    """Each chunk as a sequence of classes, with what can be summed per text already: base score, known words, word emissions."""
    n, v, mass = totals["N"], totals["V"], table.sum(0)         # each training token stands after something, so a column has its class's tokens

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, lengths, codes, kind, c, _ in _each_chunk(batches):
            emission = np.where(c > 0, np.log10(np.maximum(c, 1) / np.maximum(mass[kind], 1)), 0.0)
            base = np.log10((c + 1) / (n + v + 1))
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            sums = [np.add.reduceat(x[codes], starts) for x in (base, (c > 0).astype(np.int64), emission)]
            yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), one.column(2), pa.array([packed(kind[codes])]),
                                              *[pa.array([x], pa.list_(t)) for x, t in zip(sums, (pa.float64(), pa.int64(), pa.float64()), strict=True)]],
                                             ["doc_ids", "held", "lengths", "classes", "base", "known", "emission"])
    return with_own(corpus, to_chunks(parts, assigned, counts=True)).mapInArrow(giving_back(translate), SCORED)


def _before(sequence: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """What stands before each token; a text begins after an end."""
    before = np.empty_like(sequence)
    before[1:] = sequence[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = start
    return before


def bigrams(sequences: DataFrame) -> DataFrame:
    """(a, b, n): how often unit b follows unit a in training texts; at most UNITS squared rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS * UNITS, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                sequence = unpacked(batch.column(2)[row].as_buffer(), np.uint16).astype(np.int64)
                lengths = batch.column(1)[row].values.to_numpy()
                train = np.repeat(~batch.column(0)[row].values.to_numpy(zero_copy_only=False).astype(bool), lengths)
                total += np.bincount((_before(sequence, lengths, END) * UNITS + sequence)[train], minlength=UNITS * UNITS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there // UNITS), pa.array(there % UNITS), pa.array(total[there])], ["a", "b", "n"])
    made = sequences.select("held", "lengths", "units").mapInArrow(giving_back(count), "a long, b long, n long")
    return made.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _log_sum(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    return float(_log_sum(table).sum() - _log_sum(table.sum(0)).sum() - _log_sum(table.sum(1)).sum())


def best_class(table: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, both: float, number: int | None = None) -> int:
    """The class to which a word belongs most. left, right: its neighbours by class, itself apart; both: how often it follows itself.
    It may move to the first ``number`` classes."""
    number = number or CLASSES
    rest = table.copy()
    rest[:, own] -= left
    rest[own] -= right
    rest[own, own] -= both
    rows, columns, diagonal = rest[:, :number].T, rest[:number], np.arange(number)
    gain = (_log_sum(rows + left) - _log_sum(rows)).sum(1) + (_log_sum(columns + right) - _log_sum(columns)).sum(1)
    for extra, line in ((left, rows), (right, columns)):
        gain -= _log_sum(line[diagonal, diagonal] + extra[:number]) - _log_sum(line[diagonal, diagonal])
    corner = rest[diagonal, diagonal]
    gain += _log_sum(corner + left[:number] + right[:number] + both) - _log_sum(corner)
    # Its neighbours' own margins hold the pairs with the word wherever it goes.
    for margin, more in ((rest.sum(1) + left, right.sum() + both), (rest.sum(0) + right, left.sum() + both)):
        gain -= (_log_sum(margin + more) - _log_sum(margin))[:number]
    return own if gain[own] >= gain.max() - 1e-9 else int(np.argmax(gain))


def class_table(follows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    number = int(classes.max()) + 1
    rows = np.zeros((number, len(classes)))
    np.add.at(rows, classes, follows)
    table = np.zeros((number, number))
    np.add.at(table.T, classes, rows.T)
    return table


def exchange(follows: np.ndarray, classes: np.ndarray, words: int, number: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigram table) from how often unit follows unit. The first ``words`` units move, among
    the first ``number`` classes."""
    classes = classes.copy()
    table, fixed = class_table(follows, classes), int(classes.max()) + 1
    seen = np.flatnonzero(follows[:words].sum(1) + follows[:, :words].sum(0))
    for _ in range(SWEEPS):
        moves = 0
        for unit in seen:
            into, out, itself, own = follows[:, unit].copy(), follows[unit].copy(), follows[unit, unit], int(classes[unit])
            into[unit] = out[unit] = 0
            left, right = np.bincount(classes, into, fixed), np.bincount(classes, out, fixed)
            best = best_class(table, own, left, right, itself, number)
            if best != own:
                for kind, sign in ((own, -1), (best, 1)):
                    table[:, kind] += sign * left
                    table[kind] += sign * right
                    table[kind, kind] += sign * itself
                classes[unit] = best
                moves += 1
        if not moves:
            break
    return classes, table


def transitions(table: np.ndarray, once: int, unseen: int, share: float) -> np.ndarray:
    """log10 of class transitions (before, after)."""
    own = table.sum(0) + 0.5
    own = own / own.sum()
    steps = (table + SMOOTHING * own) / (table.sum(1, keepdims=True) + SMOOTHING)
    both = steps[:, once] + steps[:, unseen]
    steps[:, once], steps[:, unseen] = both * (1 - share), both * share
    return np.log10(steps)


def model(classes: np.ndarray, table: np.ndarray, totals: dict) -> tuple[np.ndarray, np.ndarray]:
    """The seed alone: log10 of class transitions, and log10 of each unit's emission."""
    mass = totals["mass"]
    class_mass = np.bincount(classes, mass, len(table))
    emission = np.zeros(UNITS)
    emission[:CLUSTERED] = np.log10(np.maximum(mass[:CLUSTERED], 1) / np.maximum(class_mass[classes[:CLUSTERED]], 1))
    return transitions(table, classes[CLUSTERED], classes[UNSEEN], totals["unseen"]), emission


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    corpus = chunks(docs, held_out)
    parts, top, totals = count_words(corpus)
    named = with_units(parts, top)
    counted = cut_lineage(bigrams(units(corpus, parts, named))).toPandas()          # at most UNITS squared rows
    follows = np.zeros((UNITS, UNITS))
    follows[counted["a"], counted["b"]] = counted["n"]
    number = number_of_classes(totals["V"])
    kinds = number + TIERS + 1
    seed, _ = exchange(follows, np.concatenate([np.arange(CLUSTERED) % number, np.arange(number, kinds)]), CLUSTERED, number)
    assigned, table = cluster(corpus, parts, named, seed, number)
    steps, total, end = transitions(table, int(seed[CLUSTERED]), int(seed[UNSEEN]), totals["unseen"]), totals["N"], kinds - 1

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                kind = unpacked(one.column(3)[0].as_buffer(), np.uint16)
                lengths = one.column(2).flatten().to_numpy()
                value = steps[_before(kind, lengths, end), kind]
                found = np.add.reduceat(value, np.concatenate([[0], np.cumsum(lengths)[:-1]])) + one.column(6).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([one.column(0).flatten(), one.column(1).flatten(), pa.array(lengths), one.column(5).flatten(),
                                                  pa.array(np.full(len(lengths), total, np.int64)), one.column(4).flatten(), pa.array(found), pa.array(10 ** (-found / lengths))],
                                                 ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
    return classified(corpus, parts, assigned, totals, table).mapInArrow(
        giving_back(texts), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def hashed_seventh(name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % 7 == 2
