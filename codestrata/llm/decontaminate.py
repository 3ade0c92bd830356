"""Passages of benchmark items in documents, found through an embedding of edit distance into Hamming distance.

Words are compared, after lower-casing A-Z. A document holds an item of m words when one of its windows of m words (or the
whole document, if it is shorter) is within floor(m * share) word edits of the item.

* CGK embedding: a random walk reads a word sequence and repeats or advances at each of 3m steps, by a random bit of (step,
  word). Sequences a few edits apart fall into step again, so their embeddings differ in few places.
* Repeated bit sampling: a table compares a few sampled places of one walk. How many tables reach the target recall at the
  largest distance allowed is measured beforehand on mutated sequences of the items' lengths.
* Windows that cannot reach the distance are passed over: an edit destroys two word pairs and three word triples at most,
  so a window needs m - 1 - 2 * edits pairs and m - 2 - 3 * edits triples that occur in items of m words. This never drops
  a match.
* Candidates are confirmed by the exact edit distance.

Documents are scanned where they lie. Items are taken in blocks of a bounded number of words, one scan per block.

Results for odd input: null texts are empty and hold nothing; items of fewer than ``least_words`` words match nothing, as
any text may hold them by chance; items with equal texts are each reported; null or repeated doc_ids are reported as they
are, one result per row and item; an empty table gives no rows; columns besides doc_id, item_id and text are not read.
"""
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage, giving_back, utf8, utf8_slices

SHARE = 0.25               # word edits allowed, per word of the item
RECALL = 0.99              # of windows at the largest distance
SAMPLED = 2                # places a table compares
LEAST_WORDS = 8            # shorter items match by equality
BLOCK_WORDS = 500_000      # words of items to a scan
MOST_TABLES = 400
PLACES = np.uint64(0x9E3779B97F4A7C15)

MATCH = "doc_id long, text_hash long, item_id long, start_word long, n_words long, distance long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def edits(m: int, share: float = SHARE) -> int:
    return int(m * share)


class Tables:
    """The walks and samples of a number of tables; everything follows from the seed."""

    def __init__(self, number: int, longest: int, seed: int = 7):
        self.number, self.steps = number, 3 * longest
        draw = np.random.default_rng(seed)
        self.factor = draw.integers(0, 1 << 63, (self.steps, number), np.uint64) * np.uint64(2) + np.uint64(1)
        self.share = draw.random((number, SAMPLED))      # the places, as a share of the steps that read words
        self.base = _mix(np.arange(1, number + 1, dtype=np.uint64) * PLACES)

    def keys(self, words: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keys (row, table). words: rows padded with zeros; lengths: words in each row; sizes: the item size it stands for."""
        rows = len(words)
        padded = np.concatenate([words.astype(np.uint64), np.zeros((rows, 1), np.uint64)], axis=1)
        # A walk has read its m words after some 2m steps; places beyond would compare padding only.
        places = np.sort((self.share[None] * (2 * sizes[:, None, None])).astype(np.int64), axis=2)
        at = np.zeros((rows, self.number), np.int64)
        row = np.arange(rows)[:, None]
        key = self.base[None] + _mix(sizes.astype(np.uint64))[:, None]
        end = np.minimum(lengths, words.shape[1])[:, None]
        for step in range(int(2 * sizes.max(initial=0))):
            word = padded[row, at]
            for i in range(SAMPLED):
                here = places[:, :, i] == step
                if here.any():
                    key[here] = _mix(key[here] * PLACES + word[here] + np.uint64(i + 1))
            bit = (((word + np.uint64(1)) * PLACES ^ np.uint64(step)) * self.factor[step][None]) >> np.uint64(63)
            at = np.minimum(at + bit.astype(np.int64), end)
        return key


def tables_needed(sizes: list[int], share: float, recall: float, trials: int = 200, seed: int = 11) -> int:
    """Tables at which sequences at the largest distance allowed meet with the wanted recall, over lengths from least to longest."""
    draw, most = np.random.default_rng(seed), 1
    for m in {sizes[0], sizes[len(sizes) // 2], sizes[-1]}:
        if edits(m, share) == 0:
            continue
        words, changed = np.zeros((trials, m), np.int64), np.zeros((trials, m), np.int64)
        for t in range(trials):
            own = draw.integers(1, 1 << 40, m)
            other = own.tolist()
            for _ in range(edits(m, share)):
                at, kind = int(draw.integers(0, len(other))), draw.random()
                if kind < 0.6:
                    other[at] = int(draw.integers(1, 1 << 40))
                elif kind < 0.8:
                    del other[at]
                else:
                    other.insert(at, int(draw.integers(1, 1 << 40)))
            other = (other + [0] * m)[:m]
            words[t], changed[t] = own, other
        number, reached = MOST_TABLES, []
        while not len(reached):
            if number > 8 * MOST_TABLES:
                raise ValueError(f"{number // 2} tables find fewer than {recall:.0%} of windows of {m} words at {edits(m, share)} edits")
            tables, size = Tables(number, m, seed), np.full(trials, m)
            met = tables.keys(words, size, size) == tables.keys(changed, size, size)
            reached = np.flatnonzero(np.logical_or.accumulate(met, axis=1).mean(axis=0) >= recall)
            number *= 2
        most = max(most, int(reached[0]) + 1)
    return most


def distance(pattern: list[int], text: list[int]) -> int:
    """Word edits between two sequences, a bit per word of the pattern."""
    m = len(pattern)
    if not m:
        return len(text)
    where: dict[int, int] = {}
    for i, word in enumerate(pattern):
        where[word] = where.get(word, 0) | 1 << i
    whole, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = whole, 0, m
    for word in text:
        same = where.get(word, 0)
        level = same | down
        diagonal = (((same & up) + up) ^ up) | same
        more, less = down | (~(diagonal | up) & whole), up & diagonal
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & whole, less << 1 & whole
        up, down = less | (~(level | more) & whole), more & level
    return score


class Items:
    """A block of items, ready to scan documents."""

    def __init__(self, items: list[tuple[int, bytes]], share: float, least_words: int, tables: int | None = None, recall: float = RECALL):
        self.share = share
        split = [(i, text.lower().split()) for i, text in items]
        short = [(i, words) for i, words in split if 0 < len(words) < least_words]
        split = [(i, words) for i, words in split if len(words) >= least_words]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, words in [*split, *short] for w in words}), 1)}
        # Items of few words match where all their words stand in order: run -> the items that are this run, by size.
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for item, words in short:
            self.short.setdefault(len(words), {}).setdefault(tuple(self.vocabulary[w] for w in words), []).append(item)
        self.short_runs = {n: np.unique(self._grams(np.array([w for run in runs for w in run], np.int64), n)[::n]) for n, runs in self.short.items()}
        by_words: dict[tuple[int, ...], list[int]] = {}
        for item, words in split:
            by_words.setdefault(tuple(self.vocabulary[w] for w in words), []).append(item)
        self.words = [list(k) for k in by_words]
        self.names = list(by_words.values())
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        if not self.words:
            return
        self.distinct = sorted(set(self.sizes.tolist()))
        # Runs of two and three words by the size of the items that they occur in, and of all items.
        self.runs = {(n, m): np.unique(np.concatenate([self._grams(np.array(w, np.int64), n) for w in self.words if len(w) == m]))
                     for n in (2, 3) for m in self.distinct}
        self.all_runs = {n: np.unique(np.concatenate([self.runs[n, m] for m in self.distinct])) for n in (2, 3)}
        self.tables = Tables(tables or tables_needed(self.distinct, share, recall), self.distinct[-1])
        padded = np.zeros((len(self.words), self.distinct[-1]), np.int64)
        for row, words in enumerate(self.words):
            padded[row, :len(words)] = words
        keys = self.tables.keys(padded, self.sizes, self.sizes).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], order // self.tables.number

    @staticmethod
    def _grams(ids: np.ndarray, size: int) -> np.ndarray:
        """A number for every run of ``size`` known words, and none of these for a run with an unknown word."""
        total, known = np.zeros(max(0, len(ids) - size + 1), np.uint64), np.ones(max(0, len(ids) - size + 1), bool)
        for k in range(size):
            part = ids[k:len(ids) - size + 1 + k]
            total = (total + part.astype(np.uint64)) * PLACES
            known &= part > 0
        return np.where(known, _mix(total) >> np.uint64(1), np.uint64((1 << 64) - 1))

    def _hits(self, ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a run that occurs in items begins, inside one document, and the runs."""
        grams, inside = self._grams(ids, size), np.ones(len(ids), bool)
        for back in range(1, size):
            inside[starts[starts >= back] - back] = False
        there = np.flatnonzero((grams != np.uint64((1 << 64) - 1)) & inside[:len(grams)])
        there = there[_within(grams[there], self.all_runs[size])]
        return there, grams[there]

    def _windows(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the windows that the counts let through. ids: documents one after another."""
        every_hit = {n: self._hits(ids, starts, n) for n in (2, 3)}
        ends = np.append(starts[1:], len(ids))
        found_at, found_size = [], []
        for m in self.distinct:
            needs = {n: m - n + 1 - n * edits(m, self.share) for n in (2, 3)}
            hits = {n: at[_within(runs, self.runs[n, m])] for n, (at, runs) in every_hit.items()}
            by = 3 if needs[3] > 0 else 2
            least, places = needs[by], hits[by]
            if least < 1:                     # too short to tell: every window
                first, last = starts, np.maximum(starts, ends - m)
            else:
                if len(places) < least:
                    continue
                one, other = places[:len(places) - least + 1], places[least - 1:]
                doc = np.searchsorted(starts, one, "right") - 1
                fits = (other - one <= m - by) & (other < ends[doc])
                one, other, doc = one[fits], other[fits], doc[fits]
                first = np.maximum(other + by - m, starts[doc])
                last = np.minimum(one, np.maximum(starts[doc], ends[doc] - m))
                first = np.minimum(first, last)
            number = last - first + 1
            if not len(number):
                continue
            every = np.unique(np.repeat(first - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum()))
            past = np.minimum(every + m, ends[np.searchsorted(starts, every, "right") - 1])
            for n, need in needs.items():
                enough = np.searchsorted(hits[n], np.maximum(every, past - n + 1)) - np.searchsorted(hits[n], every) >= need
                every, past = every[enough], past[enough]
            found_at.append(every)
            found_size.append(np.full(len(every), m))
        if not found_at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found_size)

    def _short_hits(self, ids: np.ndarray, begin: np.ndarray, doc_of: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The first place of each short item in each document; ids: documents with words one after another."""
        found: dict[tuple[int, int, tuple[int, ...]], int] = {}
        ends = np.append(begin[1:], len(ids))
        for n, runs in self.short.items():
            for at in np.flatnonzero(_within(self._grams(ids, n), self.short_runs[n])).tolist():
                doc, run = int(np.searchsorted(begin, at, "right")) - 1, tuple(ids[at:at + n].tolist())
                if at + n <= ends[doc] and run in runs:
                    found.setdefault((int(doc_of[doc]), n, run), at - int(begin[doc]))
        return [(doc, item, start, n, 0) for (doc, n, run), start in found.items() for item in self.short[n][run]]

    def scan(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, first word, words, distance), the nearest and then first window of each text and item."""
        if not self.words and not self.short:
            return []
        split = [text.lower().split() for text in texts]
        lengths = np.array([len(w) for w in split], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ids = np.fromiter(map(self.vocabulary.get, chain.from_iterable(split), repeat(0)), np.int64, int(lengths.sum()))
        filled = lengths > 0
        doc_of, begin = np.flatnonzero(filled), starts[filled]
        if not len(begin):
            return []
        exact = self._short_hits(ids, begin, doc_of)
        if not self.words:
            return exact
        ends = np.append(begin[1:], len(ids))
        at, size = self._windows(ids, begin)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for some in range(0, len(at), 2000):
            start, m = at[some:some + 2000], size[some:some + 2000]
            doc = np.searchsorted(begin, start, "right") - 1
            length = np.minimum(m, ends[doc] - start)
            columns = np.arange(int(m.max()))[None]
            inside = columns < length[:, None]
            words = np.where(inside, ids[np.minimum(start[:, None] + columns, len(ids) - 1)], 0)
            keys = self.tables.keys(words, length, m)
            low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            met = set()
            for row, table in zip(*np.nonzero(high > low), strict=True):
                met.update((int(row), int(o)) for o in self.owners[low[row, table]:high[row, table]])
            for row, owner in sorted(met):
                if self.sizes[owner] != m[row]:
                    continue
                far = distance(self.words[owner], words[row, :length[row]].tolist())
                if far <= edits(int(m[row]), self.share):
                    key = (int(doc_of[doc[row]]), owner)
                    found = (far, int(start[row] - begin[doc[row]]), int(length[row]))
                    best[key] = min(best.get(key, found), found)
        return exact + [(doc, item, start, n, far) for (doc, owner), (far, start, n) in sorted(best.items()) for item in self.names[owner]]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of some BLOCK_WORDS words, by hash; a block is bounded, their number grows with the benchmark."""
    items = cut_lineage(benchmark.select(F.col("item_id").cast("long").alias("item_id"), utf8("text").alias("text")).filter(F.length("text") > 0))
    size = items.agg(F.sum(F.length("text") / 4)).first()[0] or 0
    number = max(1, int(-(-size // BLOCK_WORDS)))
    for block in range(number):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == block)
        yield sorted(((r["item_id"], bytes(r["text"])) for r in some.collect()), key=lambda r: (r[0] is not None, r))


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_hash, item_id, start_word, n_words, distance: the nearest window of every document and item that match."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), utf8("text").alias("text"))
    found = None
    for some in blocks(benchmark):
        block = Items(some, share, least_words, recall=recall)

        def scan(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "text_hash", "item_id", "start_word", "n_words", "distance"]
            for part in utf8_slices(batches):
                ids, hashes = part.column(0).to_pylist(), part.column(1).to_pylist()
                hits = [(ids[d], hashes[d], *rest) for d, *rest in block.scan(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in range(6)], names)
        hit = rows.mapInArrow(giving_back(scan), MATCH)
        found = hit if found is None else found.unionByName(hit)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with all columns, without the rows that hold an item."""
    hit = cut_lineage(matches(docs, benchmark)).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(hit["_d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hit["_h"])
    return docs.join(hit, same, "left_anti")
