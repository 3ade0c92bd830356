"""Draw documents towards a target distribution by importance weights over hashed word runs.

Features are all runs of one and two words; each falls into one of ``buckets`` by the CRC-32 of its bytes. What the corpus
and the target hold per bucket gives the bucket a gain, a document's weight is the floored mean gain of its features, and
Gumbel noise from the document's id makes the highest scores a draw without replacement.

Head and tail: words and word pairs that some task finds often come to the workers as two broadcast tables of bounded size,
words with their exact bucket and the CRC state after the word and a space, pairs with their exact bucket. Any other word is
hashed directly, any other pair goes on from the state of its first word. Both ways give the same bucket, so what is in the
tables changes the time and never a count; every feature of every text is counted.

Results for odd input: null and empty texts have no features, weight 0 and a rank never; a null doc_id draws its noise from
an empty id and loses ties; equal doc_ids keep a row each, ties among them broken by weight and then by chance; an empty
corpus gives an empty result, an empty target is a target without features. Columns besides doc_id and text are not read.
Very long texts are read in parts of whole words.
"""
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.prefix import running_totals
from codestrata.llm.common import cut_lineage, utf8, utf8_slices

HEAD_WORDS, HEAD_PAIRS = 50_000, 200_000      # rows of the two broadcast tables at most
SHARE = 100_000                               # a task proposes what makes up at least this part of its words
HELD = 300_000                                # entries a task counts before it forgets those met once
PART = 1 << 20                                # bytes of text whose words are lists at one time
RANKED_TOGETHER = 200_000                     # rows of one score that one task ranks, where ids are spread evenly

# Bytes below 0x80 that are not letters or digits part words; A-Z become a-z. All bytes of other characters are kept.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size; a list begins with the last word of the one before, so no pair is lost."""
    text, at, last = text.translate(WORD_BYTES), 0, []
    while at < len(text):
        end = at + PART
        end = len(text) if end >= len(text) else (text.find(b" ", end) + 1 or len(text))
        words = last + text[at:end].split()
        if words:
            yield words
            last = words[-1:]
        at = end


class Head:
    """The broadcast tables: frequent words with bucket and CRC state, frequent pairs of them with their bucket."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int):
        self.buckets = buckets
        self.rank = {word: n for n, word in enumerate(words)}
        crcs = list(map(zlib.crc32, words))
        self.bucket = np.array([c % buckets for c in crcs], np.int64)
        self.state = np.array([zlib.crc32(b" ", c) for c in crcs], np.int64)
        known = [(self.rank[a] * len(words) + self.rank[b], zlib.crc32(a + b" " + b) % buckets) for a, b in pairs if a in self.rank and b in self.rank]
        known.sort()
        self.pair = np.array([k for k, _ in known], np.int64)
        self.pair_bucket = np.array([b for _, b in known], np.int64)

    def features(self, words: list[bytes], first: bool) -> np.ndarray:
        """Buckets of a list of words: every word (but the first one of a later part) and every two that stand together."""
        number = len(words)
        ranks = np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, number)
        single, state = np.empty(number, np.int64), np.empty(number, np.int64)
        in_head = ranks >= 0
        single[in_head], state[in_head] = self.bucket[ranks[in_head]], self.state[ranks[in_head]]
        for at in np.flatnonzero(~in_head).tolist():
            crc = zlib.crc32(words[at])
            single[at], state[at] = crc % self.buckets, zlib.crc32(b" ", crc)
        double = np.empty(number - 1, np.int64)
        found = np.zeros(number - 1, bool)
        if len(self.pair):
            key = np.where(in_head[:-1] & in_head[1:], ranks[:-1] * len(self.bucket) + ranks[1:], -1)
            place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            found = self.pair[place] == key
            double[found] = self.pair_bucket[place[found]]
        tail = np.flatnonzero(~found)
        double[tail] = np.fromiter((zlib.crc32(words[at + 1], s) for at, s in zip(tail.tolist(), state[tail].tolist(), strict=True)), np.int64, len(tail)) % self.buckets
        return np.concatenate([single if first else single[1:], double])


def without_rare(counts: Counter) -> Counter:
    """The counts themselves or, when they are too many, those met more than once, the most frequent of them."""
    if len(counts) <= HELD:
        return counts
    kept = Counter({k: n for k, n in counts.items() if n > 1})
    return kept if len(kept) <= HELD // 2 else Counter(dict(kept.most_common(HELD // 2)))


def head_of(texts: DataFrame, buckets: int) -> Head:
    """Words and pairs that are frequent in some task, the most frequent of them first; all texts are read."""
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, seen = Counter(), Counter(), 0
        for some in utf8_slices(batches):
            for text in some.column(0).to_pylist():
                for part in word_parts(text):
                    words.update(part)
                    pairs.update(pairwise(part))
                    seen += len(part)
                    words, pairs = without_rare(words), without_rare(pairs)
        least = max(2, seen // SHARE)
        rows = [(w, None, n) for w, n in words.most_common(HEAD_WORDS) if n >= least]
        rows += [(a, b, n) for (a, b), n in pairs.most_common(HEAD_PAIRS) if n >= least]
        first, second, number = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array(number, pa.int64())], ["a", "b", "n"])
    counts = cut_lineage(texts.mapInArrow(propose, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))

    def most(rows: DataFrame, limit: int) -> list:
        return rows.orderBy(F.desc("n"), "a", "b").limit(limit).select("a", "b").collect()       # at most ``limit`` rows
    words = [bytes(r.a) for r in most(counts.where(F.col("b").isNull()), HEAD_WORDS)]
    pairs = [(bytes(r.a), bytes(r.b)) for r in most(counts.where(F.col("b").isNotNull()), HEAD_PAIRS)]
    return Head(words, pairs, buckets)


def bucket_totals(texts: DataFrame, head) -> np.ndarray:
    """How many features each bucket holds; a task sends one row for each bucket it met."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = head.value
        totals = np.zeros(tables.buckets, np.int64)
        for some in utf8_slices(batches):
            for text in some.column(0).to_pylist():
                for nth, part in enumerate(word_parts(text)):
                    totals += np.bincount(tables.features(part, nth == 0), minlength=tables.buckets)
        met = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(totals[met], pa.int64())], ["bucket", "n"])
    totals = np.zeros(head.value.buckets, np.int64)
    for row in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():   # at most ``buckets`` rows
        totals[row.bucket] = row.n
    return totals


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over its share in the corpus, in doubles."""
    buckets, S, T = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + buckets) / ((s + 1.0) * (T + buckets))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, head, gain) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, value = head.value, gain.value
        for some in utf8_slices(batches):
            rows = []
            for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                words = features = total = 0
                for nth, part in enumerate(word_parts(text)):
                    met = tables.features(part, nth == 0)
                    words += len(part) - (nth > 0)
                    features += len(met)
                    total += int(value[met].sum())
                rows.append((doc_id, words, features, total // features if features else 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "n_words", "n_features", "weight"])
    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256('<seed>:<doc_id>')."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Rank the highest floor(percent * N / 100) scores of the N documents with ``least_words`` words; others get null.

    How many documents share a score is a small table (scores are thousandths of logarithms). Its running sums give each
    score its first rank; ties are ranked by doc_id inside ranges of ids, so no task gets all rows of a frequent score.
    """
    stands = F.col("n_words") >= least_words
    per_score = scored.where(stands).groupBy("score").agg(F.count("*").alias("_of_score"))
    number, low, high = scored.where(stands).agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    drawn = percent * number // 100
    slices = 1 + (per_score.agg(F.max("_of_score")).first()[0] or 0) // RANKED_TOGETHER
    down = per_score.withColumn("_down", -F.col("score")).withColumn("_all", F.lit(0))
    before = running_totals(down, ["_all"], "_down", {"_upto": F.col("_of_score")}, 1024)
    before = before.select(F.col("score").alias("_at"), (F.col("_upto") - F.col("_of_score")).alias("_before")).where(F.col("_before") < drawn)
    met = scored.join(before, stands & (F.col("score") == F.col("_at")), "left")
    block = F.lit(0)
    if slices > 1:      # by decimals, as the span of two longs need not be a long
        span, width = F.col("doc_id").cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)"), (high - low) // slices + 1
        block = F.coalesce(F.floor(span / F.lit(str(width)).cast("decimal(38,0)")), F.lit(slices))      # null ids come last
    top = met.where(F.col("_before").isNotNull()).withColumn("_block", block.cast("int"))
    earlier = Window.partitionBy("score").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = top.groupBy("score", "_block").agg(F.count("*").alias("_n")) \
        .select("score", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy("score", "_block").orderBy(F.asc_nulls_last("doc_id"), F.desc("weight"), "n_features")
    rank = F.col("_before") + F.col("_earlier") + F.col("_nth")
    top = top.withColumn("_nth", F.row_number().over(inside)).join(blocks, ["score", "_block"]) \
             .select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))
    return top.unionByName(met.where(F.col("_before").isNull()).select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, seed: int = 7, buckets: int = 10_000, percent: int = 25, least_words: int = 20) -> DataFrame:
    """Every document with n_features, weight, score and its rank in the draw (null: not drawn)."""
    context = docs.sparkSession.sparkContext
    corpus_text, target_text = docs.select(utf8("text").alias("text")), target.select(utf8("text").alias("text"))
    head = context.broadcast(head_of(corpus_text, buckets))
    value = context.broadcast(gains(bucket_totals(corpus_text, head), bucket_totals(target_text, head)))
    scored = weights(docs, head, value).withColumn("score", F.col("weight") + noise(seed))
    return ranked(cut_lineage(scored), percent, least_words)
