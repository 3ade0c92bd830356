"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Two models, of toxic and of ordinary training texts, predict each character of a word from the seven before it. Only the
highest order differs: what it discounts goes to one shared model of lower orders, built from continuation counts of both
classes, so an expression too rare to tell scores near zero on either side, and an unseen form of a known stem still counts.

A word's evidence is the difference of its two log-likelihoods. A text's is its evidence per word, that of its most telling
words, and what exceeds a level that chance seldom reaches, beside the text's length in words. A logistic curve, fitted on
training texts that were scored by models without them, turns these into a score from 0 to 1.

The models and the curve are fitted on at most ``most_texts`` labelled texts, chosen by a hash; all texts are scored.

Results for odd input: null and empty texts have no evidence and get the curve's value at zero, texts without letters differ
from them by their length alone;
labels that are null or other than 0 and 1, or whose document is missing, teach nothing; a document labelled twice counts
twice; without training texts of both classes every score is 0; repeated or null doc_ids are scored row by row; columns
besides doc_id, text and toxic are not read.
"""
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage, giving_back, utf8, utf8_slices

ORDER = 8
DISCOUNT = 0.75
START, END = "\x02", "\x03"
LETTERS = re.compile(r"[^\W\d_]+")
LEVELS = (1.0, 2.0)
FEATURES = ["highest", "highest_3", "highest_6", "above_1", "above_2", "mean", "words"]
KNOWN_WORDS = 300_000
MOST_TEXTS = 8_000
LEAST = 2                      # grams of the longer orders that came up less often leave their share to the order below
SHORT = 4                      # up to this order all grams are kept
COUNTS = ["ordinary_0", "ordinary_1", "toxic_0", "toxic_1"]      # by class and fold
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, ORDER + 1)], np.uint64)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the padded words one after another, and the length of each padded word."""
    padded = [START * (ORDER - 1) + w + END for w in words]
    return np.frombuffer("".join(padded).encode("utf-32-le"), "<u4").astype(np.uint64), np.array([len(w) for w in padded], np.int64)


def _keys(codes: np.ndarray, size: int) -> np.ndarray:
    """Key of the ``size`` characters that end at each place; the first ORDER - 1 places are not to be used."""
    total = np.full(len(codes), size, np.uint64)
    for back in range(size):
        total[back:] += (codes[:len(codes) - back] + np.uint64(7)) * POWERS[back]
    return (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Level:
    """One order: discounted share of each gram and the share that each history leaves to the order below."""

    def __init__(self, grams: np.ndarray, histories: np.ndarray, counts: np.ndarray, known: np.ndarray, totals: np.ndarray):
        there = counts > 0
        grams, histories, counts = grams[there], histories[there], counts[there].astype(float)
        where = np.searchsorted(known, histories)
        share = np.maximum(counts - DISCOUNT, 0) / totals[where]
        left = 1 - np.bincount(where, share, len(known))
        some = left < 1
        self.histories, self.left = known[some], left[some].astype(np.float32)
        order = np.argsort(grams)
        self.grams, self.share = grams[order], share[order].astype(np.float32)

    def probability(self, grams: np.ndarray, histories: np.ndarray, below: np.ndarray) -> np.ndarray:
        def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
            if not len(keys):
                return np.full(len(wanted), otherwise)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, values[at], otherwise)
        return find(self.grams, self.share, grams, 0.0) + find(self.histories, self.left, histories, 1.0) * below


class Model:
    """Evidence of words: log-likelihood among toxic texts less that among ordinary ones."""

    def __init__(self, shared: list[Level], toxic: Level, ordinary: Level):
        self.shared, self.toxic, self.ordinary = shared, toxic, ordinary
        self.known: dict[bytes, float] = {}

    def of_words(self, words: list[str]) -> np.ndarray:
        codes, lengths = _codes(words)
        ends = np.cumsum(lengths)
        inside = np.ones(len(codes), bool)
        for back in range(ORDER - 1):
            inside[ends - lengths + back] = False
        at = np.flatnonzero(inside)
        keys = {size: _keys(codes, size) for size in range(1, ORDER + 1)}
        below = np.full(len(at), 1 / 256)
        for size, level in enumerate(self.shared, 1):
            below = level.probability(keys[size][at], keys[size - 1][at - 1] if size > 1 else np.zeros(len(at), np.uint64), below)
        grams, histories = keys[ORDER][at], keys[ORDER - 1][at - 1]
        ratio = np.log(self.toxic.probability(grams, histories, below) / self.ordinary.probability(grams, histories, below))
        word = np.searchsorted(ends, at, "right")
        return np.bincount(word, ratio, len(words))

    def of_texts(self, texts: list[bytes]) -> np.ndarray:
        """FEATURES of each text."""
        split = [text.split() for text in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        new = sorted(set().union(*split).difference(self.known)) if split else []
        runs = [LETTERS.findall(w.decode("utf-8", "replace").lower()) for w in new]
        flat, values = sorted({r for some in runs for r in some}), {}
        for at in range(0, len(flat), 50_000):
            some = flat[at:at + 50_000]
            values.update(zip(some, self.of_words(some).tolist(), strict=True))
        self.known.update((w, max((values[r] for r in some), default=0.0)) for w, some in zip(new, runs, strict=True))
        out = np.zeros((len(texts), len(FEATURES)))
        for row, words in enumerate(split):
            own = np.fromiter(map(self.known.__getitem__, words), float, len(words))
            if len(own):
                top = np.sort(np.partition(own, -6)[-6:] if len(own) > 6 else own)[::-1]
                above = [np.log1p(np.maximum(0, own - level).sum()) for level in LEVELS]
                out[row] = top[0], top[:3].sum() / 3, top.sum() / 6, *above, own.mean(), np.log(len(own))
        return out


def train_counts(rows: DataFrame) -> DataFrame:
    """Counts of character grams of the highest order by class and fold. rows: text (bytes), toxic, fold."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        for some in utf8_slices(batches):
            tables = [Counter() for _ in COUNTS]
            for toxic, fold, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                tables[2 * toxic + fold].update(LETTERS.findall(text.decode("utf-8", "replace").lower()))
            words = sorted(set().union(*tables))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([t[w] for w in words], pa.int64()) for t in tables]], ["word", *COUNTS])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            padded = [START * (ORDER - 1) + w + END for w in batch.column(0).to_pylist()]
            found = [w[i:i + ORDER] for w in padded for i in range(len(w) - ORDER + 1)]
            which = np.repeat(np.arange(len(padded)), [len(w) - ORDER + 1 for w in padded])
            parts = [pa.array(np.asarray(batch.column(i + 1))[which]) for i in range(4)]
            table = pa.table([pa.array(found, pa.string()), *parts], names=["gram", *COUNTS]).group_by("gram").aggregate([(c, "sum") for c in COUNTS])
            yield from table.select(["gram", *[f"{c}_sum" for c in COUNTS]]).rename_columns(["gram", *COUNTS]).to_batches()
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    words = rows.select("toxic", "fold", "text").mapInArrow(giving_back(count), f"word string, {kinds}").groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return words.mapInArrow(giving_back(grams), f"gram string, {kinds}").groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _numbers(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of grams of one size, in order, and their counts; bounded by the bounded sample."""
    names = [c for c in rows.columns if c != "gram"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_pylist()
            codes = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").astype(np.uint64)
            keys = _keys(codes, size)[np.arange(len(grams)) * size + size - 1] if size else np.zeros(len(grams), np.uint64)
            histories = _keys(codes, size - 1)[np.arange(len(grams)) * size + size - 2] if size > 1 else np.zeros(len(grams), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(histories.view(np.int64)), *[c.cast(pa.int32()) for c in batch.columns[1:]]],
                                             ["gram", "history", *names])
    frame = rows.select("gram", *names).mapInArrow(keyed, ", ".join(["gram long, history long", *[f"{n} int" for n in names]])).toArrow()
    return tuple(c.to_numpy() for c in frame.columns)


def _level_numbers(rows: DataFrame, size: int, least: int) -> tuple[np.ndarray, ...]:
    """(gram keys, history keys, counts by column) of the grams kept, and (history keys in order, totals by column)."""
    names = [c for c in rows.columns if c != "gram"]
    pooled = reduce(lambda x, y: x + y, [F.col(n) for n in names])
    before = rows.withColumn("_kept", pooled >= least).groupBy(F.substring("gram", 1, size - 1).alias("gram")).agg(
        *[F.sum(n).alias(n) for n in names], F.max("_kept").alias("_kept")).filter("_kept").drop("_kept")
    grams, histories, *counts = _numbers(rows.filter(pooled >= least), size)
    known, _, *totals = _numbers(before, size - 1)
    order = np.argsort(known.view(np.uint64))
    return grams.view(np.uint64), histories.view(np.uint64), counts, known.view(np.uint64)[order], [t[order] for t in totals]


def fit(counts: DataFrame) -> tuple[Model, Model, Model]:
    """The model of all training texts, and those of fold 1 and of fold 0 alone (each to score the other fold)."""
    top = cut_lineage(counts)
    shared, rows = [], top.select("gram")
    for size in range(ORDER - 1, 0, -1):
        rows = rows.groupBy(F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("types"))
        grams, histories, c, known, totals = _level_numbers(rows, size, 1 if size <= SHORT else LEAST)
        shared.insert(0, Level(grams, histories, c[0], known, totals[0]))
        rows = rows.select("gram")
    grams, histories, c, known, totals = _level_numbers(top, ORDER, LEAST)
    made = []
    for folds in ((0, 1), (1,), (0,)):
        made.append(Model(shared, *[Level(grams, histories, sum(c[k + f] for f in folds), known, np.maximum(1, sum(totals[k + f] for f in folds))) for k in (2, 0)]))
    return tuple(made)


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (last: constant) by Newton's method."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (labels - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features(model_of, rows: DataFrame) -> DataFrame:
    """All columns but the text, and the text's features. The text is the last column."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in utf8_slices(batches):
            found = model_of(some)
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], *map(pa.array, found.T)], [*some.schema.names[:-1], *FEATURES])
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.drop("text").dtypes)
    return rows.mapInArrow(giving_back(score), ", ".join([kinds, *[f"{n} double" for n in FEATURES]]))


def sampling_shares(counts: dict[int, int], most: int) -> dict[int, float]:
    """The share of each class's labels to learn from: half of ``most`` a class, and what the rarer class leaves for the other."""
    numbers = {kind: max(1, counts.get(kind, 0)) for kind in (0, 1)}
    return {kind: min(1.0, max(most / 2, most - numbers[1 - kind]) / numbers[kind]) for kind in (0, 1)}


def score(docs: DataFrame, labels: DataFrame, held_out: Column, most_texts: int = MOST_TEXTS) -> DataFrame:
    """doc_id, text_hash, held_out, score of every row of docs. ``held_out``: rows (by doc_id) whose labels are not learnt from."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), utf8("text").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").filter(~held_out)
    shares = sampling_shares({r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}, most_texts)
    cut = F.when(F.col("toxic") == 1, F.lit(int(shares[1] * 2**40))).otherwise(F.lit(int(shares[0] * 2**40)))
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(2**40)) < cut)
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))
    train = cut_lineage(rows.select("doc_id", "text").join(chosen, "doc_id").select("toxic", "fold", "text"))
    seen = {r[0] for r in train.select("toxic").distinct().collect()}
    if seen != {0, 1}:
        return rows.select("doc_id", "text_hash", held_out.alias("held_out"), F.lit(0.0).alias("score"))
    whole, *apart = fit(train_counts(train))
    shared = spark.sparkContext.broadcast(apart)

    def crossed(some: pa.RecordBatch) -> np.ndarray:
        fold, texts, out = np.asarray(some.column(1)), some.column(2).to_pylist(), np.zeros((some.num_rows, len(FEATURES)))
        for f in (0, 1):
            at = np.flatnonzero(fold == f)
            if len(at):
                out[at] = shared.value[f].of_texts([texts[i] for i in at])
        return out
    fitted = _features(crossed, train).select("toxic", *FEATURES).toPandas()
    seen_features = fitted[FEATURES].to_numpy()
    middle, deviation = seen_features.mean(axis=0), np.maximum(seen_features.std(axis=0), 1e-9)
    weights = logistic((seen_features - middle) / deviation, fitted["toxic"].to_numpy())
    used = spark.sparkContext.broadcast(whole)
    found = _features(lambda some: used.value.of_texts(some.column(some.num_columns - 1).to_pylist()), rows)
    terms = [(F.col(n) - float(m)) * float(w / s) for n, m, s, w in zip(FEATURES, middle, deviation, weights[:-1], strict=True)]
    linear = reduce(lambda a, b: a + b, terms) + float(weights[-1] - np.log(shares[1] / shares[0]))      # the classes' own shares
    return found.select("doc_id", "text_hash", held_out.alias("held_out"), (1 / (1 + F.exp(-linear))).alias("score"))


def hashed_third(name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_accepted(docs: DataFrame, labels: DataFrame, held_out: Column, limit: float = 0.7) -> DataFrame:
    """docs with all columns, without the rows that score ``limit`` or more."""
    found = cut_lineage(score(docs, labels, held_out)).filter(F.col("score") >= limit).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["_d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_h"])
    return docs.join(found, same, "left_anti")
