"""Retrieval counts each text once, inside its row."""
import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from codestrata.functions import text, vectors
from codestrata.operators import retrieval


def counted(spark, rows, column):
    """The rows, and an accumulator of how often ``column`` was computed."""
    seen = spark.sparkContext.accumulator(0)

    def same(value):
        seen.add(1)
        return value
    return rows.withColumn(column, F.udf(same, rows.schema[column].dataType).asNondeterministic()(column)), seen


WORDS = "getHTTPServer aB1cD x2Y été K9 foo_bar FOO"


def parts(value):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", value))]


def test_word_parts_and_hashed_counts(spark):
    rows = spark.createDataFrame([(1, WORDS), (2, ""), (3, None), (4, "KKİ a\U0001f600b")], "id int, s string").coalesce(1)
    got = {r.id: r for r in rows.select("id", text.word_parts(F.col("s")).alias("w"), text.word_total(F.col("s")).alias("n"), vectors.hashed_counts(F.col("s")).alias("v")).collect()}
    for key, value in ((1, WORDS), (2, ""), (4, "KKİ a\U0001f600b")):
        total = [0.0] * 64
        for w in parts(value):
            total[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        assert got[key].w == parts(value) and got[key].n == len(parts(value)) and got[key].v == total
    assert got[3].w is None and got[3].v is None


def test_lexical_scores_by_plain_count_with_repeated_and_empty_chunks(spark):
    bodies = [("c1", "alpha beta alpha"), ("c2", "alphaBeta gamma"), ("c3", None), ("c1", "alpha beta alpha"), ("c4", "delta delta")]
    chunks = spark.createDataFrame([("a", c, t, "p.py", "Sym") for c, t in bodies], "analysis_id string, chunk_id string, text string, path string, symbol string")
    asked = {"q1": "alpha gamma?", "q2": "beta Sym", "q3": "nothing"}
    requests = spark.createDataFrame([(q, "a", t) for q, t in asked.items()], "request_id string, analysis_id string, question string")
    words = [(c, parts(" ".join(x for x in (t, "p.py", "Sym") if x is not None))) for c, t in bodies]
    mean, n, tf = sum(len(w) for _, w in words) / len(words), len(words), Counter()
    size = {c: len(w) for c, w in words}
    for c, w in words:
        tf.update((c, x) for x in w)
    expected = {}
    for q, t in asked.items():
        for term in set(parts(t)):
            df = len({c for c, x in tf if x == term})
            for c in size:
                if (c, term) in tf:
                    f = tf[c, term]
                    expected[q, c] = expected.get((q, c), 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[c] / mean))
    got = {(r.request_id, r.chunk_id): r.score for r in retrieval.lexical_topk(requests, chunks).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-5 for k in got)


def test_vectors_are_computed_once(spark):
    items = spark.createDataFrame([("a", "m", i, [float(i % 3), 1.0]) for i in range(40)], "analysis_id string, embedding_config string, item_id int, embedding array<double>")
    items, seen = counted(spark, items, "embedding")
    asked = spark.createDataFrame([("q", "a", "m", [1.0, 0.0])], "request_id string, analysis_id string, embedding_config string, embedding array<double>")
    best = retrieval.vector_topk(asked, items, 3).collect()
    assert {r.item_id for r in best} == {2, 5, 8} and seen.value == 40
