import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codestrata.llm import binary_packing, collocations, importance
from codestrata.llm.common import shared_folder
from codestrata.llm.pieces import PieceEncoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# Phrases -------------------------------------------------------------------------------------------------------------

def plain_phrases(rows, longest, least, percent, top):
    """Every count by a loop over all runs of words; scores in Python's whole numbers."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(words)):
                for size in range(1, longest + 1):
                    if i + size <= len(words):
                        f["und" if lang is None else lang][tuple(words[i:i + size])] += 1
    found = []
    for lang, counts in f.items():
        n = sum(c for run, c in counts.items() if len(run) == 1)
        candidates = {run: c for run, c in counts.items() if len(run) > 1 and c >= least}
        listed = []
        for run, a in candidates.items():
            longer = [c for other, c in candidates.items() if len(other) > len(run)
                      and any(other[i:i + len(run)] == run for i in range(len(other)))]
            if any(100 * c >= percent * a for c in longer):
                continue
            cuts = [(1000000 * a * a // (counts[run[:k]] * counts[run[k:]]), k) for k in range(1, len(run))]
            score, k = min(cuts)
            listed.append((-score, -a, " ".join(run).encode(), counts[run[:k]], counts[run[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(listed)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(found)


def phrase_rows(spark, rows, **limits):
    docs = spark.createDataFrame([(lang, text, 1, "x") for lang, text in rows], "lang string, text string, n long, phrase string")
    return sorted(tuple(r) for r in collocations.mine(docs, **limits).collect())


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_equal_a_plain_count(spark, longest):
    draw = random.Random(longest)
    words = ["a", "b", "C", "c", "dé", "É", "x\x01", " ", "漢字", "12", "(e)", "\x1c"]
    rows = [(draw.choice(["en", "fr", None, "und", "a\n b"]),
             "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(draw.randrange(60))))
            for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, None), ("fr", ". , ;"), ("en", "b c b c b c " * 300), ("de", "one")] + [("fr", "a b a b, a")] * 40
    limits = {"longest": longest, "least": 5, "percent": 50, "top": 25}
    assert phrase_rows(spark, rows, **limits) == plain_phrases(rows, **limits)


def test_long_texts_are_cut_where_pieces_end(spark, monkeypatch):
    rows = [("en", "to be or not to be. " * 200), ("en", "be or not" * 90), ("fr", "or not. to be" * 30)]
    monkeypatch.setattr(collocations, "SLICE", 64)
    spans = []

    class Batch:
        def column(self, i):
            import pyarrow as pa
            return pa.array([[lang.encode() for lang, _ in rows], [text.encode() for _, text in rows]][i], pa.binary())
    for lang, text in collocations.slices([Batch()]):
        spans.append((lang.decode(), text.decode()))
    assert len(spans) > 20 and len(max((t for _, t in spans), key=len)) < 1000
    limits = {"longest": 3, "least": 5, "percent": 50, "top": 25}
    assert plain_phrases(spans, **limits) == plain_phrases(rows, **limits) == phrase_rows(spark, rows, **limits)


def test_phrases_of_an_empty_table_and_of_large_counts(spark):
    assert phrase_rows(spark, []) == []
    rows = [("en", None)] * 3
    assert phrase_rows(spark, rows) == []


def test_quicksort_abandons_rare_partitions_and_keeps_key_order(monkeypatch):
    monkeypatch.setattr(collocations, "SMALL", 8)
    draw = np.random.default_rng(3)
    for least in (1, 2, 7):
        columns = [draw.integers(0, 6, 500) for _ in range(3)]
        weights = draw.integers(1, 4, 500)
        want = Counter()
        for key, w in zip(zip(*(c.tolist() for c in columns), strict=True), weights.tolist(), strict=True):
            want[key] += w
        at, sums = collocations.equal_partitions(columns, weights, least)
        got = [tuple(int(c[i]) for c in columns) for i in at]
        assert got == sorted(got) and dict(zip(got, sums.tolist(), strict=True)) == {k: n for k, n in want.items() if n >= least}


# Draws ---------------------------------------------------------------------------------------------------------------

def plain_draw(docs, target, seed=7, buckets=10_000, percent=25, least_words=20):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return words, [zlib.crc32(w.encode()) % buckets for w in words] + \
                      [zlib.crc32(f"{a} {b}".encode()) % buckets for a, b in zip(words, words[1:], strict=False)]
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows, standing = [], []
    for doc_id, text in docs:
        words, met = features(text)
        weight = sum(gain[b] for b in met) // len(met) if met else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(met), weight, score, None])
        if len(words) >= least_words:
            standing.append(rows[-1])
    order = sorted(standing, key=lambda r: (-r[3], math.inf if r[0] is None else r[0], -r[2], r[1]))
    for rank, row in enumerate(order[:percent * len(standing) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=str)


def drawn(spark, docs, target):
    left = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, rank long, score long, a string")
    right = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    found = importance.resample(left, right).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted((tuple(r) for r in found.collect()), key=str)


def made_docs(number, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÀB", "漢", "x_y", "The", "THE"]
    return [(draw.choice([i, i * 2**57 - 2**62]), "".join(draw.choice(words) + draw.choice([" ", "\n", "--", "é ", " "])
             for _ in range(draw.randrange(70)))) for i in range(number)]


@pytest.mark.parametrize("head", [True, False])
def test_draw_equals_a_plain_count(spark, monkeypatch, head):
    if not head:      # every feature by direct CRC
        monkeypatch.setattr(importance, "HEAD_WORDS", 1)
        monkeypatch.setattr(importance, "HEAD_PAIRS", 0 + 1)
    monkeypatch.setattr(importance, "RANKED_TOGETHER", 1)
    docs = made_docs(60, 4) + [(None, "w1 w2 " * 20), (None, None), (77, ""), (77, "w3 " * 30), (77, "w3 " * 30), (5, None)]
    target = ["w1 w2 w3 w4 été", None, "", "w5 the the"]
    assert drawn(spark, docs, target) == plain_draw(docs, target)


def test_draw_of_one_score_is_ranked_by_id_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANKED_TOGETHER", 3)
    scored = spark.createDataFrame([(i, 20, 39, 0, 5) for i in range(-20, 20)] + [(100, 20, 39, 0, 9), (1, 2, 3, 0, 99)],
                                   "doc_id long, n_words long, n_features long, weight long, score long")
    found = {r.doc_id: r["rank"] for r in importance.ranked(scored, 50, 20).collect() if r.n_words == 20 and r["rank"]}
    assert found == {100: 1} | {i: n for n, i in enumerate(range(-20, -1), 2)}


def test_draw_of_empty_tables(spark):
    assert drawn(spark, [], ["w1"]) == []
    docs = made_docs(12, 9)
    assert drawn(spark, docs, []) == plain_draw(docs, [])


def test_parts_of_long_texts_lose_no_feature(monkeypatch):
    text = b"Ab cd-ef " * 50 + b"x" * 300
    head = importance.Head([b"ab", b"cd"], [(b"ab", b"cd")], 1000)
    whole = [head.features(p, n == 0) for n, p in enumerate(importance.word_parts(text))]
    monkeypatch.setattr(importance, "PART", 16)
    parts = [head.features(p, n == 0) for n, p in enumerate(importance.word_parts(text))]
    assert len(whole) == 1 and len(parts) > 10
    assert sorted(np.concatenate(whole)) == sorted(np.concatenate(parts))
    words = importance.WORD_BYTES and text.translate(importance.WORD_BYTES).split()
    assert sorted(whole[0]) == sorted([zlib.crc32(w) % 1000 for w in words] + [zlib.crc32(a + b" " + b) % 1000 for a, b in zip(words, words[1:], strict=False)])


def test_counts_forget_the_rare_first():
    counts = Counter({f"k{i}": 1 for i in range(importance.HELD)} | {"often": 9, "twice": 2})
    assert importance.without_rare(counts) == Counter({"often": 9, "twice": 2})


# Pieces of binary length ---------------------------------------------------------------------------------------------

def byte_ids(texts):
    made = Tokenizer.from_file(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*e.ids, 0] for e in made]


def test_pieces_one_by_one_give_the_ids_of_whole_texts():
    draw = random.Random(5)
    alphabets = ["abcXYZéÉßÿÀªµ.,;:!?'\"-_0123²½|\n\x85\xa0\x1c\t     ", "abcé漢İΣ́­ .,\n  '　​①", "ab 's're'll <|endoftext|>"]
    texts = ["".join(draw.choice(a) for _ in range(draw.randrange(70))) for a in alphabets for _ in range(1500)]
    texts += ["", " ", "  ", "foo <|endoftext|> bar", "x" * 3000, "a  b   c ", "it's 'S 'll", "\n\n a"]
    own = PieceEncoder(BYTES).encode([t.encode() for t in texts])
    assert [[*np.frombuffer(x, "<u4").tolist(), 0] for x in own] == byte_ids(texts)


def test_binary_lengths_are_powers_of_two_and_cover_everything():
    for tokens in range(1, 3000):
        lengths = binary_packing.binary_lengths(tokens, 1024)
        assert sum(lengths) == tokens and lengths == sorted(lengths, reverse=True)
        assert all(n & (n - 1) == 0 for n in lengths) and len([n for n in lengths if n < 1024]) == len({n for n in lengths if n < 1024})


DOCS = [(5, "Some words, and SOME more."), (5, "Some words, and SOME more."), (None, "no id"), (None, None), (1, ""), (9, "tail " * 2500), (4, "b"), (4, "漢 b")]


def test_every_id_lies_in_one_piece_and_buckets_are_ranges(spark, odd_rows):
    rows = binary_packing.pack_documents(odd_rows(DOCS), BYTES, 64).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and {r.offset for r in rows} == {0}
    by_id = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by_id] == sorted((r.length for r in rows), reverse=True)
    want = Counter()
    for (doc_id, _), ids in zip(DOCS, byte_ids([t for _, t in DOCS]), strict=True):
        start = 0
        for length in binary_packing.binary_lengths(len(ids), 64):
            part = np.array(ids[start:start + length], "<u4").tobytes()
            want[(doc_id, start, length, zlib.crc32(part), len(ids))] += 1
            start += length
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want


def test_written_buckets_hold_the_ids(spark, odd_rows):
    found = binary_packing.write_buckets(odd_rows(DOCS).repartition(3), BYTES, shared_folder(spark, "buckets"), 64).collect()
    for r in found:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))


def test_no_documents_and_wrong_capacity(spark, odd_rows):
    assert binary_packing.pack_documents(odd_rows([]), BYTES).collect() == []
    with pytest.raises(ValueError):
        binary_packing.pieces(odd_rows(DOCS), BYTES, 100, 0)
