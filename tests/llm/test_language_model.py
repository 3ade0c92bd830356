import math
import zlib
from collections import Counter

import numpy as np

from codestrata.llm import language_model as lm


def test_base_counts_and_known_words_are_exact_and_classes_help(odd_rows, monkeypatch):
    draw = np.random.default_rng(5)
    left, right = [f"A{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    texts = [(i, " ".join(f"{left[draw.integers(30)]} {right[draw.integers(30)]}" for _ in range(20))) for i in range(200)]
    texts += [(300, None), (301, ""), (None, "a1 never\x0bseen"), (302, "once B1"), (302, "once B1"), (303, "x" * 3000)]
    monkeypatch.setattr(lm, "CHUNK_BYTES", 4000)
    rows = lm.score(odd_rows(texts), lm.hashed_seventh()).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = [(i, (t or "").encode().lower().split() + [b""]) for i, t in texts]
    counts = Counter(w for i, words in split if not held(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    wanted = sorted((str(i), held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in split)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == wanted
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)
    assert all(math.isfinite(r.score) and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in rows)
    assert lm.score(odd_rows([]), lm.hashed_seventh()).count() == 0


def test_a_move_is_the_best_by_full_likelihood(monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 4)
    monkeypatch.setattr(lm, "TOTAL_CLASSES", 6)
    draw = np.random.default_rng(6)
    pairs, classes = draw.integers(0, 9, (12, 12)), np.array([0, 1, 2, 3, 0, 1, 2, 3, 0, 1, 4, 5])

    def table(kinds):
        made = np.zeros((6, 6))
        np.add.at(made, (kinds[:, None].repeat(12, 1), kinds[None].repeat(12, 0)), pairs)
        return made
    for unit in range(10):
        rest = np.arange(12) != unit
        left = np.bincount(classes[rest], pairs[rest, unit], 6)
        right = np.bincount(classes[rest], pairs[unit, rest], 6)
        tried = [lm.likelihood(table(np.where(np.arange(12) == unit, c, classes))) for c in range(4)]
        found = lm.best_class(table(classes), int(classes[unit]), left, right, float(pairs[unit, unit]))
        assert abs(tried[found] - max(tried)) < 1e-6


def test_probabilities_sum_to_one():
    classes = np.concatenate([np.arange(lm.CLUSTERED) % lm.CLASSES, np.arange(lm.CLASSES, lm.TOTAL_CLASSES)])
    mass = np.ones(lm.UNITS) * 3
    table = np.random.default_rng(7).integers(0, 5, (lm.TOTAL_CLASSES, lm.TOTAL_CLASSES)).astype(float)
    steps, emission = lm.model(classes, table, {"mass": mass, "unseen": 0.4})
    assert np.allclose((10 ** steps).sum(1), 1)
    assert np.allclose(np.bincount(classes[:lm.CLUSTERED], 10 ** emission[:lm.CLUSTERED]), 1)


def test_words_below_the_seed_get_classes_too(odd_rows):
    draw = np.random.default_rng(8)
    texts = [(i, " ".join(f"f{w}" for w in draw.permutation(1000))) for i in range(2000, 2020)]
    texts += [(i, " ".join(f"the a{draw.integers(100)} of b{draw.integers(100)}" for _ in range(5))) for i in range(240)]
    rows = [r for r in lm.score(odd_rows(texts), lm.hashed_seventh()).collect() if r.held_out and r.doc_id < 2000]
    # A hundred words after "the" and another hundred after "of", none among the thousand most frequent: knowing which is which halves the choice.
    assert 10 ** (-sum(r.score for r in rows) / sum(r.n_tokens for r in rows)) < 18


def test_classes_of_all_words_are_the_best_by_full_likelihood():
    draw = np.random.default_rng(9)
    classes = draw.integers(0, 4, 300)
    classes[:4] = range(4)
    pairs = draw.poisson(0.4 * (1 + 5 * ((classes[:, None] + classes) % 4 == 1)))
    np.fill_diagonal(pairs, 0)

    def table(kinds):
        made = np.zeros((6, 6))
        np.add.at(made, (kinds[:, None].repeat(300, 1), kinds[None].repeat(300, 0)), pairs)
        return made
    words = [i for i in range(0, 300, 10)]
    held = classes.copy()
    held[words] = 4                                   # these lie in a class of rarer words
    entries = [(w, k, n) for w, i in enumerate(words) for k, n in
               [*enumerate(np.bincount(held, pairs[:, i], 6)), *enumerate(np.bincount(held, pairs[i], 6), 6)] if n]
    row, key, n = (np.array(c) for c in zip(*entries, strict=True))
    found = lm.best_classes(table(held), 4, np.full(len(words), 4), row, key, n)
    one_by_one = [max(range(5), key=lambda c: lm.likelihood(table(np.where(np.arange(300) == i, c, held)))) for i in words]
    assert (found == one_by_one).mean() > 0.9         # pairs with the word's own class are taken as they stand
    after = held.copy()
    after[words] = found
    assert lm.likelihood(table(after)) > lm.likelihood(table(held))
    assert lm.number_of_classes(10) == lm.CLASSES < lm.number_of_classes(10**6) < lm.number_of_classes(10**8)


def test_every_task_gives_its_memory_back(odd_rows, monkeypatch):
    from codestrata.llm.common import giving_back
    given = []
    monkeypatch.setattr(lm, "giving_back", lambda task: given.append(task.__qualname__.split(".")[0]) or giving_back(task), raising=False)
    assert lm.score(odd_rows([(i, f"a b c{i % 3} d") for i in range(30)]), lm.hashed_seventh()).count() == 30
    assert set(given) == {"chunks", "units", "neighbours", "moved", "bigrams", "classified", "score"}


def test_cells_are_counted_in_place_as_numpy_counts_them():
    draw = np.random.default_rng(4)
    for number, kind in ((0, np.uint32), (1, np.int64), (5000, np.uint32), (5000, np.int64)):
        cells = draw.integers(0, 700, number).astype(kind)
        wanted = np.unique(cells, return_counts=True)
        found = lm.runs_of(cells)
        assert all((a == b).all() for a, b in zip(found, wanted, strict=True))
        assert found[0].dtype == kind


def test_words_meet_their_chunks_in_parts_and_not_row_by_row(odd_rows, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 600)
    draw = np.random.default_rng(11)
    texts = [(i, " ".join(f"w{w}" for w in draw.integers(0, 200, 30))) for i in range(60)]
    corpus = lm.chunks(odd_rows(texts), lm.hashed_seventh())
    parts, top, totals = lm.count_words(corpus)
    named = lm.with_units(parts, top)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in texts if not held(i) for w in t.encode().split() + [b""])
    assert sorted(c for r in parts.collect() for c in r.c if c) == sorted(counts.values())
    assert totals["N"] == sum(counts.values()) and totals["V"] == len(counts) and len(top) == len(counts) - 1
    number, kinds = parts.count(), lm.CLASSES + lm.TIERS + 1
    seed = np.concatenate([np.arange(lm.CLUSTERED) % lm.CLASSES, np.arange(lm.CLASSES, kinds)])
    assigned, table = lm.cluster(corpus, parts, named, seed, lm.CLASSES)
    rows = lm.neighbours(corpus, parts, assigned, kinds, True).collect()
    assert 0 < len(rows) <= corpus.count() * (number + 1) < sum(len(r.words) for r in corpus.collect())
    assert table.sum() == totals["N"]
