import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from codestrata.llm import exact_dedup, jaccard_join
from codestrata.llm.components import components

ODD = [(1, None), (2, ""), (3, "Same TEXT"), (4, "same text"), (4, "same text"), (None, "sAme text"), (None, "lonely"), (None, None), (5, "É"), (6, "é"), (7, "L" * 50_000), (8, "l" * 50_000)]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_filter_holds_its_keys_and_rejects_most_others():
    draw = np.random.default_rng(9)
    for number in (0, 1, 2, 10, 1000, 60_000):
        keys = draw.integers(0, 1 << 63, number, np.uint64)
        made = exact_dedup.BinaryFuseFilter.build(keys)
        assert made.contains(keys).all()
        assert made.contains(draw.integers(0, 1 << 63, 20_000, np.uint64)).mean() < 0.02
    assert len(made.fingerprints) < 60_000 * 1.4


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lowered(t), []).append(i)
    wanted, kept = Counter(), set()
    for i, t in rows:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        first = i == keep and lowered(t) not in kept
        if first:
            kept.add(lowered(t))
        wanted[(i, keep, len(ids), first, hashlib.sha256(lowered(t).encode()).hexdigest())] += 1
    return wanted


def test_exact_groups_agree_with_plain_grouping(odd_rows):
    draw = random.Random(10)
    rows = ODD + [(100 + i, f"text {draw.randrange(120)}") for i in range(200)]
    docs = odd_rows(rows)
    for batches in (1, 4):
        found = exact_dedup.dedup(docs, exact_dedup.by_arrival(docs, batches))
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in found.collect()) == plain_exact(rows)
    left = exact_dedup.keep_one(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, lowered(r.text)) for r in left.collect()) == Counter({(i, lowered(t)): 1 for i, t in rows if any(k[0] == i and k[3] for k in plain_exact([r for r in rows if lowered(r[1]) == lowered(t)]))})
    assert exact_dedup.dedup(odd_rows([]), F.lit(0)).count() == 0


def shingles(text):
    words = lowered(text).split()          # plain spaces only in these texts
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(ids.get(root(i), doc_id), doc_id)
    return Counter((doc_id, len(sets[i]), ids.get(root(i), doc_id) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def varied(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"n{draw.randrange(10 ** 6)}"
    return words


def test_components_follow_every_kind_of_link(odd_rows):
    draw = random.Random(11)
    rows = [*ODD, (9, "few words"), (10, "Few  words"), (11, "one"), (12, "   ")]
    common = [f"p{i}" for i in range(60)]           # a passage that many documents share
    for group in range(14):
        size = draw.choice([6, 8, 9, 10, 12, 14, 40, 120])
        base = [f"g{group}w{draw.randrange(500)}" for _ in range(size)]
        for _ in range(draw.randint(2, 7)):
            words = varied(draw, base, draw.choice([0, 0, 1, 1, 2]))
            if draw.random() < 0.3:
                words = words[:-1] if draw.random() < 0.5 else [*words, f"e{draw.randrange(9)}"]
            rows.append((1000 - len(rows), " ".join(words)))
    rows += [(2000 + i, " ".join([*(f"u{i}x{k}" for k in range(draw.choice([5, 30]))), *common])) for i in range(25)]
    found = jaccard_join.groups(odd_rows(rows))
    assert Counter(tuple(r) for r in found.collect()) == plain_groups(rows)


def test_small_sets_meet_by_subsets(odd_rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "boundary", lambda histogram: 10)
    draw = random.Random(12)
    rows = []
    for group in range(25):
        base = [f"g{group}w{k}" for k in range(draw.randint(5, 15))]
        for _ in range(4):
            cut = draw.randint(0, 2)
            rows.append((len(rows), " ".join(varied(draw, base[:len(base) - cut] if len(base) - cut > 4 else base, draw.choice([0, 0, 1])))))
    found = jaccard_join.groups(odd_rows(rows))
    assert Counter(tuple(r) for r in found.collect()) == plain_groups(rows)


def test_costs_draw_the_boundary():
    assert jaccard_join.boundary({}) == 0
    assert jaccard_join.boundary({3: 1000, 200: 10}) >= 3
    assert jaccard_join.boundary({12: 1000}) < 12
    for n in range(1, 60):
        for m in jaccard_join.partners(n):
            c = jaccard_join.needed(n, m)
            assert 4 * c >= 3 * (n + m - c) and 4 * (c - 1) < 3 * (n + m - c + 1)


def test_near_copies_leave_one_and_rows_without_words_stay(odd_rows):
    text = " ".join(f"w{i}" for i in range(40))
    docs = odd_rows([(1, None), (2, None), (5, text), (6, text + " more"), (7, "other words of their own here"), (None, "nobody has an id here at all")])
    left = jaccard_join.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 2, 5, 7, None]
    assert jaccard_join.groups(odd_rows([])).count() == 0


def test_chains_become_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components(chain).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_an_id_with_two_texts_loses_no_group(odd_rows):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(5, " ".join(a)), (7, " ".join(a + ["more"])), (None, " ".join(a + ["more"])), (3, " ".join(b)), (5, " ".join(b + ["more"])), (None, "c d e f g h"), (None, "c d e f g h"), (9, None), (9, "")]
    kept = jaccard_join.keep_one(odd_rows(rows)).select("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([rows[0], rows[3], rows[5], rows[7], rows[8]], key=str)


def test_only_shingles_the_sample_meets_twice_are_common(odd_rows, monkeypatch):
    texts = [(i, f"same words in every line {i} x{i} y{i} z{i}") for i in range(30)]
    _, (shingles, levels) = jaccard_join.sizes_of(odd_rows(texts))
    assert len(shingles) == 1 and levels.tolist() == [4]
    assert jaccard_join.level_of(np.array([shingles[0], 1], np.uint64), (shingles, levels)).tolist() == [4, 0]
    monkeypatch.setattr(jaccard_join, "SAMPLE_DOCUMENTS", 0)
    _, (none, _) = jaccard_join.sizes_of(odd_rows(texts))
    assert len(none) == 0


def test_ids_of_any_width_fall_into_batches(odd_rows):
    rows = [(i, f"t{i % 3}") for i in (-2**63, -2**62, -5, 0, 7, 2**62, 2**63 - 1)] + [(None, "t0")]
    docs = odd_rows(rows)
    batches = [r.g for r in docs.select("doc_id", exact_dedup.by_arrival(docs, 4).alias("g")).orderBy("doc_id").collect()]
    assert batches[0] is None and batches[1:] == sorted(batches[1:]) and set(batches[1:]) == {0, 1, 2, 3}
    kept = {r.doc_id for r in exact_dedup.keep_one(docs).collect()}
    want = {max((i for i, t in rows if i is not None and t == text)) for text in {t for _, t in rows}}
    assert kept == want


def test_documents_that_share_less_than_a_link_needs_are_not_paired(spark, monkeypatch):
    """Passages that the sample takes for rare: their lists are long, but no pair comes of them, and lists of equal members are one."""
    monkeypatch.setattr(jaccard_join, "SAMPLE_DOCUMENTS", 0)
    made, seen = jaccard_join.meeting_pairs, []

    def counted(rows):
        met = made(rows)
        seen.append((rows.count(), met.count()))
        return met
    monkeypatch.setattr(jaccard_join, "meeting_pairs", counted)
    passage = [f"p{k}" for k in range(12)]
    rows = [(i, " ".join([*(f"u{i}x{k}" for k in range(48)), *passage])) for i in range(40)]
    rows += [(100 + i, " ".join([*(f"v{k}" for k in range(60)), f"w{i}"])) for i in range(3)]
    found = jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(tuple(r) for r in found.collect()) == plain_groups(rows)
    assert seen[0][0] <= 43 and seen[0][1] == 0


def test_pairs_that_share_enough_on_open_lists_always_meet(spark):
    draw = random.Random(5)
    sizes = {node: draw.choice([8, 10, 13]) for node in range(40)}
    lists = {node: draw.sample(range(18), jaccard_join.prefix_length(n)) for node, n in sizes.items()}
    rows = [(token, node, sizes[node], place) for node, tokens in lists.items() for place, token in enumerate(sorted(tokens))]
    near = jaccard_join.near_on_lists(spark.createDataFrame([*rows, *rows[:9]], "token long, node long, n long, place long"))
    kept = [r.asDict() for r in near.collect()]
    assert len(kept) == len({(r["token"], r["node"]) for r in kept})
    ranked = []
    for node in sizes:
        total = 0
        own = sorted((r for r in kept if r["node"] == node), key=lambda r: (r["length"], r["token"]))
        for r in own:
            ranked.append((r["token"], node, r["n"], r["place"], node, total + 1, sum(x["weight"] for x in own)))
            total += r["weight"]
    met = jaccard_join.meeting_pairs(spark.createDataFrame(ranked, "token long, node long, n long, place long, component long, rank long, tokens long"))
    met = {(r["node"], r["other"]) for r in met.collect()}
    for a in sizes:
        for b in range(a + 1, len(sizes)):
            n, m = sizes[a], sizes[b]
            tail = -(-3 * max(n, m) // 4)
            common = set(sorted(lists[a])[:max(0, n - tail + 1)]) & set(sorted(lists[b])[:max(0, m - tail + 1)])
            if 4 * n >= 3 * m and 4 * m >= 3 * n and len(common) >= jaccard_join.needed(n, m) - tail + 1:
                assert (a, b) in met
