import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from codestrata.llm import packing, token_files
from codestrata.llm.common import shared_folder
from codestrata.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [(5, "Some words, and SOME more."), (5, "Some words, and SOME more."), (None, "no id"), (3, None), (1, ""), (9, "tail " * 900),
         (2, "it's <|endoftext|> naïve Straße 12ab \x1c ...?! \u0301x"), (7, "x" * 5000), (8, "\n \t "), (4, "b")]


def library_ids(texts):
    made = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array(e.ids, "<u4") for e in made]


def test_words_one_by_one_give_the_ids_of_whole_texts():
    draw = random.Random(1)
    alphabet = "abcXYZéÉßÿÀ.,;:!?'\"-_0123\u0301\u00ad<|>漢İΣ \n\x85"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(80))) for _ in range(800)] + [t or "" for _, t in TEXTS]
    own = WordEncoder(PATH).encode([t.encode() for t in texts])
    assert own == [x.tobytes() for x in library_ids(texts)]


def test_simplified_texts_keep_their_ids_and_words_are_one_entry():
    draw = random.Random(2)
    pieces = ["Wort", "été", "É", "ÿ", "X1", "22", ".", ",", "!", "?", ":", ";", "#", "&&&", "'s", "'T", "'", '"', "_", "<|", "|>", "<|ENDOFTEXT|>",
              "<|endoftext|>", "×", "÷", "»", "\u00a0", "\x1c", "\x1f", "\x00", "J\u030c", "I\u0307", "\u212a", " ", " ", " ", "\n", "\t"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(25))) for _ in range(6000)]
    encoder = WordEncoder(PATH)
    assert encoder.encode([t.encode() for t in texts]) == [x.tobytes() for x in library_ids(texts)]
    encoder = WordEncoder(PATH)
    encoder.encode([b"Words, words. WORDS!", b"Two; words"])
    assert set(encoder) == {b"words", b"two", b",", b".", b"!", b";"}


def exact_bins(items, capacity):
    """Fewest bins by trying every placement."""
    best = [len(items)]

    def place(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[at] <= capacity and bins[i] not in bins[:i]:
                place(at + 1, [*bins[:i], bins[i] + items[at], *bins[i + 1:]])
        place(at + 1, [*bins, items[at]])
    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases_and_always_complete():
    draw = random.Random(2)
    for _ in range(60):
        capacity = draw.choice([10, 17, 30])
        items = sorted((draw.randint(1, capacity) for _ in range(draw.randint(0, 9))), reverse=True)
        counts = np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, np.int64)
        plan = packing.bin_completion(counts)
        used = Counter()
        for filling, times in plan:
            assert sum(s * n for s, n in filling) <= capacity
            used.update({s: n * times for s, n in filling})
        assert dict(used) == {s: int(n) for s, n in enumerate(counts) if n}
        assert packing.lower_bound(counts) <= sum(n for _, n in plan) == (exact_bins(items, capacity) if items else 0)


def test_narrow_lists_lose_no_filling():
    """With lists of one filling at first, the search still ends where wide lists end."""
    draw = np.random.default_rng(12)
    for _ in range(150):
        capacity = int(draw.choice([20, 30, 60]))
        counts = np.bincount(draw.integers(max(1, capacity // 10), capacity * 7 // 10, int(draw.integers(8, 24))), minlength=capacity + 1)
        wide = packing.bin_completion(counts, branches=10_000, effort=10**6, nodes=300)
        narrow = packing.bin_completion(counts, branches=1, effort=1, nodes=20_000)
        assert sum(n for _, n in narrow) <= sum(n for _, n in wide)
        held = np.zeros_like(counts)
        for filling, number in narrow:
            assert sum(size * times for size, times in filling) <= capacity
            for size, times in filling:
                held[size] += times * number
        assert (held == counts).all()


def test_bin_completion_beats_best_fit():
    counts = np.zeros(101, np.int64)
    for size, number in ((34, 50), (33, 50), (51, 20), (48, 30), (27, 30), (11, 9)):
        counts[size] = number
    assert sum(n for _, n in packing.bin_completion(counts)) < sum(n for _, n in packing.best_fit(counts))


def test_search_ends_and_tells_its_bound_where_best_fit_is_optimal_above_the_lower_bound(monkeypatch, caplog):
    counts = np.bincount(2 * np.random.default_rng(3).integers(1, 31, 600), minlength=102)      # even lengths in 101 fill 100
    best = -(-int((counts * np.arange(102)).sum()) // 100)
    assert sum(n for _, n in packing.best_fit(counts)) == best > packing.lower_bound(counts)
    expanded, options = [], packing._undominated

    def counted(left, *rest):
        expanded.append(int(left.sum()))
        assert len(expanded) <= packing.search_nodes(counts)
        return options(left, *rest)
    monkeypatch.setattr(packing, "_undominated", counted)
    assert sum(n for _, n in packing.bin_completion(counts)) == best
    assert f"{best} bins, lower bound {packing.lower_bound(counts)}" in caplog.text
    # The alternatives of the first bin are tried as well, not those of the last ones only.
    assert sum(n > 0.8 * counts.sum() for n in expanded[200:]) > 20
    assert packing.search_nodes(np.ones(5000, np.int64)) > packing.search_nodes(counts)


def test_packing_holds_every_piece_once(odd_rows, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 2)
    docs = odd_rows(TEXTS)
    rows = packing.pack_documents(docs, PATH, capacity=64).collect()
    wanted = Counter()
    for (doc_id, _), ids in zip(TEXTS, library_ids([t for _, t in TEXTS]), strict=True):
        ids = np.append(ids, 1).astype("<u4")
        for piece, at in enumerate(range(0, len(ids), 64)):
            wanted[(doc_id, piece, at, len(ids[at:at + 64]), zlib.crc32(ids[at:at + 64].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 64
    lengths = np.bincount([r.length for r in rows], minlength=65)
    assert len(sequences) <= sum(n for _, n in packing.best_fit(lengths))
    assert packing.pack_documents(odd_rows([]), PATH).count() == 0


def test_sequences_hold_the_ids(odd_rows):
    texts = [(i, t) for i, (_, t) in enumerate(TEXTS)]
    docs = odd_rows(texts)
    placed = packing.pack_documents(docs, PATH, capacity=64)
    held = sorted(x for r in packing.sequences(docs, placed, PATH).collect() for x in r.ids)
    assert held == sorted(int(x) for ids in library_ids([t for _, t in texts]) for x in [*ids, 1])


def test_bits_round_trip():
    draw = np.random.default_rng(3)
    for bits in range(1, 33):
        ids = draw.integers(0, 1 << bits, 1000, np.uint64).astype("<u4")
        packed = token_files.pack_bits(ids, bits)
        assert len(packed) == -(-1000 * bits // 8)
        assert (token_files.unpack_bits(packed, 1000, bits) == ids).all()


def test_files_round_trip_in_order_with_random_access(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    docs = odd_rows(TEXTS)
    manifest = token_files.write(docs, PATH, 2, shared_folder(spark, "test"))
    rows = sorted(token_files.read(manifest).collect(), key=lambda r: r.start)
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, every = 0, []
    for row, (doc_id, text) in zip(rows, order, strict=True):
        ids = np.append(library_ids([text])[0], 2).astype("<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        every.append(ids)
    every, draw = np.concatenate(every), random.Random(4)
    for file in manifest.collect():
        reader = token_files.Reader(file.uri)
        assert reader.bits == 16 and reader.total == file.n_tokens
        for _ in range(20):
            a, b = sorted(draw.randrange(reader.total + 1) for _ in range(2))
            assert (reader.read(a, b) == every[file.first + a:file.first + b]).all()
    assert token_files.encode_and_read(spark, odd_rows([]), PATH).count() == 0
