import random

import pytest
from pyspark.sql import functions as F

from codestrata.llm import decontaminate, toxicity


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_by_bits_is_the_edit_distance():
    draw = random.Random(13)
    for _ in range(400):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(70))] for _ in range(2))
        assert decontaminate.distance(a, b) == table_distance(a, b)


def plain_matches(rows, items):
    found = {}
    for at, (_, text) in enumerate(rows):
        words = (text or "").lower().split()
        for item, other in items:
            own = (other or "").lower().split()
            if 0 < len(own) < decontaminate.LEAST_WORDS:
                places = [s for s in range(len(words) - len(own) + 1) if words[s:s + len(own)] == own]
                found |= {(at, item): (0, places[0])} if places else {}
            if len(own) < decontaminate.LEAST_WORDS or not words:
                continue
            far = min((table_distance(own, words[s:s + len(own)]), s) for s in range(max(1, len(words) - len(own) + 1)))
            if far[0] <= len(own) // 4:
                found[(at, item)] = far
    return found


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = draw.randrange(len(words)), draw.random()
        if kind < 0.5:
            words[at] = f"z{draw.randrange(1000)}"
        elif kind < 0.75:
            del words[at]
        else:
            words.insert(at, draw.choice(words))
    return words


def test_passages_are_found_as_by_trying_every_window(odd_rows, spark):
    draw = random.Random(14)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of"] * 10
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([8, 9, 12, 20, 33])))) for i in range(12)]
    items += [(50, items[0][1].upper()), (51, "too short"), (52, None), (53, "")]
    rows = [(None, items[1][1]), (7, None), (8, ""), (9, items[2][1]), (9, items[2][1]), (10, "x" * 20_000)]
    for _ in range(60):
        before, after = ([draw.choice(vocabulary) for _ in range(draw.randrange(25))] for _ in range(2))
        own = draw.choice(items[:12])[1].split()
        rows.append((100 + len(rows), " ".join([*before, *(edited(draw, own, draw.randint(0, len(own) // 4)) if draw.random() < 0.7 else []), *after])))
    docs = odd_rows(rows)
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    wanted = plain_matches(rows, items)
    found = decontaminate.matches(docs, benchmark).collect()
    ids = {(str(r.doc_id), r.item_id): (r.distance, r.start_word) for r in found}
    for (at, item), best in wanted.items():
        if best[0] <= len((dict(items)[item]).split()) // 8:
            assert ids[(str(rows[at][0]), item)][0] == best[0]
    truth = {(str(rows[at][0]), item) for at, item in wanted}
    assert set(ids) <= truth and len(ids) >= 0.95 * len(truth)
    clean = decontaminate.keep_clean(docs, benchmark)
    dropped = {str(i) for i, _ in ids}
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if str(i) not in dropped)
    assert decontaminate.matches(odd_rows([]), benchmark).count() == 0
    assert decontaminate.matches(docs, benchmark.limit(0)).count() == 0


def test_documents_shorter_than_an_item_are_one_window(odd_rows, spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = odd_rows([(1, " ".join(f"w{i}" for i in range(16))), (2, " ".join(f"w{i}" for i in range(12)))])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.n_words, r.distance) for r in decontaminate.matches(docs, benchmark).collect()] == [(1, 16, 4)]


@pytest.fixture(scope="module")
def labelled(spark, odd_rows):
    draw = random.Random(15)
    plain = ["".join(draw.choice(["ba", "lo", "mi", "ter", "una"]) for _ in range(draw.randint(1, 3))) for _ in range(150)]
    rows, labels = [], []
    for i in range(400):
        words, toxic = [draw.choice(plain) for _ in range(draw.randint(15, 60))], i % 4 == 0
        for _ in range(5 * toxic):
            words[draw.randrange(len(words))] = "grunk" + draw.choice(["", "er", "ly", "est"]) if draw.random() < 0.7 else "Vexil!"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), "x"))
    rows += [(1000, None), (1001, ""), (1002, "123 ... !"), (None, "grunker grunk vexil vexil grunkly"), (5, "una loba"), (1003, "grunkest " * 3000)]
    labels += [(9999, 1, "x"), (None, 1, "x"), (7, None, "x"), (8, 5, "x")]
    return odd_rows(rows), spark.createDataFrame(labels, "doc_id long, toxic int, text string"), rows


def test_held_out_texts_are_told_apart(labelled):
    docs, labels, rows = labelled
    found = toxicity.score(docs, labels, toxicity.hashed_third()).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 400]
    right = sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in held)
    assert len(held) > 100 and right / len(held) > 0.97
    scores = {r.doc_id: r.score for r in found}
    assert scores[None] >= 0.7 and scores[1003] >= 0.7
    assert scores[1000] == scores[1001] < 0.7 and scores[1002] < 0.7


def test_held_out_labels_teach_nothing(labelled):
    docs, labels, _ = labelled
    held = toxicity.hashed_third()
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({(r.doc_id, r.text_hash): round(r.score, 9) for r in toxicity.score(docs, x, held).collect()} for x in (labels, turned))
    assert one == two


def test_toxic_rows_leave_and_no_labels_accept_all(labelled, odd_rows):
    docs, labels, rows = labelled
    left = toxicity.keep_accepted(docs, labels, toxicity.hashed_third())
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    assert None not in ids and {1000, 1001, 1002, 5} <= ids and len(ids & {i for i in range(400) if i % 4}) > 290
    assert toxicity.keep_accepted(docs, labels.limit(0), toxicity.hashed_third()).count() == len(rows)
    assert toxicity.score(odd_rows([]), labels, toxicity.hashed_third()).count() == 0


def test_shared_lower_orders_keep_rare_expressions_near_zero(labelled):
    docs, labels, _ = labelled
    train = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter("toxic IN (0, 1)").select(
        "toxic", F.lit(0).alias("fold"), F.col("text").cast("binary").alias("text"))
    model = toxicity.fit(toxicity.train_counts(train))[0]
    telling, unknown, plain = model.of_words(["grunkish", "xyzzy", "loba"])
    assert telling > 2 > max(abs(unknown), abs(plain))


def test_a_rare_toxic_class_is_learnt_from_in_full(odd_rows, spark):
    texts = [(i, f"you vile rotten fool number {i}" if i % 150 == 0 else f"a calm walk in the green park on day {i}") for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i % 150 == 0)) for i, _ in texts], "doc_id long, toxic int")
    found = toxicity.score(odd_rows(texts), labels, toxicity.hashed_third(), most_texts=30).collect()
    toxic, clean = ([r.score for r in found if r.held_out and (r.doc_id % 150 == 0) == kind] for kind in (True, False))
    assert toxic and min(toxic) > max(clean)
    assert toxicity.sampling_shares({0: 10**6, 1: 10}, 30) == {0: 20 / 10**6, 1: 1.0}
    assert toxicity.sampling_shares({0: 10**6, 1: 10**5}, 8000) == {0: 0.004, 1: 0.04}
    assert toxicity.sampling_shares({0: 3000, 1: 900}, 8000) == {0: 1.0, 1: 1.0}


def test_short_items_match_by_equality(odd_rows, spark):
    items = [(1, "One two THREE"), (2, "one two three"), (3, "alone"), (4, "a b c d e f g"), (5, None), (6, "  ")]
    rows = [(1, "zero one TWO three one two three"), (2, "one two"), (2, "three"), (3, "x alone"), (4, "a b c d e f"), (5, "g a b c d e f g"), (None, "alone"), (6, None)]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id, r.start_word, r.n_words, r.distance) for r in decontaminate.matches(odd_rows(rows), benchmark).collect()}
    assert found == {(1, 1, 1, 3, 0), (1, 2, 1, 3, 0), (3, 3, 1, 1, 0), (None, 3, 0, 1, 0), (5, 4, 1, 7, 0)}
    assert sorted(r.text or "" for r in decontaminate.keep_clean(odd_rows(rows), benchmark).collect()) == ["", "a b c d e f", "one two", "three"]


def test_missing_recall_is_an_error(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_TABLES", 1)
    try:
        decontaminate.tables_needed([40], 0.25, 0.999)
    except ValueError as error:
        assert "8 tables" in str(error)
    else:
        raise AssertionError
