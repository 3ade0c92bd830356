import random

import corpus_pipeline
from codestrata.llm import toxicity
from codestrata.llm.common import table
from test_duplicates import lowered, plain_exact, plain_groups
from test_filters import edited, plain_matches


def test_stages_take_effect_one_after_another(spark, tmp_path):
    draw = random.Random(16)
    plain = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter") for b in ("na", "ri", "su", "ko", "del")]
    say = lambda n: [draw.choice(plain) for _ in range(n)]
    items = [(i, " ".join(say(20))) for i in range(4)]
    rows, labels = [], []
    for i in range(150):
        words = say(draw.randint(20, 50))
        if i % 5 == 0:
            for _ in range(6):
                words[draw.randrange(len(words))] = "grunk" + draw.choice(["", "er", "ly"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(200 + i, rows[i][1].upper()) for i in range(1, 20)]
    rows += [(300 + i, " ".join(edited(draw, (rows[i][1] + " " + rows[i + 1][1]).split(), 1))) for i in range(21, 24)]
    rows += [(400 + i, " ".join(edited(draw, (rows[i][1] + " " + rows[i + 1][1]).split(), 1))) for i in range(21, 24)]
    rows += [(500 + i, " ".join([*say(15), *edited(draw, items[i][1].split(), 1), *say(9)])) for i in range(4)]
    rows += [(600, None), (601, ""), (None, " ".join(say(30)))]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs = table(spark, folder, "documents")
    scores = toxicity.score(docs, table(spark, folder, "labels"), toxicity.hashed_third()).collect()
    left = [(i, t) for i, t in rows if i not in {r.doc_id for r in scores if r.score >= 0.7}]
    assert 20 < len(rows) - len(left) < 45
    kept = {(k[0], k[4]) for k in plain_exact(left) if k[3]}
    import hashlib
    left = [(i, t) for i, t in left if (i, hashlib.sha256(lowered(t).encode()).hexdigest()) in kept or i is None]
    names = {k[0]: k[2] for k in plain_groups(left)}
    left = [(i, t) for i, t in left if i is None or names[i] == i]
    hit = {at for at, _ in plain_matches(left, items)}
    left = [r for at, r in enumerate(left) if at not in hit]
    assert len(hit) >= 4

    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id) for r in packed)) == sorted(str(i) for i, _ in left)
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096 and len(used) == -(-sum(used.values()) // 4096)
