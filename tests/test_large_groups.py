"""What an operator does between its input and its result must not grow faster than they do."""
import random
import re

from codestrata.operators import retrieval


def most_joined_rows(frame):
    """The most rows that one join of the frame's finished plan gave. The frame must have been collected."""
    found, todo = [0], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            rows = node.metrics().get("numOutputRows")
            if kind.endswith("JoinExec") and rows.isDefined():
                found.append(rows.get().value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return max(found)


def test_batches_pair_no_items_with_possible_starts(spark):
    rng = random.Random(3)
    costs = [rng.choice([1, 40, 700, 9_000]) for _ in range(9_000)]
    items = spark.createDataFrame([("a", i + 1, c) for i, c in enumerate(costs)], "analysis_id string, position long, cost long")
    marked = retrieval.pack_batches(items, 18_000)
    assert "sequence(" not in marked._jdf.queryExecution().optimizedPlan().toString()
    want, start, total = {}, 1, 0
    for i, c in enumerate(costs):
        if i and (total + c > 18_000 or i + 1 - start >= 8):
            start, total = i + 1, 0
        want[i + 1], total = (c, start), total + c
    rows = marked.collect()
    assert len(rows) == len(want) and {r.position: (r.cost, r.batch_start) for r in rows} == want


def test_named_files_pairs_no_question_with_all_files_of_a_name(spark):
    names = ["amber wheel", "copper valve", "tin drum"]
    files = [(f"f{i:04}", names[i % 3], f"{'turbines' if i % 2 else 'burners'}/x{i}") for i in range(900)]
    nodes = spark.createDataFrame([("p", i, "file", n, p, None) for i, n, p in files], "analysis_id string, id string, kind string, name string, path string, file_id string")
    asked = [(f"q{q}", "p", f"How does the {names[q % 3]} turn{', unlike turbines' if q % 4 else ''}?") for q in range(200)]
    got = retrieval.named_files(spark.createDataFrame(asked, "request_id string, analysis_id string, question string"), nodes, 5)
    by_request = {}
    for r in got.collect():
        by_request.setdefault(r.request_id, []).append((r["rank"], r.file_id))
    plain = lambda x: re.sub("[^a-z0-9]", "", x.lower())
    for request, _, question in asked:
        want = [i for i, name, path in files if plain(name) in plain(question) or path.split("/")[0] in plain(question)][:5]
        assert sorted(by_request[request]) == [(k + 1, f) for k, f in enumerate(want)]
    assert most_joined_rows(got) <= 200 * 5


def test_uncovered_runs_reads_texts_once(spark):
    from codestrata.catalog import chunk_queries
    plan = chunk_queries.c2(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan


def test_lines_are_cut_behind_each_separator(spark):
    from codestrata.functions import text
    rng = random.Random(4)
    values = [None, "", "\r\n", "\n\r\n\r"] + ["".join(rng.choices("ab\r\n\x0b \x85", k=rng.randrange(1, 30))) for _ in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", text.lines_with_ends(text.F.col("t")).alias("lines")).collect()
    separator = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
    for t, lines in rows:
        assert lines == (None if t is None else re.findall(f"[^{separator}]*(?:\r\n|[{separator}])|[^{separator}]+", t))
