"""Neighbourhoods, caps, roll-ups, impact, comparison and walks on small literal graphs."""
import hashlib

from codestrata.operators import compare, graph

NODE = "analysis_id string, id string, kind string, name string, path string, file_id string, parent_id string, language string, symbol_kind string, start_line int, end_line int, ord long"
EDGE = "analysis_id string, id string, source string, target string, kind string, file_id string, start_line int, end_line int, type_only boolean, ord long"


def file_nodes(spark, paths, analysis="a", extra=()):
    rows = [(analysis, f"file:{p}", "file", p.split("/")[-1], p, f"file:{p}", None, "typescript", None, 1, 2, i) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows + list(extra), NODE)


def import_edges(spark, pairs, analysis="a", kind="imports", lines=1):
    return spark.createDataFrame([(analysis, str(i), s, t, kind, s, lines, lines, False, i) for i, (s, t) in enumerate(pairs)], EDGE)


PATHS = ["src/main.ts", "src/service.ts", "src/db.ts", "tests/service.test.ts"]
PAIRS = [(f"file:{PATHS[a]}", f"file:{PATHS[b]}") for a, b in ((0, 1), (1, 2), (3, 1), (2, 0))]


def sample(spark, analysis="a", symbol="fn", line=1):
    run = (analysis, symbol, "symbol", "run", "src/service.ts", "file:src/service.ts", "file:src/service.ts", "typescript", "function", line, line + 1, 99)
    nodes, edges = file_nodes(spark, PATHS, analysis, [run]), import_edges(spark, PAIRS, analysis)
    files = spark.createDataFrame([(analysis, f"file:{p}", p, 2) for p in PATHS], "analysis_id string, file_id string, path string, line_count int")
    return nodes, edges, files


def request(spark, node, analysis="a"):
    return spark.createDataFrame([("r", analysis, node)], "request_id string, analysis_id string, node_id string")


def test_impact_of_service(spark):
    nodes, edges, files = sample(spark)
    found, _ = graph.impact(nodes, edges, files, request(spark, "fn"), 3)
    rows = {r.path: (r.distance, r.via_path) for r in found.collect()}
    assert {p for p, (d, _) in rows.items() if d == 1} == {"src/main.ts", "tests/service.test.ts"}
    assert rows["src/db.ts"] == (2, "src/main.ts") and len(rows) == 3
    assert all(r.citation.startswith("E") for r in found.collect())
    assert [r.path for r in graph.impact_tests(found).collect()] == ["tests/service.test.ts"]
    shallow, _ = graph.impact(nodes, edges, files, request(spark, "fn"), 1)
    assert {r.distance for r in shallow.collect()} == {1}


def test_direction_of_neighbours(spark):
    nodes, edges = file_nodes(spark, ["a", "b", "c"]), import_edges(spark, [("file:a", "file:b"), ("file:b", "file:c"), ("file:c", "file:a")])
    around = lambda node, way, depth: {r.node for r in graph.neighbors(nodes, edges, request(spark, node), way, depth)[0].collect()}
    assert around("file:b", "dependencies", 1) == {"file:b", "file:c"}
    assert around("file:b", "dependents", 1) == {"file:a", "file:b"}
    assert around("file:a", "both", 2) == {"file:a", "file:b", "file:c"}
    assert around("file:nope", "both", 2) == set()


def test_star_is_capped_without_dangling_edges(spark):
    names = [f"n{i}" for i in range(150)]
    nodes, edges = file_nodes(spark, names), import_edges(spark, [("file:n0", f"file:{n}") for n in names[1:]])
    seen, kept, omitted = graph.neighbors(nodes, edges, request(spark, "file:n0"), "both", 1, 100)
    ids = {r.node for r in seen.collect()}
    assert len(ids) == 100 and omitted.first().omitted == 50
    assert all(r.source in ids and r.target in ids for r in kept.collect())
    assert ids == {f"file:n{i}" for i in range(100)}  # admitted in edge order


def test_project_caps_nodes(spark):
    names = [f"n{i:03d}" for i in range(260)]
    nodes, edges = file_nodes(spark, names), import_edges(spark, [("file:n000", f"file:{n}") for n in names[1:]])
    chosen, shown, omitted = graph.project(nodes, edges, nodes.selectExpr("'r' AS request_id", "*"), "files", limit=200)
    assert chosen.count() == 200 and shown.count() == 199 and omitted.first().omitted_nodes == 60


def module(path, parent, i):
    return ("a", f"module:{path}", "module", path.split("/")[-1], path, None, parent, None, None, None, None, i)


def placed(path, parent, i):
    return ("a", f"file:{path}", "file", path, path, f"file:{path}", parent, "typescript", None, 1, 2, i)


def test_imports_roll_up_to_the_nearest_shown_module(spark):
    rows = [module("src/a", "repo", 0), module("src/a/deep", "module:src/a", 1), module("src/b", "repo", 2), placed("src/a/deep/x.ts", "module:src/a/deep", 3), placed("src/b/y.ts", "module:src/b", 4)]
    nodes = spark.createDataFrame(rows, NODE)
    edges = import_edges(spark, [("file:src/a/deep/x.ts", "file:src/b/y.ts")])
    shown = graph.module_candidates(nodes)
    assert {r.id for r in shown.collect()} == {"module:src/a", "module:src/b"}
    totals, members = graph.module_rollup(nodes, edges, shown.select("analysis_id", "id"))
    assert [(r.source, r.target, r["count"]) for r in totals.collect()] == [("module:src/a", "module:src/b", 1)]
    assert [r.edge_id for r in members.collect()] == ["0"]


def test_root_module_shows_when_it_holds_code(spark):
    rows = [module(".", "repo", 0), module("src", "module:.", 1), placed("main.ts", "module:.", 2), placed("src/run.ts", "module:src", 3)]
    assert {r.id for r in graph.module_candidates(spark.createDataFrame(rows, NODE)).collect()} == {"module:.", "module:src"}


def test_walk_stops_at_the_cycle(spark):
    nodes, edges, files = sample(spark)
    steps, _ = graph.walk(nodes, edges, files, request(spark, "file:src/main.ts"))
    assert [r.node for r in steps.orderBy("step").collect()] == [f"file:{p}" for p in PATHS[:3]]


def test_compare_ignores_moved_lines_and_new_ids(spark):
    digest = lambda p: hashlib.sha256(p.encode()).hexdigest()
    before, after = sample(spark, "old"), sample(spark, "new", "other", 5)
    nodes, edges = before[0].unionByName(after[0]), before[1].unionByName(after[1])
    rows = [("old", p, digest(p), 2) for p in PATHS] + [("new", p, digest(p + "!") if p == PATHS[0] else digest(p), 3) for p in PATHS[:3]]
    files = spark.createDataFrame(rows, "analysis_id string, path string, content_hash string, line_count int")
    pairs = spark.createDataFrame([("p", "old", "new")], "pair_id string, base_id string, current_id string")
    assert {(r.path, r.status) for r in compare.file_changes(pairs, files).collect()} == {(PATHS[0], "modified"), (PATHS[3], "removed")}
    delta = compare.symbol_delta(pairs, nodes).first()
    assert (delta.symbols_added, delta.symbols_removed) == (0, 0)
    assert compare.relationship_delta(pairs, nodes, edges)[0].count() == 0
    fewer = before[1].unionByName(after[1].where("id <> '3'"))
    assert [r.change for r in compare.relationship_delta(pairs, nodes, fewer)[0].collect()] == ["removed"]


def test_search_by_piece_and_by_scan(spark):
    nodes, _, _ = sample(spark)
    asked = spark.createDataFrame([("long", "a", "SERVICE"), ("short", "a", "db"), ("all", "a", "")], "request_id string, analysis_id string, query string")
    _, totals = graph.node_search(nodes, asked)
    assert {r.request_id: r.total for r in totals.collect()} == {"long": 3, "short": 1, "all": 5}


def test_expansion_looks_up_only_the_nodes_it_meets(spark):
    from codestrata.operators.traversal import expand
    links = spark.createDataFrame([("a", "n", x, i, f"l{i}") for i, x in enumerate(["lost", "m", "o", "p"])] + [("a", "m", "gone", 9, "l9"), ("b", "n", "m", 1, "l1")],
                                  "analysis_id string, node string, neighbor string, k1 int, k2 string")
    known = spark.createDataFrame([("a", x) for x in ("n", "m", "o", "p")] + [("b", "gone")], "analysis_id string, node string")
    start = spark.createDataFrame([("q", "a", "n")], "request_id string, analysis_id string, node string")
    seen, omitted = expand(start, links, 2, 3, known)
    assert sorted((r.node, r.distance, r.position) for r in seen.collect()) == [("m", 1, 1), ("n", 0, 0), ("o", 1, 2)]
    assert [(r.request_id, r.omitted) for r in omitted.collect()] == [("q", 1)]


def test_rows_without_a_file_spread_over_the_tasks_of_the_citation_join(spark):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([("a", f"e{i}", None, 1, 1) for i in range(200)] + [("a", "file:f", "file:f", 1, 2), ("a", "file:g", None, 1, 1), ("a", "x", "file:g", 1, 9),
                                  (None, "y", "file:f", 1, 1), ("a", None, None, 1, 1)], "analysis_id string, id string, file_id string, start_line int, end_line int")
    files = spark.createDataFrame([("a", "file:f", "f", 2), ("a", "file:g", "g", 2)], "analysis_id string, file_id string, path string, line_count int")
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {n: spark.conf.get(n) for n in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        found = graph.with_citation(rows, files, "id")
        assert found.columns == ["analysis_id", "file_id", "id", "start_line", "end_line", "citation_path", "citation"]
        found = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(found) == 205 and {(r.id, r.citation_path) for r in found if r.citation or r.citation_path} == {("file:f", "f")}
    assert len({r.task for r in found if r.file_id is None}) > 4
