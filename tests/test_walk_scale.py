"""The walk writes no table of all relationships for its own look-ups."""
from test_graph import NODE, import_edges, placed, request

from codestrata.operators import graph


def test_walk_looks_up_its_own_options_only(spark, monkeypatch):
    names = [f"src/f{n:02}.ts" for n in range(40)]
    nodes = spark.createDataFrame([placed(p, "module:src", n) for n, p in enumerate(names)], NODE)
    edges = import_edges(spark, [(f"file:{a}", f"file:{b}") for a, b in zip(names, names[1:])])
    files = nodes.selectExpr("analysis_id", "id AS file_id", "path", "end_line AS line_count")
    written = []

    def cut(rows, really=graph.cut_lineage):
        table = really(rows)
        written.append(table.count())
        return table
    monkeypatch.setattr(graph, "cut_lineage", cut)
    steps, branches = graph.walk(nodes, edges, files, request(spark, f"file:{names[35]}"))
    assert [r.node for r in steps.orderBy("step").collect()] == [f"file:{p}" for p in names[35:]]
    assert sorted((r.step, r.branch) for r in branches.collect()) == [(n + 1, f"file:{p}") for n, p in enumerate(names[36:])]
    # The edges inside files, folded, and with the targets' paths; then the request and, for each step, what it reaches.
    assert written[:3] == [39, 39, 39] and all(n <= 2 for n in written[3:])
