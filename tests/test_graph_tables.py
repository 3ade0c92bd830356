import datetime

from codestrata import session
from codestrata.catalog import bindings

DAY = datetime.datetime(1996, 1, 1)
TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "R")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0)]),
    "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(c, 0, "HOUSEHOLD") for c in range(20)]),
    "supplier": ("s_suppkey long, s_nationkey int, s_acctbal double", [(s, 0, 1.0) for s in range(10)]),
    "part": ("p_partkey long, p_name string", [(p, f"p{p}") for p in range(10)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string", [(o, o % 20, "OFP"[o % 3], "1-URGENT") for o in range(60)]),
    "lineitem": ("l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_linestatus string, l_shipdate timestamp_ntz, l_returnflag string",
                 [(o, n, n, n, "F", DAY, "RAN"[n % 3]) for o in range(60) for n in range(1, 7)]),
}


def test_graph_is_written_by_tasks_of_bounded_rows(spark, monkeypatch):
    def written(folder, rows):
        monkeypatch.setattr(session, "ROWS_PER_TASK", rows)
        monkeypatch.setitem(bindings._frames, (spark.sparkContext.applicationId, folder), {n: spark.createDataFrame(r, s) for n, (s, r) in TABLES.items()})
        nodes, edges = bindings.graph(spark, folder)
        return [sorted(map(str, frame.collect())) for frame in (nodes, edges)], len(edges.inputFiles())
    settings = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    few, _ = written("made few", 1_000_000)
    many, files = written("made many", 9)           # 360 line items: 40 tasks for each kind of edge
    assert many == few and len(few[1]) > 200
    assert files > 60
    assert settings == {n: spark.conf.get(n) for n in settings}
