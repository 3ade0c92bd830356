"""Results that no limit, prefix or size switch shortens, and requests that do not touch each other."""
from pyspark.sql import functions as F

from codestrata.functions import identity
from codestrata.operators import access, chunking, graph, retrieval
from codestrata.sources import keyed
from codestrata.streaming import jobs
from test_graph import NODE, import_edges, module, placed
from test_text_and_chunks import REGION, file_rows


def test_each_request_rolls_up_to_its_own_modules(spark):
    rows = [module("x", "repo", 0), module("x/d", "module:x", 1), module("y", "repo", 2), module("z", "repo", 3), placed("x/d/a.ts", "module:x/d", 4), placed("y/b.ts", "module:y", 5)]
    nodes, edges = spark.createDataFrame(rows, NODE), import_edges(spark, [("file:x/d/a.ts", "file:y/b.ts")])
    chosen = spark.createDataFrame([("r1", "a", "module:x"), ("r1", "a", "module:y"), ("r2", "a", "module:x/d"), ("r2", "a", "module:z")], "request_id string, analysis_id string, id string")
    totals, _ = graph.module_rollup(nodes, edges, chosen)
    assert [(r.request_id, r.source, r.target) for r in totals.collect()] == [("r1", "module:x", "module:y")]


def test_folders_of_any_depth_and_cycles(spark):
    deep = ["/".join(f"d{k}" for k in range(n)) for n in range(1, 71)]
    rows = [module(p, f"module:{deep[i - 1]}" if i else "repo", i) for i, p in enumerate(deep)]
    rows += [module("one", "module:two", 90), module("two", "module:three", 91), module("three", "module:two", 92)]
    found = graph.module_ancestors(spark.createDataFrame(rows, NODE))
    assert found.where(F.col("node") == f"module:{deep[-1]}").count() == 70
    assert {r.module for r in found.where("node = 'module:one'").collect()} == {"module:one", "module:two", "module:three"}


def test_digest_of_a_large_snapshot(spark):
    files = spark.range(2001).select(F.lit("a").alias("analysis_id"), F.concat(F.lit("f"), "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    one, other = (identity.corpus_digest(x).first() for x in (files, files.where("id <> 7").unionByName(files.where("id = 7").withColumn("content_hash", F.lit("new")))))
    assert one.file_count == other.file_count == 2001 and len(one.corpus_hash) == 40 and one.corpus_hash != other.corpus_hash


def test_find_and_lists_return_all(spark):
    assert keyed.find(spark.range(200_100)).count() == 200_100
    grants = spark.range(150).select(F.lit("u").alias("user_id"), F.concat(F.lit("s"), "id").alias("analysis_id"), F.col("id").alias("created_at"))
    analyses = grants.select("analysis_id", F.concat(F.lit("r"), "created_at").alias("repository_id"), "created_at", F.lit(True).alias("graph_ready"))
    assert access.repository_list(grants, analyses).count() == 150
    assert {r.repository_id for r in access.repository_list(grants, analyses, 2).collect()} == {"r148", "r149"}


def test_the_tail_of_a_long_line_is_not_merged(spark):
    body = "x" * 9700 + "\nfoo();\n"
    regions = spark.createDataFrame([("a", "file:a.ts", 1, 2, "statement", None, None, None)], REGION)
    chunks = chunking.build_chunks(file_rows(spark, {"a.ts": body}), regions, "c").orderBy("start_line", "offset").collect()
    assert [(c.start_line, c.end_line, c.offset) for c in chunks] == [(1, 1, 0), (1, 1, 4800), (1, 1, 9600), (2, 2, 0)]


def test_repeated_cache_rows_do_not_multiply_items(spark):
    items = spark.createDataFrame([("1", "h", "t"), ("2", "h", "t")], "id string, input_hash string, embedding_text string")
    cache = spark.createDataFrame([("h", "m", [1.0, 0.0])] * 3, "input_hash string, embedding_config string, embedding array<double>")
    assert retrieval.embed_missing(items, cache, "m")[0].count() == 2


def test_a_snapshot_may_arrive_over_several_batches(spark, tmp_path):
    schema, source, target = "analysis_id string, path string, v int", str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", "p", 1), ("b", "p", 1)], [("a", "q", 2), ("a", "p", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.incremental_intake(spark.readStream.schema(schema).parquet(source), lambda x: x, target, str(tmp_path / "state")).awaitTermination()
    assert {(r.analysis_id, r.path, r.v) for r in spark.read.parquet(target).collect()} == {("a", "p", 3), ("a", "q", 2), ("b", "p", 1)}
