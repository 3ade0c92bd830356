"""Chunking and snapshot overview queries."""
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, extract, overview
from ..session import cut_lineage
from . import bindings as b
from .intake_queries import files_of

CONFIG = "hash:64:code-v1"


def counted(files):
    """Number of lines (``n``) of each file, written once for all that reads it; the texts stay behind."""
    return cut_lineage(files.select("analysis_id", "file_id", "path", "language", "ord", F.size(text.lines_with_ends(F.col("content"))).alias("n")))


def regions_of(lines):
    """A region every third line, up to five lines long, so neighbours overlap in some files. lines: of ``counted``."""
    spread = lines.select("analysis_id", "file_id", "path", "ord", "n").where("n > 0").withColumn("s", F.explode(F.expr("sequence(1, n, 3)")))
    return spread.select("analysis_id", "file_id", F.col("s").cast("int").alias("start_line"), F.expr("cast(least(n, s + ord % 5) AS int)").alias("end_line"),
                         F.lit("function").alias("kind"), F.concat_ws(":", F.lit("symbol"), "path", "s").alias("symbol_id"),
                         F.concat(F.lit("f"), "s").alias("symbol"), F.concat(F.lit("f"), "s", F.lit("()")).alias("signature"))


def sized(lines):
    return lines.select("analysis_id", "file_id", "language", F.col("n").alias("lines"))


def c1(spark, folder):
    return chunking.select_regions(regions_of(counted(files_of(spark, folder)))).select("analysis_id", "file_id", "start_line", "end_line")


# One step per region of a file, smallest first.
C1_SQL = b.with_members("SELECT analysis_id, file_id, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line FROM walk WHERE joined", """
regions AS MATERIALIZED (SELECT analysis_id, file_id, s, e, row_number() OVER (PARTITION BY analysis_id, file_id ORDER BY e - s, s, e) AS turn FROM (
  SELECT analysis_id, file_id, s, least(n, s + ord % 5) AS e FROM (SELECT *, unnest(generate_series(1, n, 3)) AS s FROM (SELECT *, len(string_split(content, chr(10))) AS n FROM files) a) x) y),
walk AS (SELECT analysis_id, file_id, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, false AS joined, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS kept FROM regions WHERE turn = 1
  UNION ALL SELECT analysis_id, file_id, turn, s, e, fits, CASE WHEN fits THEN list_append(kept, {'s': s, 'e': e}) ELSE kept END
  FROM (SELECT r.*, w.kept, len([k for k in w.kept if r.s <= k.e AND k.s <= r.e]) = 0 AS fits
    FROM walk w JOIN regions r ON r.analysis_id = w.analysis_id AND r.file_id = w.file_id AND r.turn = w.turn + 1) z)""").replace("WITH ", "WITH RECURSIVE ", 1)


def c2(spark, folder):
    lines = counted(files_of(spark, folder))
    return chunking.uncovered_runs(sized(lines), regions_of(lines).where("start_line % 2 = 1"))


C2_SQL = b.with_members("""
SELECT analysis_id, file_id, min(line) AS start_line, max(line) AS end_line, CASE WHEN language = 'markdown' THEN 'documentation' ELSE 'top-level' END AS kind FROM (
  SELECT *, line - row_number() OVER (PARTITION BY analysis_id, file_id ORDER BY line) AS island FROM (
    SELECT f.analysis_id, f.file_id, f.language, line FROM (SELECT *, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line FROM files) f
    WHERE NOT ((line - 1) % 6 <= ord % 5)) x) y GROUP BY analysis_id, file_id, language, island""")


def _pieces(spark, folder):
    files = files_of(spark, folder)
    lines = counted(files)
    # Read four times below, as its own table: the islands are found once.
    chosen = cut_lineage(chunking.select_regions(regions_of(lines)))
    runs = chunking.uncovered_runs(sized(lines), chosen)
    return chunking.split_regions(files, chosen.unionByName(runs, allowMissingColumns=True))


def c3(spark, folder):
    return _pieces(spark, folder).select("analysis_id", "file_id", "start_line", "end_line", "offset", "kind", F.length("text").alias("characters"))


def c3_rebuilt(spark, folder):
    pieces = _pieces(spark, folder)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "offset", "text"))), lambda p: p["text"]), "")
    return pieces.groupBy("analysis_id", "file_id").agg(F.md5(whole).alias("digest"), (F.max(F.length("text")) <= 8000).alias("bounded"))


C3_SQL = b.with_members("SELECT analysis_id, file_id, md5(content) AS digest, true AS bounded FROM files")


def c4(spark, folder):
    files = files_of(spark, folder)
    return chunking.build_chunks(files, regions_of(counted(files)), CONFIG).select("analysis_id", "id", "file_id", "kind", "start_line", "end_line", "signature")


def _whole_files(files):
    return files.select("analysis_id", "file_id", "path", "language", F.lit("").alias("symbol"), F.lit("").alias("signature"), F.lit(1).alias("start_line"),
                        F.col("line_count").cast("int").alias("end_line"), F.lit(0).alias("offset"), F.lit("top-level").alias("kind"), F.col("content").alias("text"), "ord")


def c5(spark, folder):
    return chunking.chunk_records(_whole_files(files_of(spark, folder)), CONFIG).select("analysis_id", "id", "input_hash", F.length("embedding_text").cast("long").alias("characters"))


_C5 = f"""whole AS (SELECT *, concat('File: ', path, chr(10), 'Language: ', language, chr(10), 'Symbol: ', chr(10), 'Signature: ', chr(10), 'Lines: 1-',
  len(string_split(content, chr(10))), chr(10), content) AS embedding_text FROM files)"""
C5_SQL = b.with_members(f"""SELECT analysis_id, concat('chunk:', path, ':1:', len(string_split(content, chr(10))), ':0:', substr(sha256(concat('{CONFIG}', embedding_text)), 1, 8)) AS id,
  sha256(concat('{CONFIG}', embedding_text)) AS input_hash, length(embedding_text) AS characters FROM whole""", _C5)


def _preview_input(spark, folder):
    rows = chunking.chunk_records(_pieces(spark, folder), CONFIG)
    return rows.select("analysis_id", "id", "path", (F.col("start_line") * 1_000_000 + F.col("offset")).cast("long").alias("ord"), F.octet_length("embedding_text").alias("size"))


def c6_order(spark, folder):
    files = files_of(spark, folder)
    by_file = files.select("analysis_id", "file_id", F.concat("repository_id", F.lit("/"), F.element_at(F.split("path", "/"), 1), F.lit("/all.ts")).alias("path"), "ord")
    return chunking.preview_order(by_file).select("analysis_id", "file_id", "round", "priority")


C6_SQL = b.with_members("""SELECT analysis_id, file_id, row_number() OVER (PARTITION BY analysis_id, split_part(path, '/', 1) ORDER BY ord) AS round,
  CASE WHEN split_part(path, '/', 1) IN ('routes', 'services') THEN -2 ELSE 0 END AS priority FROM files""")


def c6(spark, folder):
    return chunking.select_preview(_preview_input(spark, folder), 20_000)


def c7(spark, folder):
    files = files_of(spark, folder)
    rows = chunking.chunk_records(_whole_files(files), CONFIG)
    return chunking.coverage(rows, rows.where("language IN ('python', 'java')"))


C7_SQL = b.with_members("SELECT analysis_id, count(*) AS total_chunks, count(*) FILTER (language IN ('python', 'java')) AS indexed_chunks FROM files GROUP BY analysis_id")


def o1(spark, folder):
    return overview.manifest_dependencies(files_of(spark, folder))


_DEPS = """deps AS (SELECT DISTINCT analysis_id, unnest(CASE WHEN ord % 12 = 8 THEN ['react', concat('lib-', lang), 'stripe']
  ELSE ['fastapi', concat('lib_', lang), 'celery', 'const password', CASE WHEN content LIKE concat('%', chr(10), 'changed') THEN 'changed' ELSE 'celery' END] END) AS dependency
  FROM files WHERE ord % 12 IN (8, 9))"""
O1_SQL = b.with_members("SELECT analysis_id, dependency FROM deps", _DEPS)


def o2(spark, folder):
    files = files_of(spark, folder)
    return overview.detected(files, overview.manifest_dependencies(files))


O2_SQL = b.with_members("""SELECT DISTINCT analysis_id, 'framework' AS kind, dependency AS label FROM deps WHERE dependency IN ('react', 'fastapi')
UNION SELECT analysis_id, 'integration', dependency FROM deps WHERE dependency IN ('stripe', 'celery')
UNION SELECT analysis_id, 'framework', 'fastapi' FROM files WHERE language = 'python'
UNION SELECT analysis_id, 'framework', 'Spring' FROM files WHERE language = 'java'
UNION SELECT analysis_id, 'framework', 'Spring Boot' FROM files WHERE language = 'xml'
UNION SELECT analysis_id, 'integration', 'PostgreSQL' FROM files WHERE language = 'xml'""", _DEPS)


def o3(spark, folder):
    return overview.entry_points(files_of(spark, folder), limit=30)


O3_SQL = b.with_members("""SELECT analysis_id, path, place FROM (SELECT analysis_id, replace(path, 'package.json', 'src/index.js') AS path,
  row_number() OVER (PARTITION BY analysis_id ORDER BY ord) AS place FROM files WHERE ord % 12 = 8) x WHERE place <= 30""")


def o4(spark, folder):
    files = files_of(spark, folder)
    tags = extract.python_routes(files).groupBy("analysis_id", "file_id", "name").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    nodes = (extract.python_declarations(files).join(tags, ["analysis_id", "file_id", "name"]).join(files.select("analysis_id", "file_id", "ord"), ["analysis_id", "file_id"])
             .select("analysis_id", F.concat_ws(":", F.lit("symbol"), "path", "name").alias("id"), "path", "name", "start_line", "ord", "tags", F.col("kind").alias("symbol_kind")))
    return overview.route_table(nodes, limit=5).drop("ord")


O4_SQL = b.with_members("""SELECT analysis_id, concat('symbol:', path, ':run', ord) AS node_id, path, concat('run', ord) AS name, 7 AS start_line, 'GET' AS method, concat('/api/items/', ord) AS route, place
FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY ord) AS place FROM files WHERE language = 'python') x WHERE place <= 5""")


def o5(spark, folder):
    nodes, edges = b.graph(spark, folder)
    files = nodes.where("kind = 'file'")
    return overview.snapshot_counts(files, nodes, edges, nodes.where("language = 'python'"))


O5_SQL = b.with_graph("""SELECT n.analysis_id, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'symbol') AS symbols, max(e.edges) AS edges,
  count(*) FILTER (language = 'python') AS chunks, 'python,typescript' AS languages FROM nodes n JOIN (SELECT analysis_id, count(*) AS edges FROM edges GROUP BY 1) e
  ON e.analysis_id = n.analysis_id GROUP BY n.analysis_id""")


def o5_warnings(spark, folder):
    nodes, edges = b.graph(spark, folder)
    files = nodes.where("kind = 'file'").withColumn("redacted", F.col("path").contains(".test."))
    diagnostics = edges.where("type_only").select("analysis_id", "ord", F.concat(F.lit("Odd import in "), "file_id").alias("message"))
    return overview.snapshot_warnings(files, diagnostics, edges.where("kind = 'calls' AND start_line = 1"), limit=100)


O5_WARNINGS_SQL = b.with_graph("""SELECT analysis_id, concat('Secrets were masked in ', path) AS warning FROM nodes WHERE kind = 'file' AND path LIKE '%.test.%'
UNION SELECT analysis_id, concat('Odd import in ', file_id) FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY ord, concat('Odd import in ', file_id)) AS r FROM edges WHERE type_only) x WHERE r <= 100
UNION SELECT analysis_id, concat(count(*) - 100, ' more diagnostics are not listed.') FROM edges WHERE type_only GROUP BY analysis_id HAVING count(*) > 100
UNION SELECT analysis_id, concat(count(*), ' references have no target; none was made up.') FROM edges WHERE kind = 'calls' AND start_line = 1 GROUP BY analysis_id""")

QUERIES = {
    "c1_region_select": (c1, C1_SQL), "c2_uncovered_runs": (c2, C2_SQL), "c3_size_split": (c3, None), "c3_chunk_reconstruction": (c3_rebuilt, C3_SQL),
    "c4_small_group": (c4, None), "c5_chunk_record": (c5, C5_SQL), "c6_preview_order": (c6_order, C6_SQL), "c6_preview_select": (c6, None), "c7_coverage": (c7, C7_SQL),
    "o1_manifest_dependencies": (o1, O1_SQL), "o2_framework_detection": (o2, O2_SQL), "o3_entry_points": (o3, O3_SQL), "o4_route_table": (o4, O4_SQL), "o5_snapshot_counts": (o5, O5_SQL),
    "o5_snapshot_warnings": (o5_warnings, O5_WARNINGS_SQL),
}
