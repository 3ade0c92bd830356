"""Graph queries: neighbourhoods, projections, impact, walks, listings."""
from pyspark.sql import functions as F

from ..operators import graph
from . import bindings as b
from .intake_queries import files_of


def _focus(spark, folder):
    nodes, edges = b.graph(spark, folder)
    return nodes, edges, spark.sql(b.FOCUS), b.sql_frame(spark, b.GRAPH_FILES, nodes=nodes)


def breadth_first_sql(depth: int, cap: int) -> list[str]:
    """Unrolled level-by-level expansion over CTEs focus(request_id, analysis_id, node_id), links(analysis_id, node, neighbor, k1, k2)."""
    parts = ["seen0 AS (SELECT request_id, analysis_id, node_id AS node, 0 AS distance, 0 AS position, CAST(NULL AS STRING) AS via, "
             "CAST(NULL AS STRING) AS link FROM start)", "last0 AS (SELECT * FROM seen0)"]
    for d in range(1, depth + 1):
        p = d - 1
        parts += [
            f"met{d} AS MATERIALIZED (SELECT x.* FROM (SELECT request_id, analysis_id, node, min(best) AS best, arg_min(via, best) AS via,"
            f"    arg_min(k2, best) AS k2 FROM ("
            f"    SELECT f.request_id, f.analysis_id, l.neighbor AS node, f.node AS via, l.k2,"
            f"           concat(lpad(cast(f.position AS string), 9, '0'), chr(1), l.k1, chr(1), l.k2, chr(1), f.node) AS best"
            f"    FROM last{p} f JOIN links l ON l.nk = concat(f.analysis_id, '|', f.node)) y GROUP BY request_id, analysis_id, node) x"
            f"  ANTI JOIN seen{p} s ON s.request_id = x.request_id AND s.node = x.node)",
            f"last{d} AS MATERIALIZED (SELECT m.request_id, analysis_id, node, {d} AS distance, position, via, k2 AS link FROM ("
            f"  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY best) AS position FROM met{d}) m"
            f"  JOIN (SELECT request_id, {cap} - count(*) AS room FROM seen{p} GROUP BY request_id) r ON m.request_id = r.request_id"
            f"  WHERE position <= room)",
            f"seen{d} AS MATERIALIZED (SELECT * FROM seen{p} UNION ALL SELECT * FROM last{d})"]
    unions = " UNION ".join(f"SELECT request_id, node FROM met{d}" for d in range(1, depth + 1))
    parts.append(f"left_out AS (SELECT request_id, count(*) AS omitted FROM ({unions}) u WHERE NOT EXISTS ("
                 f"SELECT 1 FROM seen{depth} s WHERE s.request_id = u.request_id AND s.node = u.node) GROUP BY request_id)")
    return parts


START = "start AS (SELECT * FROM focus)"
BOTH_LINKS = """links AS MATERIALIZED (SELECT l.* FROM (
  SELECT sk AS nk, tk, target AS neighbor, lpad(cast(ord AS string), 12, '0') AS k1, id AS k2 FROM edges WHERE kind <> 'contains'
  UNION ALL SELECT tk, sk, source, lpad(cast(ord AS string), 12, '0'), id FROM edges WHERE kind <> 'contains') l
  JOIN nodes n ON n.k = l.tk)"""
RELATIONS = """folded AS MATERIALIZED (SELECT e.analysis_id, s.file_id AS source_file, t.file_id AS target_file, e.id, e.kind, e.file_id,
    e.start_line, e.end_line, concat(lpad(cast(e.ord AS string), 12, '0'), e.id) AS place
    FROM edges e JOIN nodes s ON s.k = e.sk JOIN nodes t ON t.k = e.tk WHERE e.kind <> 'contains'),
  relations AS MATERIALIZED (SELECT f.analysis_id, f.source_file, f.target_file, id AS edge_id, kind, file_id, start_line, end_line FROM folded f
    JOIN (SELECT analysis_id, source_file, target_file, min(place) AS place FROM folded WHERE source_file <> target_file
          GROUP BY analysis_id, source_file, target_file) g ON g.place = f.place AND g.analysis_id = f.analysis_id)"""


def g1(spark, folder):
    nodes, edges, focus, _ = _focus(spark, folder)
    seen, _, omitted = graph.neighbors(nodes, edges, focus, "both", 2, 100)
    return seen.join(omitted, "request_id", "left").select(
        "request_id", "node", "distance", F.coalesce("omitted", F.lit(0)).alias("omitted"))


G1_SQL = b.with_graph("""SELECT s.request_id, node, distance, coalesce(omitted, 0) AS omitted FROM seen2 s
LEFT JOIN left_out o ON s.request_id = o.request_id""", START, BOTH_LINKS, *breadth_first_sql(2, 100))


def g1_edges(spark, folder):
    nodes, edges, focus, _ = _focus(spark, folder)
    return graph.neighbors(nodes, edges, focus, "both", 2, 100)[1].select("request_id", "id")


G1_EDGES_SQL = b.with_graph("""SELECT DISTINCT n.request_id, n.id FROM near n
JOIN seen2 z ON concat(z.request_id, '|', z.node) = n.far WHERE n.distance < 2 AND (SELECT count(*) FROM left_out) >= 0""", START, BOTH_LINKS, *breadth_first_sql(2, 100), """
near AS MATERIALIZED (SELECT s.request_id, e.id, s.distance, concat(s.request_id, '|', e.target) AS far FROM edges e
    JOIN seen2 s ON concat(s.analysis_id, '|', s.node) = e.sk WHERE e.kind <> 'contains'
  UNION ALL SELECT s.request_id, e.id, s.distance, concat(s.request_id, '|', e.source) FROM edges e
    JOIN seen2 s ON concat(s.analysis_id, '|', s.node) = e.tk WHERE e.kind <> 'contains')""")


def g2_files(spark, folder):
    nodes, edges = b.graph(spark, folder)
    files = nodes.where("kind = 'file'").withColumn("request_id", F.col("analysis_id"))
    _, shown, omitted = graph.project(nodes, edges, files, "files", limit=1000)
    return shown.join(omitted, "request_id").select("request_id", "id", "source", "target", "kind", "rank", "omitted_nodes", "omitted_edges")


G2_FILES_SQL = b.with_graph("""
SELECT request_id, id, source, target, kind, rank, CAST(greatest(total - 1000, 0) AS BIGINT) AS omitted_nodes,
       CAST(greatest(edges_total - 2000, 0) AS BIGINT) AS omitted_edges FROM (
  SELECT e.analysis_id AS request_id, e.id, source, target, e.kind, s.total,
         row_number() OVER (PARTITION BY e.analysis_id ORDER BY e.ord, e.id) AS rank,
         count(*) OVER (PARTITION BY e.analysis_id) AS edges_total
  FROM edges e JOIN chosen s ON concat(s.analysis_id, '|', s.id) = e.sk
  JOIN chosen t ON concat(t.analysis_id, '|', t.id) = e.tk) x WHERE rank <= 2000""", """
chosen AS (SELECT analysis_id, id, total FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY path, name, ord, id) AS r,
  count(*) OVER (PARTITION BY analysis_id) AS total FROM nodes WHERE kind = 'file') n WHERE r <= 1000)""")


def g2_modules(spark, folder):
    nodes, edges = b.graph(spark, folder)
    candidates = graph.module_candidates(nodes).withColumn("request_id", F.col("analysis_id"))
    _, shown, omitted = graph.project(nodes, edges, candidates, "modules", limit=12)
    return shown.join(omitted, "request_id").select("request_id", "id", "source", "target", "kind", "count", "rank", "omitted_nodes", "omitted_edges")


_LIFT = """
chosen AS (SELECT analysis_id, id, path, total FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY path, name) AS r,
  count(*) OVER (PARTITION BY analysis_id) AS total FROM nodes WHERE kind = 'module') n WHERE r <= 12),
near AS (SELECT f.analysis_id, f.id AS node, coalesce(n.id, r.id) AS module FROM nodes f
  JOIN nodes p ON p.analysis_id = f.analysis_id AND p.id = f.parent_id
  LEFT JOIN chosen n ON n.analysis_id = f.analysis_id AND n.id = f.parent_id
  LEFT JOIN chosen r ON r.analysis_id = f.analysis_id AND r.id = p.parent_id WHERE f.kind = 'file'),
raised AS MATERIALIZED (SELECT e.analysis_id, e.id, e.ord, e.kind, s.module AS a, t.module AS z FROM edges e
  JOIN near s ON concat(s.analysis_id, '|', s.node) = e.sk JOIN near t ON concat(t.analysis_id, '|', t.node) = e.tk
  WHERE e.kind IN ('imports', 'reexports')), lifted AS (SELECT * FROM raised WHERE a <> z)"""
G2_MODULES_SQL = b.with_graph("""
SELECT request_id, id, source, target, kind, count, rank, CAST(18 AS BIGINT) AS omitted_nodes,
       CAST(greatest(edges_total - 24, 0) AS BIGINT) AS omitted_edges
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY part, ord, tie) AS rank, count(*) OVER (PARTITION BY request_id) AS edges_total
  FROM (SELECT e.analysis_id AS request_id, e.id, source, target, kind, 1 AS count, 0 AS part, ord, e.id AS tie FROM edges e
        JOIN chosen s ON concat(s.analysis_id, '|', s.id) = e.sk JOIN chosen t ON concat(t.analysis_id, '|', t.id) = e.tk
        UNION ALL SELECT analysis_id, concat('aggregate:', a, ':', z, ':', kind), a, z, kind, count(*), 1, min(ord),
                         arg_min(id, concat(lpad(cast(ord AS string), 12, '0'), id))
        FROM lifted GROUP BY analysis_id, a, z, kind) y) x WHERE rank <= 24""", _LIFT)


def g3(spark, folder):
    nodes, _ = b.graph(spark, folder)
    return graph.module_candidates(nodes).select("analysis_id", "id", "kind", "path")


G3_SQL = b.with_graph("SELECT analysis_id, id, kind, path FROM nodes WHERE kind = 'module'")


def _some_modules(nodes):
    return nodes.where("kind = 'module' AND length(path) <= 5").select("analysis_id", "id")


def g4(spark, folder):
    nodes, edges = b.graph(spark, folder)
    totals, _ = graph.module_rollup(nodes, edges, _some_modules(nodes))
    return totals.select("analysis_id", "id", "source", "target", "kind", "count", F.col("first.edge_id").alias("first_edge"))


_ROLL = """
chosen AS (SELECT analysis_id, id FROM nodes WHERE kind = 'module' AND length(path) <= 5),
near AS (SELECT f.analysis_id, f.id AS node, coalesce(n.id, r.id) AS module FROM nodes f
  JOIN nodes p ON p.analysis_id = f.analysis_id AND p.id = f.parent_id
  LEFT JOIN chosen n ON n.analysis_id = f.analysis_id AND n.id = f.parent_id
  LEFT JOIN chosen r ON r.analysis_id = f.analysis_id AND r.id = p.parent_id WHERE f.kind = 'file'),
raised AS MATERIALIZED (SELECT e.analysis_id, e.id, e.ord, e.kind, s.module AS a, t.module AS z FROM edges e
  JOIN near s ON concat(s.analysis_id, '|', s.node) = e.sk JOIN near t ON concat(t.analysis_id, '|', t.node) = e.tk
  WHERE e.kind IN ('imports', 'reexports')), lifted AS (SELECT * FROM raised WHERE a <> z)"""
G4_SQL = b.with_graph("""SELECT analysis_id, concat('aggregate:', a, ':', z, ':', kind) AS id, a AS source, z AS target, kind, count(*) AS count,
  arg_min(id, concat(lpad(cast(ord AS string), 12, '0'), id)) AS first_edge FROM lifted GROUP BY analysis_id, a, z, kind""", _ROLL)


def g4_members(spark, folder):
    nodes, edges = b.graph(spark, folder)
    return graph.module_rollup(nodes, edges, _some_modules(nodes))[1].select("analysis_id", "id", "edge_id")


G4_MEMBERS_SQL = b.with_graph("SELECT analysis_id, concat('aggregate:', a, ':', z, ':', kind) AS id, id AS edge_id FROM lifted", _ROLL)


def g5(spark, folder):
    nodes, _ = b.graph(spark, folder)
    containers = nodes.where("kind IN ('repository', 'module')").select(
        F.concat_ws("#", "analysis_id", "id").alias("request_id"), "analysis_id", F.col("id").alias("node_id"))
    files = graph.container_children(nodes, containers, "files").select("request_id", "id", F.lit("files").alias("level"))
    direct = graph.container_children(nodes, containers, "modules").select("request_id", "id", F.lit("modules").alias("level"))
    inside = graph.file_symbols(nodes, nodes.where("kind = 'file'").select(
        F.concat_ws("#", "analysis_id", "id").alias("request_id"), "analysis_id", F.col("id").alias("node_id")))
    return files.unionByName(direct).unionByName(inside.select("request_id", "id", F.lit("symbols").alias("level")))


G5_SQL = b.with_graph("""
SELECT concat(m.analysis_id, '#', m.id) AS request_id, f.id, 'files' AS level FROM nodes m JOIN nodes f ON f.analysis_id = m.analysis_id
  AND f.kind = 'file' AND (m.kind = 'repository' OR starts_with(f.path, concat(m.path, '/'))) WHERE m.kind IN ('repository', 'module')
UNION ALL SELECT concat(m.analysis_id, '#', m.id), c.id, 'modules' FROM nodes m JOIN nodes c ON c.analysis_id = m.analysis_id
  AND (c.parent_id = m.id OR c.id = m.id) WHERE m.kind IN ('repository', 'module')
UNION ALL SELECT concat(m.analysis_id, '#', m.id), c.id, 'symbols' FROM nodes m JOIN nodes c ON c.analysis_id = m.analysis_id
  AND c.file_id = m.id WHERE m.kind = 'file'""")


def g6(spark, folder):
    nodes, edges = b.graph(spark, folder)
    return graph.file_relationships(nodes, edges)


G6_SQL = b.with_graph("SELECT * FROM relations", RELATIONS)


def _impact(spark, folder):
    nodes, edges, focus, files = _focus(spark, folder)
    return nodes, focus, *graph.impact(nodes, edges, files, focus, 3)


def g7(spark, folder):
    _, _, found, omitted = _impact(spark, folder)
    return found.join(omitted, "request_id", "left").withColumn("omitted", F.coalesce("omitted", F.lit(0))).withColumn(
        "reach", F.when(F.col("distance") == 1, "direct").otherwise("transitive"))


_IMPACT = [START, RELATIONS, """links AS MATERIALIZED (SELECT concat(analysis_id, '|', target_file) AS nk, source_file AS neighbor, source_file AS k1, edge_id AS k2 FROM relations)""",
           *breadth_first_sql(3, graph.IMPACT_FILE_CAP), """
found AS MATERIALIZED (SELECT s.request_id, s.analysis_id, s.node, n.path, s.distance, v.path AS via_path, r.kind AS relationship,
  CASE WHEN f.file_id IS NOT NULL AND r.start_line BETWEEN 1 AND r.end_line AND r.end_line <= f.line_count
       THEN concat('E', substr(sha256(r.edge_id), 1, 12)) END AS citation
  FROM seen3 s JOIN relations r ON r.edge_id = s.link AND r.analysis_id = s.analysis_id
  JOIN nodes n ON n.k = concat(s.analysis_id, '|', s.node) JOIN nodes v ON v.k = concat(s.analysis_id, '|', s.via)
  LEFT JOIN (""" + b.GRAPH_FILES + """) f ON f.analysis_id = s.analysis_id AND f.file_id = r.file_id WHERE s.distance > 0)"""]
# The graph file records read the nodes CTE above.
G7_SQL = b.with_graph("""SELECT f.*, coalesce(omitted, 0) AS omitted, CASE WHEN distance = 1 THEN 'direct' ELSE 'transitive' END AS reach
FROM found f LEFT JOIN left_out o ON o.request_id = f.request_id""", *_IMPACT)


def g8(spark, folder):
    return graph.impact_tests(_impact(spark, folder)[2]).select("request_id", "path", "distance")


G8_SQL = b.with_graph("""SELECT request_id, path, distance FROM found
WHERE regexp_matches(path, '(?i)(^|/)(tests?|__tests__)/|(^|/)(test_[^/]+|[^/]+[._](test|spec))\\.')
  AND (SELECT count(*) FROM left_out) >= 0""", *_IMPACT)


def g9(spark, folder):
    nodes, focus, found, _ = _impact(spark, folder)
    routes = nodes.where("symbol_kind = 'class'").select("analysis_id", F.col("id").alias("route_id"), "path")
    starts = focus.join(nodes.select("analysis_id", F.col("id").alias("node_id"), "path"), ["analysis_id", "node_id"])
    return graph.impact_routes(found, starts, routes).select("request_id", "route_id", "path")


G9_SQL = b.with_graph("""SELECT t.request_id, n.id AS route_id, n.path FROM nodes n JOIN (
  SELECT request_id, analysis_id, path FROM found UNION SELECT request_id, focus.analysis_id, path FROM focus
  JOIN nodes x ON x.analysis_id = focus.analysis_id AND x.id = node_id) t ON t.analysis_id = n.analysis_id AND t.path = n.path
WHERE n.symbol_kind = 'class' AND (SELECT count(*) FROM left_out) >= 0""", *_IMPACT)


def g10(spark, folder):
    nodes, edges, _, files = _focus(spark, folder)
    return graph.with_citation(edges.select("analysis_id", "id", "file_id", "start_line", "end_line"), files, "id").drop("start_line", "end_line")


G10_SQL = b.with_graph(f"""SELECT e.analysis_id, e.id, e.file_id,
  CASE WHEN ok THEN f.path END AS citation_path, CASE WHEN ok THEN concat('E', substr(sha256(e.id), 1, 12)) END AS citation
FROM edges e LEFT JOIN ({b.GRAPH_FILES}) f ON f.analysis_id = e.analysis_id AND f.file_id = e.file_id,
LATERAL (SELECT e.start_line >= 1 AND e.start_line <= e.end_line AND e.end_line <= f.line_count AS ok)""")


def g11(spark, folder):
    nodes, edges, focus, files = _focus(spark, folder)
    lonely = nodes.where("kind = 'module'").select(F.concat_ws("#", "analysis_id", "id").alias("request_id"), "analysis_id", F.col("id").alias("node_id"))
    return graph.dependency_facts(nodes, edges, files, focus.unionByName(lonely), "dependents")


G11_SQL = b.with_graph(f"""
SELECT k.request_id, number, concat(s.path, ' ', k.kind, ' ', t.path, CASE WHEN type_only THEN ' (type-only).' ELSE '.' END) AS text,
  'fact' AS block_kind, CASE WHEN k.start_line BETWEEN 1 AND k.end_line AND k.end_line <= f.line_count THEN concat('G', number) END AS citation
FROM (SELECT o.request_id, e.*, row_number() OVER (PARTITION BY o.request_id ORDER BY e.ord, e.id) AS number FROM edges e
      JOIN focus o ON o.analysis_id = e.analysis_id AND o.node_id = e.target
      JOIN seen1 s ON s.request_id = o.request_id AND s.node = e.source WHERE e.kind <> 'contains') k
JOIN nodes s ON s.k = k.sk JOIN nodes t ON t.k = k.tk
LEFT JOIN ({b.GRAPH_FILES}) f ON f.analysis_id = k.analysis_id AND f.file_id = k.file_id WHERE number <= 30
UNION ALL SELECT concat(analysis_id, '#', id), 1, concat('No resolved dependents were found for ', name,
  ' in this static analysis. Dynamic or unresolved relationships may still exist.'), 'unknown', NULL FROM nodes WHERE kind = 'module'
""", START, """links AS MATERIALIZED (SELECT tk AS nk, source AS neighbor, lpad(cast(e.ord AS string), 12, '0') AS k1, e.id AS k2 FROM edges e
  JOIN nodes n ON n.k = e.sk WHERE e.kind <> 'contains')""", *breadth_first_sql(1, 30))


def g11_warnings(spark, folder):
    nodes, edges, focus, _ = _focus(spark, folder)
    return graph.dependency_warnings(nodes, edges, focus, "both", 3)


G11_WARNINGS_SQL = b.with_graph("""SELECT request_id, omitted, concat('Showing a bounded view; ', omitted, ' additional nodes omitted.') AS warning FROM left_out""",
                                START, BOTH_LINKS, *breadth_first_sql(1, 3))


def _entries(nodes, focus):
    picked = focus.join(nodes.select("analysis_id", F.col("id").alias("node_id"), "path", "ord"), ["analysis_id", "node_id"])
    return picked.select("analysis_id", "path", "ord")


def g12(spark, folder):
    nodes, edges, focus, _ = _focus(spark, folder)
    return graph.suggested_files(nodes, edges, _entries(nodes, focus))


G12_SQL = b.with_graph("""
SELECT analysis_id, id, path, dependents, place FROM (SELECT analysis_id, id, path, dependents,
  row_number() OVER (PARTITION BY analysis_id ORDER BY slot) AS place FROM (
  SELECT analysis_id, id, path, dependents, min(slot) AS slot FROM (
    SELECT analysis_id, id, path, dependents, CASE WHEN r <= 3 AND dependents > 0 THEN r ELSE r + 10 END AS slot FROM ranked
    UNION ALL SELECT * FROM (SELECT DISTINCT ON (r.analysis_id) r.analysis_id, r.id, r.path, r.dependents, 3.5 FROM ranked r
      JOIN focus f ON f.analysis_id = r.analysis_id AND f.node_id = r.id ORDER BY r.analysis_id, r.path) x) y
  GROUP BY analysis_id, id, path, dependents) z) w WHERE place <= 4""", """
ranked AS (SELECT n.analysis_id, n.id, n.path, coalesce(d, 0) AS dependents,
  row_number() OVER (PARTITION BY n.analysis_id ORDER BY coalesce(d, 0) DESC, n.path, n.name) AS r FROM nodes n LEFT JOIN (
  SELECT analysis_id, target, count(*) AS d FROM edges WHERE kind IN ('imports', 'reexports') GROUP BY analysis_id, target) g
  ON g.analysis_id = n.analysis_id AND g.target = n.id WHERE n.kind = 'file')""")


def g13(spark, folder):
    nodes, edges, focus, files = _focus(spark, folder)
    return graph.walk(nodes, edges, files, focus)[0]


def _walk_sql() -> str:
    parts = [RELATIONS, """opts AS MATERIALIZED (SELECT r.analysis_id, r.source_file AS node, r.target_file AS nxt, n.path AS npath,
      NOT EXISTS (SELECT 1 FROM relations o WHERE o.analysis_id = r.analysis_id AND o.source_file = r.target_file) AS dead,
      r.kind, r.edge_id, r.start_line, r.end_line, f.line_count FROM relations r JOIN nodes n ON n.analysis_id = r.analysis_id AND n.id = r.target_file
      LEFT JOIN (SELECT analysis_id, id, end_line AS line_count FROM nodes WHERE kind = 'file') f ON f.analysis_id = r.analysis_id AND f.id = r.file_id)""",
             "w1 AS (SELECT request_id, analysis_id, node_id AS node, 1 AS step, CAST(NULL AS STRING) AS relationship, CAST(NULL AS STRING) AS citation FROM focus)",
             "t1 AS (SELECT * FROM w1)"]
    for s in range(2, 9):
        parts += [f"""w{s} AS MATERIALIZED (SELECT request_id, analysis_id, node, {s} AS step, relationship, citation FROM (
          SELECT w.request_id, w.analysis_id, o.nxt AS node, o.kind AS relationship,
            CASE WHEN o.start_line BETWEEN 1 AND o.end_line AND o.end_line <= o.line_count THEN concat('E', substr(sha256(o.edge_id), 1, 12)) END AS citation,
            row_number() OVER (PARTITION BY w.request_id ORDER BY o.dead, o.npath) AS pick
          FROM w{s - 1} w JOIN opts o ON o.analysis_id = w.analysis_id AND o.node = w.node
          WHERE NOT EXISTS (SELECT 1 FROM t{s - 1} t WHERE t.request_id = w.request_id AND t.node = o.nxt)) x WHERE pick = 1)""",
                  f"t{s} AS MATERIALIZED (SELECT * FROM t{s - 1} UNION ALL SELECT * FROM w{s})"]
    return b.with_graph("SELECT request_id, step, node, relationship, citation FROM t8", *parts)


G13_SQL = _walk_sql()


def g13_starts(spark, folder):
    nodes, _, focus, _ = _focus(spark, folder)
    routes = nodes.where("symbol_kind = 'class'").select("analysis_id", "path", "ord")
    return graph.walk_starts(nodes, _entries(nodes, focus).where("analysis_id = 'g:cur'"), routes)


G13_STARTS_SQL = b.with_graph("""
SELECT analysis_id, id, place FROM (SELECT analysis_id, id, row_number() OVER (PARTITION BY analysis_id ORDER BY tier, o, id) AS place FROM (
  SELECT analysis_id, id, tier, o FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, id ORDER BY tier, o) AS pick FROM (
    SELECT n.analysis_id, n.id, 0 AS tier, n.ord AS o FROM nodes n JOIN focus f ON f.analysis_id = n.analysis_id AND f.node_id = n.id
    WHERE n.analysis_id = 'g:cur'
    UNION ALL SELECT s.analysis_id, s.file_id, 1, s.ord FROM nodes s JOIN nodes f ON f.analysis_id = s.analysis_id AND f.id = s.file_id
    WHERE s.symbol_kind = 'class') x) y WHERE pick = 1) z) w WHERE place <= 30""")


def g14(spark, folder):
    return graph.directory_listing(files_of(spark, folder))


G14_SQL = b.with_members("""
SELECT analysis_id, '' AS parent, string_split(path, '/')[1] AS name, 'directory' AS kind, count(*) AS child_count FROM files
GROUP BY analysis_id, string_split(path, '/')[1]
UNION ALL SELECT analysis_id, string_split(path, '/')[1], string_split(path, '/')[2], 'directory', count(*) FROM files
WHERE len(string_split(path, '/')) = 3 GROUP BY analysis_id, string_split(path, '/')[1], string_split(path, '/')[2]
UNION ALL SELECT analysis_id, regexp_replace(path, '/[^/]*$', ''), regexp_extract(path, '([^/]*)$', 1), 'file', 0 FROM files""")


def g15(spark, folder):
    nodes, _ = b.graph(spark, folder)
    asked = spark.sql("SELECT concat('g:cur#', n_nationkey) AS request_id, 'g:cur' AS analysis_id, concat('n', n_nationkey, '/S') AS query FROM nation "
                      "UNION ALL SELECT concat('g:base#', r_regionkey), 'g:base', concat(' R', r_regionkey) FROM region")
    page, totals = graph.node_search(nodes, asked, 3, 20)
    return page.join(totals, "request_id")


G15_SQL = b.with_graph("""
SELECT request_id, id, kind, name, path, rank, total FROM (SELECT a.request_id, n.id, kind, name, path,
  row_number() OVER (PARTITION BY a.request_id ORDER BY lower(name) <> q, path, name, n.id) AS rank, count(*) OVER (PARTITION BY a.request_id) AS total
  FROM (SELECT concat('g:cur#', n_nationkey) AS request_id, 'g:cur' AS analysis_id, concat('n', n_nationkey, '/s') AS q FROM nation
        UNION ALL SELECT concat('g:base#', r_regionkey), 'g:base', concat('r', r_regionkey) FROM region) a
  JOIN nodes n ON n.analysis_id = a.analysis_id AND n.kind IN ('file', 'symbol') AND (contains(lower(name), q) OR contains(lower(path), q))) x
WHERE rank BETWEEN 4 AND 23""")

QUERIES = {
    "g1_neighbors": (g1, G1_SQL), "g1_neighbor_edges": (g1_edges, G1_EDGES_SQL), "g2_graph_project_files": (g2_files, G2_FILES_SQL),
    "g2_graph_project_modules": (g2_modules, G2_MODULES_SQL), "g3_module_boundaries": (g3, G3_SQL), "g4_module_rollup": (g4, G4_SQL),
    "g4_module_rollup_members": (g4_members, G4_MEMBERS_SQL), "g5_container_drill": (g5, G5_SQL), "g6_file_relationships": (g6, G6_SQL),
    "g7_impact": (g7, G7_SQL), "g8_impact_tests": (g8, G8_SQL), "g9_impact_routes": (g9, G9_SQL), "g10_edge_citation": (g10, G10_SQL),
    "g11_dependency_facts": (g11, G11_SQL), "g11_dependency_warnings": (g11_warnings, G11_WARNINGS_SQL), "g12_dependents_rank": (g12, G12_SQL), "g13_architecture_walk": (g13, G13_SQL),
    "g13_walk_starts": (g13_starts, G13_STARTS_SQL), "g14_directory_listing": (g14, G14_SQL), "g15_node_search": (g15, G15_SQL),
}
