"""Snapshot comparison, change review and data-quality queries."""
from pyspark.sql import functions as F

from ..operators import compare, quality
from . import bindings as b
from .intake_queries import files_of

SOURCE_PAIRS = "SELECT DISTINCT source AS pair_id, concat(source, ':base') AS base_id, concat(source, ':cur') AS current_id FROM documents"


def _pair(spark):
    return spark.sql("SELECT 'g' AS pair_id, 'g:base' AS base_id, 'g:cur' AS current_id FROM region WHERE r_regionkey = 0")


def d1(spark, folder):
    files = files_of(spark, folder)
    return compare.file_changes(spark.sql(SOURCE_PAIRS), files)


_D1 = """joined AS (SELECT coalesce(o.repository_id, n.repository_id) AS pair_id, coalesce(o.path, n.path) AS path, o.content AS old_content,
  n.content AS new_content FROM (SELECT * FROM files WHERE analysis_id LIKE '%:base') o
  FULL JOIN (SELECT * FROM files WHERE analysis_id LIKE '%:cur') n ON o.repository_id = n.repository_id AND o.path = n.path
  WHERE o.content IS DISTINCT FROM n.content)"""
D1_SQL = b.with_members("""SELECT pair_id, path, CASE WHEN old_content IS NULL THEN 'added' WHEN new_content IS NULL THEN 'removed' ELSE 'modified' END AS status,
  CAST(coalesce(len(string_split(old_content, chr(10))), 0) AS BIGINT) AS before_lines,
  CAST(coalesce(len(string_split(new_content, chr(10))), 0) AS BIGINT) AS after_lines FROM joined""", _D1)


def d2(spark, folder):
    nodes, _ = b.graph(spark, folder)
    return compare.symbol_delta(_pair(spark), nodes)


D2_SQL = b.with_graph("""SELECT 'g' AS pair_id, (SELECT count(*) FROM (SELECT path, name, symbol_kind FROM nodes WHERE kind = 'symbol' AND analysis_id = 'g:cur'
  EXCEPT SELECT path, name, symbol_kind FROM nodes WHERE kind = 'symbol' AND analysis_id = 'g:base') x) AS symbols_added,
  (SELECT count(*) FROM (SELECT path, name, symbol_kind FROM nodes WHERE kind = 'symbol' AND analysis_id = 'g:base'
  EXCEPT SELECT path, name, symbol_kind FROM nodes WHERE kind = 'symbol' AND analysis_id = 'g:cur') x) AS symbols_removed""")


def d3(spark, folder):
    nodes, edges = b.graph(spark, folder)
    return compare.relationship_delta(_pair(spark), nodes, edges)[0]


def d3_totals(spark, folder):
    nodes, edges = b.graph(spark, folder)
    return compare.relationship_delta(_pair(spark), nodes, edges)[1]


_D3 = """rel AS MATERIALIZED (SELECT e.analysis_id, s.kind AS sk1, coalesce(s.path, '') AS sp, s.name AS sn, coalesce(s.symbol_kind, '') AS ss,
  t.kind AS tk1, coalesce(t.path, '') AS tp, t.name AS tn, coalesce(t.symbol_kind, '') AS ts, e.kind FROM edges e JOIN nodes s ON s.k = e.sk
  JOIN nodes t ON t.k = e.tk WHERE e.kind <> 'contains'),
cur AS (SELECT DISTINCT * EXCLUDE (analysis_id) FROM rel WHERE analysis_id = 'g:cur'), old AS (SELECT DISTINCT * EXCLUDE (analysis_id) FROM rel WHERE analysis_id = 'g:base'),
moved AS MATERIALIZED (SELECT 'added' AS change, * FROM (SELECT * FROM cur EXCEPT SELECT * FROM old) x UNION ALL SELECT 'removed', * FROM (SELECT * FROM old EXCEPT SELECT * FROM cur) y)"""
D3_SQL = b.with_graph("""SELECT 'g' AS pair_id, change, rank, CASE WHEN sp <> '' THEN sp ELSE sn END AS source, sn AS source_name,
  CASE WHEN tp <> '' THEN tp ELSE tn END AS target, tn AS target_name, kind FROM (SELECT *, row_number() OVER (PARTITION BY change
  ORDER BY sk1, sp, sn, ss, tk1, tp, tn, ts, kind) AS rank FROM moved) x WHERE rank <= 250""", _D3)
D3_TOTALS_SQL = b.with_graph("""SELECT 'g' AS pair_id, added, removed, greatest(added - 250, 0) + greatest(removed - 250, 0) AS omitted FROM (
  SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed FROM moved) x""", _D3)


def d4(spark, folder):
    lines, _ = compare.line_delta(_source_pairs(spark, folder), files_of(spark, folder), 40)
    return lines.select("pair_id", "path", "change", "number", F.md5("line").alias("line"), "rank")


def d4_totals(spark, folder):
    return compare.line_delta(_source_pairs(spark, folder), files_of(spark, folder), 40)[1]


def _source_pairs(spark, folder):
    b.open_tables(spark, folder)
    return spark.sql(SOURCE_PAIRS)


_D4 = """sided AS (SELECT pair_id, path, unnest(string_split(old_content, chr(10))) AS line, generate_subscripts(string_split(old_content, chr(10)), 1) AS number, 'old' AS side FROM joined
  UNION ALL SELECT pair_id, path, unnest(string_split(new_content, chr(10))), generate_subscripts(string_split(new_content, chr(10)), 1), 'new' FROM joined),
copies AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id, path, side, line ORDER BY number) AS copy FROM sided),
moved AS MATERIALIZED (SELECT o.pair_id, o.path, 'removed' AS change, o.number, o.line FROM (SELECT * FROM copies WHERE side = 'old') o
    ANTI JOIN (SELECT * FROM copies WHERE side = 'new') n ON n.pair_id = o.pair_id AND n.path = o.path AND n.line = o.line AND n.copy = o.copy
  UNION ALL SELECT n.pair_id, n.path, 'added', n.number, n.line FROM (SELECT * FROM copies WHERE side = 'new') n
    ANTI JOIN (SELECT * FROM copies WHERE side = 'old') o ON n.pair_id = o.pair_id AND n.path = o.path AND n.line = o.line AND n.copy = o.copy)"""
D4_SQL = b.with_members("""SELECT pair_id, path, change, number, md5(line) AS line, rank FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, path
  ORDER BY number, change, line) AS rank FROM moved) x WHERE rank <= 40""", _D1, _D4)
D4_TOTALS_SQL = b.with_members("""SELECT j.pair_id, j.path, j.path NOT LIKE '%package.json' AS redacted, count(m.line) AS lines, greatest(count(m.line) - 40, 0) AS omitted_lines
  FROM joined j LEFT JOIN moved m ON m.pair_id = j.pair_id AND m.path = j.path GROUP BY j.pair_id, j.path""", _D1, _D4)


def d5(spark, folder):
    b.open_tables(spark, folder)
    analyses = b.members(spark, folder).select("analysis_id", "repository_id").distinct()
    pairs = spark.sql("SELECT concat(d.source, '/', e.source) AS pair_id, concat(d.source, ':base') AS base_id, concat(e.source, ':cur') AS current_id "
                      "FROM documents d JOIN documents e ON e.doc_id = d.doc_id + d.n_chars % 2")
    return compare.same_repository(pairs.distinct(), analyses)


D5_SQL = """SELECT DISTINCT concat(d.source, '/', e.source) AS pair_id, concat(d.source, ':base') AS base_id, concat(e.source, ':cur') AS current_id,
  d.source = e.source AS allowed FROM documents d JOIN documents e ON e.doc_id = d.doc_id + d.n_chars % 2"""

_CHANGES = """SELECT source AS change_id, concat(source, CASE WHEN d.source IN ('src1', 'src2') THEN ':base' ELSE ':cur' END) AS analysis_id,
  concat(source, ':cur') AS head_sha, CASE WHEN d.source = 'src2' THEN 'elsewhere' ELSE concat(source, ':base') END AS base_sha,
  concat(CASE d.doc_id % 4 WHEN 0 THEN 'routes' WHEN 1 THEN 'services' WHEN 2 THEN 'test' ELSE 'lib' END, '/d', d.doc_id,
         CASE WHEN d.lang = 'fr' THEN '.moved' WHEN d.doc_id % 12 = 0 THEN '.py' WHEN d.doc_id % 12 = 1 THEN '.java' ELSE '.ts' END) AS filename,
  concat(CASE d.doc_id % 4 WHEN 0 THEN 'routes' WHEN 1 THEN 'services' WHEN 2 THEN 'test' ELSE 'lib' END, '/d', d.doc_id,
         CASE WHEN d.doc_id % 12 = 0 THEN '.py' WHEN d.doc_id % 12 = 1 THEN '.java' ELSE '.ts' END) AS previous_filename,
  CASE WHEN d.lang = 'fr' THEN 'renamed' ELSE 'modified' END AS status FROM documents d"""


def d6(spark, folder):
    files = files_of(spark, folder)
    snapshots = files.select("analysis_id", F.col("analysis_id").alias("commit_sha")).distinct()
    return compare.changed_file_coverage(spark.sql(_CHANGES), files, snapshots, "ROUTES/", "modified")


D6_SQL = b.with_members("""SELECT change_id, revision, count(*) AS files, CAST(sum(CASE WHEN revision <> 'none' AND present THEN 1 ELSE 0 END) AS BIGINT) AS in_snapshot,
  CAST(sum(CASE WHEN filename LIKE 'routes/%' AND status = 'modified' THEN 1 ELSE 0 END) AS BIGINT) AS visible FROM (
  SELECT c.*, EXISTS (SELECT 1 FROM files f WHERE f.analysis_id = c.analysis_id AND f.path = CASE WHEN revision = 'base' AND status = 'renamed'
    THEN previous_filename ELSE filename END) AS present FROM (SELECT *, CASE WHEN analysis_id = head_sha THEN 'head' WHEN analysis_id = base_sha THEN 'base' ELSE 'none' END AS revision
    FROM (""" + _CHANGES + """) r) c) x GROUP BY change_id, revision""")


def d9(spark, folder):
    log = b.bound(spark, folder, b.LOG).select("user_id", "event_id", "ts", "event_type")
    return compare.paged_listing(log, "user_id", "ts", "event_id", 2, 20)


D9_SQL = """SELECT user_id, event_id, ts, event_type, rank, n > 40 AS has_more FROM (SELECT user_id, event_id, ts, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM events) x WHERE rank BETWEEN 21 AND 40"""


def v1(spark, folder):
    return quality.dangling_edges(*b.graph(spark, folder))


V1_SQL = b.with_graph("""SELECT e.analysis_id, e.id, 'source' AS side, source AS missing FROM edges e ANTI JOIN nodes n ON n.k = e.sk
UNION ALL SELECT e.analysis_id, e.id, 'target', target FROM edges e ANTI JOIN nodes n ON n.k = e.tk""")


def v2(spark, folder):
    b.open_tables(spark, folder)
    return quality.duplicate_ids(spark.sql("SELECT 'lines' AS analysis_id, concat(l_orderkey, ':', l_linenumber) AS id FROM lineitem"), ["analysis_id", "id"])


V2_SQL = "SELECT 'lines' AS analysis_id, concat(l_orderkey, ':', l_linenumber) AS id, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1"

_SPANS = """SELECT analysis_id, concat(path, '#', lang) AS id, CASE WHEN lang = 'es' THEN 'file:gone' ELSE concat('file:', path) END AS file_id,
  CAST(ord % 9 AS INT) AS start_line, CAST(ord % 9 + 5 AS INT) AS end_line, CAST(0 AS BIGINT) AS start_byte, CAST(ord * 4 AS BIGINT) AS end_byte FROM members"""


def v3(spark, folder):
    m = b.members(spark, folder)
    files = m.select("analysis_id", F.concat(F.lit("file:"), "path").alias("file_id"), (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).alias("line_count"),
                     F.octet_length("content").alias("byte_count"))
    return quality.bad_ranges(b.sql_frame(spark, _SPANS, members=m), files)


V3_SQL = b.with_members("""SELECT analysis_id, concat(path, '#', lang) AS id, reason FROM (SELECT *, CASE WHEN lang = 'es' THEN 'unknown_file'
  WHEN ord % 9 < 1 OR ord % 9 + 5 > len(string_split(content, chr(10))) THEN 'lines' WHEN ord * 4 > octet_length(encode(content)) THEN 'bytes' END AS reason FROM members) x WHERE reason IS NOT NULL""")


def v4(spark, folder):
    nodes, edges = b.graph(spark, folder)
    bent = edges.withColumn("resolution", F.when(F.col("type_only"), "guessed").otherwise(F.col("resolution"))).withColumn(
        "kind", F.when(F.col("start_line") == 7, "mentions").otherwise(F.col("kind")))
    return quality.broken_rules(bent, quality.edge_rules()).unionByName(quality.broken_rules(nodes.withColumn(
        "name", F.when(F.col("language") == "python", None).otherwise(F.col("name"))), quality.node_rules()))


V4_SQL = b.with_graph("""SELECT analysis_id, id, 'resolution' AS rule FROM edges WHERE type_only UNION ALL SELECT analysis_id, id, 'kind' FROM edges WHERE start_line = 7
UNION ALL SELECT analysis_id, id, 'name' FROM nodes WHERE language = 'python'""")


def v5(spark, folder):
    nodes, edges = b.graph(spark, folder)
    declared = spark.sql("SELECT 'g:cur' AS analysis_id, 'nodes' AS table_name, count(*) AS declared FROM orders UNION ALL "
                         "SELECT 'g:base', 'edges', count(*) FROM lineitem")
    return quality.count_mismatches(declared, {"nodes": nodes, "edges": edges})


V5_SQL = b.with_graph("""SELECT * FROM (SELECT coalesce(a.analysis_id, d.analysis_id) AS analysis_id, coalesce(a.t, d.t) AS table_name, coalesce(d.n, 0) AS declared, coalesce(a.n, 0) AS actual
FROM (SELECT analysis_id, 'nodes' AS t, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT analysis_id, 'edges', count(*) FROM edges GROUP BY 1) a
FULL JOIN (SELECT 'g:cur' AS analysis_id, 'nodes' AS t, count(*) AS n FROM orders UNION ALL SELECT 'g:base', 'edges', count(*) FROM lineitem) d
  ON d.analysis_id = a.analysis_id AND d.t = a.t) x WHERE declared <> actual""")


def v6(spark, folder):
    m = b.members(spark, folder)
    files = m.select("analysis_id", F.concat(F.lit("file:"), "path").alias("file_id"), (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).alias("line_count"))
    cites = b.sql_frame(spark, _SPANS, members=m).withColumnRenamed("id", "citation_id")
    return quality.bad_citations(cites, files)


V6_SQL = b.with_members("""SELECT analysis_id, concat(path, '#', lang) AS citation_id, CASE WHEN lang = 'es' THEN 'unknown_file' ELSE 'lines' END AS reason FROM members
WHERE lang = 'es' OR ord % 9 < 1 OR ord % 9 + 5 > len(string_split(content, chr(10)))""")

# Answers are conversations: turns are blocks; a user turn is a fact, and cites the turn number of what it follows.
_BLOCKS = """SELECT conv_id AS answer_id, turn AS block_no, CASE role WHEN 'user' THEN 'fact' WHEN 'assistant' THEN 'inference' ELSE 'unknown' END AS kind,
  CASE WHEN length(text) % 5 = 0 THEN '' ELSE concat('S', turn) END AS cite, CASE WHEN length(text) % 7 = 0 THEN concat('E', turn) ELSE '' END AS edge FROM conversations"""
_REGISTRY = "SELECT conv_id AS answer_id, concat('S', turn) AS citation_id FROM conversations WHERE length(text) > 60"
_RELATIONS = "SELECT conv_id AS answer_id, concat('E', turn) AS edge_id FROM conversations WHERE role <> 'system' AND length(text) % 2 = 0"


def v7(spark, folder):
    b.open_tables(spark, folder)
    one = lambda c: F.filter(F.array(c), lambda x: x != "")
    blocks = spark.sql(_BLOCKS).select("answer_id", "block_no", "kind", one("cite").alias("citation_ids"), one("edge").alias("edge_ids"))
    return quality.grounding(blocks, spark.sql(_REGISTRY), spark.sql(_RELATIONS))


V7_SQL = f"""WITH blocks AS ({_BLOCKS}), registry AS ({_REGISTRY}), relations AS ({_RELATIONS}), per AS (
  SELECT b.answer_id, count(*) AS blocks, count(DISTINCT r.citation_id) AS citations_used, sum(CASE WHEN kind = 'fact' AND cite = '' THEN 1 ELSE 0 END) AS uncited,
    sum(CASE WHEN cite <> '' AND r.citation_id IS NULL THEN 1 ELSE 0 END) AS odd, sum(CASE WHEN edge <> '' AND e.edge_id IS NULL THEN 1 ELSE 0 END) AS odd_edges,
    max(CASE WHEN kind = 'inference' THEN 1 ELSE 0 END) = 1 AS inference_warning
  FROM blocks b LEFT JOIN registry r ON r.answer_id = b.answer_id AND r.citation_id = cite LEFT JOIN relations e ON e.answer_id = b.answer_id AND e.edge_id = edge GROUP BY b.answer_id)
SELECT answer_id, blocks, citations_used, odd = 0 AND odd_edges = 0 AND uncited = 0 AND blocks <= 20 AS valid,
  CASE WHEN blocks > 20 THEN 'shape' WHEN odd > 0 THEN 'citation' WHEN odd_edges > 0 THEN 'relationship' WHEN uncited > 0 THEN 'uncited_fact' END AS reason, inference_warning FROM per"""


# Here an assistant's block cites what the user's block before it cites.
_FOLLOWING = f"""SELECT answer_id, block_no, cite, CASE WHEN kind = 'inference' THEN concat('S', block_no - 1) ELSE '' END AS also FROM ({_BLOCKS}) z"""


def v7_used(spark, folder):
    b.open_tables(spark, folder)
    blocks = spark.sql(_FOLLOWING).select("answer_id", "block_no", F.filter(F.array("cite", "also"), lambda x: x != "").alias("citation_ids"))
    return quality.used_citations(blocks, spark.sql(_REGISTRY))


V7_USED_SQL = f"""SELECT answer_id, citation_id, min(block_no) AS first_block, count(*) AS uses FROM (SELECT DISTINCT answer_id, block_no, citation_id FROM (
  SELECT answer_id, block_no, cite AS citation_id FROM ({_FOLLOWING}) a UNION ALL SELECT answer_id, block_no, also FROM ({_FOLLOWING}) c) u) d
WHERE EXISTS (SELECT 1 FROM ({_REGISTRY}) r WHERE r.answer_id = d.answer_id AND r.citation_id = d.citation_id) GROUP BY answer_id, citation_id"""


def v8(spark, folder):
    b.open_tables(spark, folder)
    bent = spark.sql("SELECT vec_id AS id, CASE WHEN label = 1 THEN slice(embedding, 1, 63) WHEN label = 2 THEN transform(embedding, x -> cast(0 AS float)) "
                     "WHEN label = 3 THEN transform(embedding, x -> cast('NaN' AS float)) ELSE embedding END AS embedding FROM embeddings")
    return quality.bad_vectors(bent, 64)


V8_SQL = "SELECT vec_id AS id, CASE label WHEN 1 THEN 'dimension' WHEN 2 THEN 'zero' ELSE 'not_finite' END AS problem FROM embeddings WHERE label IN (1, 2, 3)"


_SENT, _RECEIVED = ("SELECT cast(floor(vec_id / 8) AS bigint) AS batch_id, vec_id FROM embeddings", "SELECT cast(floor(vec_id / 8) AS bigint) AS batch_id, vec_id FROM embeddings WHERE label <> 2")


def v8_batches(spark, folder):
    """Batches of eight inputs; the answer lacks the vectors of one label."""
    b.open_tables(spark, folder)
    return quality.batch_mismatches(spark.sql(_SENT), spark.sql(_RECEIVED))


V8_BATCHES_SQL = f"""SELECT batch_id, asked, coalesce(returned, 0) AS returned FROM (SELECT batch_id, count(*) AS asked FROM ({_SENT}) s GROUP BY batch_id) a
LEFT JOIN (SELECT batch_id, count(*) AS returned FROM ({_RECEIVED}) r GROUP BY batch_id) g USING (batch_id) WHERE asked <> coalesce(returned, 0)"""

QUERIES = {
    "d1_file_changes": (d1, D1_SQL), "d2_symbol_delta": (d2, D2_SQL), "d3_relationship_delta": (d3, D3_SQL), "d3_relationship_totals": (d3_totals, D3_TOTALS_SQL),
    "d4_line_delta": (d4, D4_SQL), "d4_line_totals": (d4_totals, D4_TOTALS_SQL), "d5_same_repository_guard": (d5, D5_SQL), "d6_changed_file_coverage": (d6, D6_SQL),
    "d9_paged_listing": (d9, D9_SQL), "v1_dangling_edges": (v1, V1_SQL), "v2_duplicate_nodes": (v2, V2_SQL), "v3_range_check": (v3, V3_SQL),
    "v4_enum_and_schema_check": (v4, V4_SQL), "v5_count_reconcile": (v5, V5_SQL), "v6_citation_check": (v6, V6_SQL), "v7_answer_grounding": (v7, V7_SQL),
    "v7_used_citations": (v7_used, V7_USED_SQL), "v8_vector_check": (v8, V8_SQL), "v8_batch_equality": (v8_batches, V8_BATCHES_SQL),
}
