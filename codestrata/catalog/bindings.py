"""Driver tables read as a code corpus. The SQL runs unchanged in Spark and in the checking engine.

members: every document rendered twice, as a member of a ``base`` and a ``cur`` snapshot of its source. The text of the
document is kept whole, behind a few lines of code that name other documents of the same source.
"""
from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage, tasks_by_rows

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


_frames: dict[tuple[str, str], dict[str, DataFrame]] = {}


def open_tables(spark: SparkSession, folder: str) -> None:
    """Register the driver tables as views; file footers are read once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _frames:
        _frames[key] = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in TABLES}
    for name, frame in _frames[key].items():
        frame.createOrReplaceTempView(name)


def _comment(marker: str) -> str:
    return f"concat('{marker} ', replace(text, chr(10), concat(chr(10), '{marker} ')))"


NL = "chr(10)"

_BODY = f"""CASE doc_id % 12
  WHEN 0 THEN concat('import os', {NL}, 'import fastapi', {NL}, 'from fastapi import APIRouter', {NL},
    'from .d', doc_id + 60, ' import run', doc_id + 60, {NL}, 'import ', dir, '.d', doc_id + 120, {NL},
    'router = APIRouter(prefix=''/api'')', {NL}, '@router.get(''/items/', doc_id, ''')', {NL},
    'def run', doc_id, '(x):', {NL}, '    return helper', doc_id, '(x)', {NL},
    'def helper', doc_id, '(x):', {NL}, '    return x', {NL},
    'class Model', doc_id, ':', {NL}, '    def save(self):', {NL}, '        return run', doc_id, '(self)', {NL},
    {_comment('#')})
  WHEN 1 THEN concat('package com.acme.', dir, ';', {NL}, 'import com.acme.', dir, '.d', doc_id + 60, ';', {NL},
    'import static com.acme.', dir, '.d', doc_id + 120, '.VALUE;', {NL}, 'import java.util.List;', {NL},
    'import org.springframework.boot.*;', {NL}, '@RestController', {NL}, '@RequestMapping("/api")', {NL},
    'public class d', doc_id, ' {{', {NL}, '  @GetMapping("/items/', doc_id, '")', {NL},
    '  public String run(String x) {{', {NL}, '    return x;', {NL}, '  }}', {NL}, '}}', {NL}, {_comment('//')})
  WHEN 2 THEN concat('import express from "express";', {NL}, 'import {{ run', doc_id + 60, ' }} from "./d', doc_id + 60, '";',
    {NL}, 'import type {{ Shape }} from "./d', doc_id + 120, '.js";', {NL}, 'export {{ run', doc_id + 60, ' }} from "./d',
    doc_id + 60, '";', {NL}, 'const lazy = import("./d', doc_id + 120, '");', {NL},
    'export function run', doc_id, '(x) {{', {NL}, '  return run', doc_id + 60, '(x);', {NL}, '}}', {NL}, {_comment('//')})
  WHEN 3 THEN concat('import {{ Card', doc_id + 60, ' }} from "./d', doc_id + 60, '";', {NL},
    'export function Card', doc_id, '() {{', {NL}, '  return <Card', doc_id + 60, ' />;', {NL}, '}}', {NL}, {_comment('//')})
  WHEN 5 THEN concat('const dep = require("./d', doc_id + 60, '");', {NL}, 'function run', doc_id, '(x) {{', {NL},
    '  return x;', {NL}, '}}', {NL}, {_comment('//')})
  WHEN 8 THEN concat('{{"name": "@w/d', doc_id, '", "main": "src/index.js", "dependencies": {{"react": "18", "lib-', lang,
    '": "1"}}, "devDependencies": {{"stripe": "2"}}, "digest": "', md5(text), '"}}')
  WHEN 9 THEN concat('fastapi[all]>=0.1', {NL}, '-r base.txt', {NL}, 'lib_', lang, '==1.0', {NL}, 'celery<5', {NL},
    {_comment('#')})
  WHEN 10 THEN concat('<artifactId>spring-boot-starter-web</artifactId>', {NL}, '<artifactId>', source,
    '-postgresql</artifactId>', {NL}, text)
  ELSE text END"""

_FILE = """concat(dir, CASE doc_id % 12 WHEN 0 THEN '/d' WHEN 1 THEN '/d' WHEN 4 THEN '/n' WHEN 8 THEN '/n' WHEN 9 THEN '/n'
   WHEN 10 THEN '/n' ELSE '/d' END, doc_id, CASE doc_id % 12 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.ts'
   WHEN 3 THEN '.tsx' WHEN 4 THEN '/README.md' WHEN 5 THEN '.js' WHEN 6 THEN '.min.js' WHEN 7 THEN '.pem'
   WHEN 8 THEN '/package.json' WHEN 9 THEN '/requirements.txt' WHEN 10 THEN '/pom.xml' ELSE '.mjs' END)"""

MEMBERS = f"""
SELECT doc_id AS ord, source AS repository_id, concat(source, ':', snap) AS analysis_id,
       {_FILE} AS path, concat(source, '-main/', {_FILE}) AS member, text, lang,
       concat({_BODY}, CASE WHEN doc_id % 12 = 8 THEN '' ELSE concat({NL}, 'const password = "', md5(text), '";') END,
              CASE WHEN snap = 'cur' AND quality = 1 THEN CASE WHEN doc_id % 12 = 8 THEN ' ' ELSE concat({NL}, 'changed') END
                   ELSE '' END) AS content
FROM (SELECT d.doc_id, d.source, d.text, d.lang, l.quality, 'cur' AS snap,
             CASE d.doc_id % 4 WHEN 0 THEN 'routes' WHEN 1 THEN 'services' WHEN 2 THEN 'test' ELSE 'lib' END AS dir
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.quality, 1) = 1
      UNION ALL
      SELECT d.doc_id, d.source, d.text, d.lang, l.quality, 'base' AS snap,
             CASE d.doc_id % 4 WHEN 0 THEN 'routes' WHEN 1 THEN 'services' WHEN 2 THEN 'test' ELSE 'lib' END AS dir
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) = 0) s
"""

# Files as the checking engine sees them after profiling: the planted secret masked, ineligible names gone.
FILES_ORACLE = """
SELECT ord, repository_id, analysis_id, path, concat('file:', path) AS file_id, text, lang,
       CASE ord % 12 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'typescript' WHEN 3 THEN 'typescript'
         WHEN 4 THEN 'markdown' WHEN 5 THEN 'javascript' WHEN 8 THEN 'json' WHEN 9 THEN 'text' WHEN 10 THEN 'xml'
         ELSE 'javascript' END AS language,
       CASE WHEN ord % 12 = 8 THEN content ELSE replace(content, md5(text), repeat('*', 32)) END AS content
FROM members WHERE ord % 12 NOT IN (6, 7)
"""

_NODE_ROWS = """
SELECT 'repo' AS id, 'repository' AS kind, 'Repository' AS name, CAST(NULL AS STRING) AS path,
       CAST(NULL AS STRING) AS file_id, CAST(NULL AS STRING) AS parent_id, CAST(NULL AS STRING) AS language,
       CAST(NULL AS STRING) AS symbol_kind, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line,
       CAST(0 AS BIGINT) AS ord, '' AS status
UNION ALL
SELECT concat('module:r', r_regionkey), 'module', r_name, concat('r', r_regionkey), NULL, 'repo', NULL, NULL, NULL, NULL,
       CAST(r_regionkey AS BIGINT) * 8 + 1, ''
FROM region
UNION ALL
SELECT concat('module:r', n_regionkey, '/n', n_nationkey), 'module', n_name, concat('r', n_regionkey, '/n', n_nationkey),
       NULL, concat('module:r', n_regionkey), NULL, NULL, NULL, NULL, CAST(n_nationkey AS BIGINT) * 8 + 2, ''
FROM nation
UNION ALL
SELECT concat('file:s', s_suppkey), 'file', concat('s', s_suppkey, '.py'),
       concat('r', n_regionkey, '/n', n_nationkey, '/s', s_suppkey, '.py'), concat('file:s', s_suppkey),
       concat('module:r', n_regionkey, '/n', n_nationkey), 'python', NULL, 1, 10, s_suppkey * 8 + 3, ''
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT concat('file:c', c_custkey), 'file',
       concat('c', c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '.test.ts' ELSE '.ts' END),
       concat('r', n_regionkey, '/n', n_nationkey, '/c', c_custkey,
              CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '.test.ts' ELSE '.ts' END), concat('file:c', c_custkey),
       concat('module:r', n_regionkey, '/n', n_nationkey), 'typescript', NULL, 1, 5, c_custkey * 8 + 4, ''
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT concat('symbol:o', o_orderkey), 'symbol', concat('o', o_orderkey),
       concat('r', n_regionkey, '/n', n_nationkey, '/c', c_custkey,
              CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '.test.ts' ELSE '.ts' END), concat('file:c', c_custkey),
       concat('file:c', c_custkey), 'typescript', CASE WHEN o_orderpriority = '2-HIGH' THEN 'class' ELSE 'function' END,
       1, 3, o_orderkey * 8 + 5, o_orderstatus
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderpriority <> '5-LOW'
UNION ALL
SELECT concat('external:p', p_partkey), 'external', p_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       p_partkey * 8 + 6, ''
FROM part
"""

_NODE_COLUMNS = ("id, kind, name, path, file_id, parent_id, language, symbol_kind, start_line, end_line, ord")

# Two snapshots of one repository: the orders of each are the symbols that were open, or had been closed, by then.
NODES = f"""
SELECT 'g:cur' AS analysis_id, {_NODE_COLUMNS} FROM ({_NODE_ROWS}) n WHERE status <> 'F'
UNION ALL
SELECT 'g:base' AS analysis_id, {_NODE_COLUMNS} FROM ({_NODE_ROWS}) n WHERE status <> 'O'
"""

_LINES = """
SELECT 'g:cur' AS analysis_id, o_custkey, l_orderkey, l_suppkey, l_partkey, l_linenumber, l_linestatus, l_shipdate,
       l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'
UNION ALL
SELECT 'g:base' AS analysis_id, o_custkey, l_orderkey, l_suppkey, l_partkey, l_linenumber, l_linestatus, l_shipdate,
       l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'
"""

EDGES = f"""
SELECT analysis_id, concat('contains:', parent_id, ':', id) AS id, parent_id AS source, id AS target,
       'contains' AS kind, CAST(NULL AS STRING) AS file_id, CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line,
       'structural' AS resolution, false AS type_only, ord
FROM nodes WHERE parent_id IS NOT NULL
UNION ALL
SELECT analysis_id, concat(CASE WHEN kind = 'reexports' THEN 'r:' ELSE 'i:' END, o_custkey, ':', l_suppkey),
       concat('file:c', o_custkey), concat('file:s', l_suppkey), kind, concat('file:c', o_custkey), min_line, min_line,
       'resolved', min_date = max_date, first_ord
FROM (SELECT analysis_id, o_custkey, l_suppkey, CASE WHEN l_linestatus = 'F' THEN 'reexports' ELSE 'imports' END AS kind,
             min(l_linenumber) AS min_line, min(l_shipdate) AS min_date, max(l_shipdate) AS max_date,
             min(l_orderkey) AS first_ord
      FROM ({_LINES}) li WHERE l_returnflag = 'R'
      GROUP BY analysis_id, o_custkey, l_suppkey,
               CASE WHEN l_linestatus = 'F' THEN 'reexports' ELSE 'imports' END) e
UNION ALL
SELECT analysis_id, concat('c:', l_suppkey, ':', l_orderkey), concat('file:s', l_suppkey), concat('symbol:o', l_orderkey),
       'calls', concat('file:s', l_suppkey), min_line, min_line, 'resolved', false, l_orderkey
FROM (SELECT analysis_id, l_orderkey, l_suppkey, min(l_linenumber) AS min_line
      FROM ({_LINES}) li WHERE l_returnflag = 'A' GROUP BY analysis_id, l_orderkey, l_suppkey) e
UNION ALL
SELECT analysis_id, concat('u:', l_orderkey, ':', l_partkey), concat('symbol:o', l_orderkey), concat('external:p', l_partkey),
       'references', concat('file:c', o_custkey), min_line, min_line + 2, 'resolved', false, l_orderkey
FROM (SELECT analysis_id, l_orderkey, l_partkey, o_custkey, min(l_linenumber) AS min_line
      FROM ({_LINES}) li WHERE l_returnflag = 'N' GROUP BY analysis_id, l_orderkey, l_partkey, o_custkey) e
"""

# One file per nation and snapshot to start from: its best-funded supplier.
_BEST_FUNDED = """SELECT s_suppkey, s_nationkey,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS pick FROM supplier"""

FOCUS = f"""
SELECT concat('g:cur#', s_nationkey) AS request_id, 'g:cur' AS analysis_id, concat('file:s', s_suppkey) AS node_id
FROM ({_BEST_FUNDED}) s WHERE pick = 1
UNION ALL
SELECT concat('g:base#', s_nationkey), 'g:base', concat('file:s', s_suppkey) FROM ({_BEST_FUNDED}) s WHERE pick = 1
"""

# Graph file records: line counts as in the file nodes.
GRAPH_FILES = """
SELECT analysis_id, id AS file_id, path, end_line AS line_count FROM nodes WHERE kind = 'file'
"""

# Whole documents as retrieval chunks; a file is one directory of a source.
CHUNKS = """
SELECT concat('corpus:', lang) AS analysis_id, concat('chunk:', doc_id) AS chunk_id, doc_id AS ord,
       concat('file:', source, '/', dir, '/bundle.', ext) AS file_id, concat(source, '/', dir, '/bundle.', ext) AS path,
       concat('run', doc_id, CASE WHEN quality = 1 THEN 'Route' WHEN toxic = 1 THEN 'Security' ELSE 'Step' END) AS symbol,
       CASE WHEN quality = 1 THEN 'function' WHEN quality = 0 THEN 'declarations' ELSE 'top-level' END AS kind,
       CAST(doc_id + 1 AS BIGINT) AS start_line, CAST(doc_id + 1 AS BIGINT) AS end_line, text
FROM (SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic,
             CASE WHEN d.n_chars < 200 THEN 'test' WHEN d.n_chars < 900 THEN 'services' ELSE 'routes' END AS dir,
             CASE WHEN d.n_chars < 900 THEN 'py' ELSE 'ts' END AS ext
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) s
"""

QUESTIONS = " UNION ALL ".join(
    f"SELECT concat('q', item_id, '{lang}') AS request_id, 'corpus:{lang}' AS analysis_id, text AS question FROM benchmark"
    for lang in ("en", "fr", "de", "es"))

LOG = """
SELECT event_id, ts, user_id, event_type, value, props, CAST(floor(value * 10) AS BIGINT) + 128 AS tokens,
       CASE WHEN event_type = 'purchase' THEN 'query' ELSE 'index' END AS class
FROM events
"""


def sql_frame(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(sql)


def members(spark: SparkSession, folder: str) -> DataFrame:
    open_tables(spark, folder)
    return spark.sql(MEMBERS)


_graphs: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables, written once per session and folder to the checkpoint folder as a job would store them."""
    open_tables(spark, folder)
    key = (spark.sparkContext.applicationId, folder)
    if key not in _graphs:
        tables = _frames[key]
        with tasks_by_rows(spark, max(tables[name].count() for name in ("customer", "supplier", "part", "orders", "lineitem"))):
            nodes = cut_lineage(spark.sql(NODES))
            _graphs[key] = nodes, cut_lineage(sql_frame(spark, EDGES, nodes=nodes))
    nodes, edges = _graphs[key]
    nodes.createOrReplaceTempView("nodes")
    return nodes, edges


def bound(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    open_tables(spark, folder)
    return spark.sql(sql)


def with_members(select: str, *extra: str) -> str:
    parts = [f"members AS ({MEMBERS})", f"files AS ({FILES_ORACLE})", *extra]
    return "WITH " + ", ".join(parts) + " " + select


def with_graph(select: str, *extra: str) -> str:
    # k, sk and tk are one-column join keys, so the checking engine does not pair nodes by snapshot alone.
    parts = [f"nodes AS MATERIALIZED (SELECT *, concat(analysis_id, '|', id) AS k FROM ({NODES}) n)",
             f"edges AS MATERIALIZED (SELECT *, concat(analysis_id, '|', source) AS sk, concat(analysis_id, '|', target) AS tk "
             f"FROM ({EDGES}) e)", f"focus AS ({FOCUS})", *extra]
    return "WITH " + ", ".join(parts) + " " + select


def with_chunks(select: str, *extra: str) -> str:
    parts = [f"chunks AS MATERIALIZED ({CHUNKS})", f"questions AS ({QUESTIONS})", *extra]
    return "WITH " + ", ".join(parts) + " " + select


def with_log(select: str, *extra: str) -> str:
    return "WITH " + ", ".join([f"log AS ({LOG})", *extra]) + " " + select
