"""Relationship extraction over sources that wrap lines, nest blocks and hide code-like text in strings and comments.

Every document is rendered as one Python, Java or TypeScript file of its source's snapshot; its whole text stands in a
docstring or behind comment marks. The SQL builds the same parts and counts lines and bytes in them.
"""
from pyspark.sql import functions as F

from ..operators import extract
from ..plans import snapshot
from ..session import cut_lineage
from ..sources import snapshots
from . import bindings as b

NL = "chr(10)"


def _lines(*lines: str) -> str:
    """SQL for lines of text; ``{n}`` is the document's number, ``{m}`` that of the document it imports."""
    parts = []
    for line in lines:
        quoted = line.replace("'", "''")
        for mark, column in (("{n}", "n"), ("{m}", "m"), ("{f}", "f")):
            quoted = quoted.replace(mark, f"', {column}, '")
        parts += [f"'{quoted}'", NL]
    return f"concat({', '.join(parts)})"


_COMMENTED = "concat('// ', replace(body, chr(10), concat(chr(10), '// ')), chr(10))"
_QUOTED = "concat(replace(replace(body, chr(34), chr(39)), chr(92), '/'), chr(10))"

# The parts of a file: before the first symbol, a symbol outside any class, between, a class up to its member, the member,
# the rest of the class, the rest of the file.
PARTS = f"""
SELECT doc_id, source AS analysis_id, language, path, concat(head, filler) AS p0, s1, p1, c0, m1, c1, p2 FROM (
SELECT *, CASE language WHEN 'python' THEN {_lines('"""Notes of {n}', 'import ghost{n}; def ghost():')}
    WHEN 'java' THEN {_lines('package com.acme.p{f};', 'import com.acme.p{f}.M{m};', 'import static java.util.List.of;')}
    ELSE {_lines('import express from "express";', 'import {', '  run{m} as go,', '} from "./m{m}";', 'const app = express();')} END AS head,
  CASE language WHEN 'python' THEN concat({_QUOTED}, {_lines('"""', 'from fastapi import (', '    APIRouter as Made,  # ) not the end', ')', 'from fastapi import APIRouter',
      'from .m{m} import (', '    run{m} as go,', ')', 'import os; import sys as system', 'router = APIRouter(', '    prefix="/v{n}",', ')')})
    WHEN 'java' THEN concat({_COMMENTED}, {_lines('@RestController', '@RequestMapping(value = {"/j{n}"})')}, 'public ')
    ELSE {_COMMENTED} END AS filler,
  CASE language WHEN 'python' THEN {_lines('@router.get(', '    "/items",', ')', 'def run{n}(', '    a,', '):', '    return go(a)')}
    WHEN 'java' THEN '' ELSE concat('export function run', n, '({{ a }}: {{ a: number }}) {{', {NL}, '  if (a) {{ return go("}}"); }}', {NL}, '}}') END AS s1,
  CASE language WHEN 'python' THEN '' WHEN 'java' THEN '' ELSE {NL} END AS p1,
  CASE language WHEN 'python' THEN concat('class Box', n, ':', {NL}) WHEN 'java' THEN concat('class M', n, ' {{', {NL}, '  private M', m, ' next = new M', m, '();', {NL}, '  ')
    ELSE concat('export class Box', n, ' {{', {NL}, '  ') END AS c0,
  CASE language WHEN 'python' THEN {_lines('    async def _open(self): return run{n}(', '        "x")')}
    WHEN 'java' THEN concat('@GetMapping(', {NL}, '    "/items"', {NL}, '  )', {NL}, '  public String run(@RequestParam("q") String q) {{', {NL}, '    return M', m, '.text(q);', {NL}, '  }}')
    ELSE concat('open(x: number): number {{', {NL}, '    return run', n, '(x);', {NL}, '  }}') END AS m1,
  CASE language WHEN 'python' THEN '' ELSE concat({NL}, '}}') END AS c1,
  CASE language WHEN 'python' THEN {_lines('value = run{n}(1)')} WHEN 'java' THEN {NL} ELSE concat({NL}, 'app.get("/t', n, '", run', n, ');', {NL}, 'const late = import(', {NL}, '  name);', {NL}) END AS p2
FROM (SELECT doc_id, source, coalesce(text, '') AS body, doc_id AS n, doc_id + 60 AS m, doc_id % 5 AS f,
        CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'typescript' END AS language,
        concat('p', doc_id % 5, CASE doc_id % 3 WHEN 1 THEN '/M' ELSE '/m' END, doc_id, CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.java' ELSE '.ts' END) AS path
      FROM documents) d) x
"""

_tables: dict = {}


def tables_of(spark, folder):
    """The snapshot tables of the rendered sources, written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    b.open_tables(spark, folder)
    if key not in _tables:
        members = spark.sql(f"SELECT doc_id AS ord, analysis_id, path, concat(p0, s1, p1, c0, m1, c1, p2) AS content FROM ({PARTS}) p")
        found = snapshot.graph(cut_lineage(snapshots.profile_files(members)))
        _tables[key] = found | {"edges": cut_lineage(found["edges"])}
    return _tables[key]


def imports(spark, folder):
    found = tables_of(spark, folder)["imports"]
    return found.select("analysis_id", "path", "line_no", "level", "specifier", F.array_join(F.transform("bindings", lambda x: F.concat(x["name"], F.lit("="), x["alias"])), ",").alias("names"),
                        "computed", "dynamic", "target")


def symbols(spark, folder):
    found = tables_of(spark, folder)["declarations"].where("kind <> 'variable'")
    return found.select("analysis_id", "path", "name", "kind", "start_line", "end_line", "start_byte", "end_byte", "owner", "exported", F.array_join("tags", " ").alias("tags"))


def use_sites(spark, folder):
    return tables_of(spark, folder)["edges"].where("kind IN ('calls', 'references')").select("analysis_id", "source", "target", "kind", "start_line")


def nodes(spark, folder):
    return tables_of(spark, folder)["nodes"].where("coalesce(symbol_kind, '') <> 'variable'").select("analysis_id", "id", "kind", "name", "path", "parent_id", F.coalesce("start_line", F.lit(0)).alias("start_line"),
                                                                                                             F.coalesce("end_line", F.lit(0)).alias("end_line"))


def edges(spark, folder):
    found = tables_of(spark, folder)["edges"].where("kind IN ('contains', 'imports') AND target NOT LIKE 'symbol:%:app' AND target NOT LIKE 'symbol:%:late'")
    return found.select("analysis_id", "source", "target", "kind", F.coalesce("start_line", F.lit(0)).alias("start_line"), "specifier", "resolution")


def unresolved(spark, folder):
    return tables_of(spark, folder)["unresolved"].select("analysis_id", "path", "line_no", "specifier", "reason")


def _count(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


_PLACED = f"""parts AS MATERIALIZED ({PARTS}),
placed AS MATERIALIZED (SELECT *, {_count('p0')} AS l0, {_count('s1')} AS ls, {_count('p1')} AS lp, {_count('c0')} AS lc, {_count('m1')} AS lm, {_count('c1')} AS le,
  strlen(p0) AS b0, strlen(p0) + strlen(s1) + strlen(p1) AS bc, strlen(p0) + strlen(s1) + strlen(p1) + strlen(c0) AS bm, {_count('concat(p0, s1, p1, c0, m1, c1, p2)')} AS whole,
  strlen(concat(p0, s1, p1, c0, m1, c1, p2)) AS bytes, language = 'python' AS py,
  {_count("split_part(p0, 'from fastapi import (', 1)")} AS l_from FROM parts),
symbols AS MATERIALIZED (
  SELECT analysis_id, path, concat('run', doc_id) AS name, 'function' AS kind, l0 + 1 AS start_line, l0 + 1 + ls - py::INT AS end_line, b0 AS start_byte, b0 + strlen(s1) AS end_byte,
    '' AS owner, true AS exported, CASE WHEN py THEN concat('api-handler http:GET route:/v', doc_id, '/items') ELSE concat('api-handler http:GET route:/t', doc_id) END AS tags, doc_id
  FROM placed WHERE language <> 'java'
  UNION ALL SELECT analysis_id, path, concat(CASE language WHEN 'java' THEN 'M' ELSE 'Box' END, doc_id), 'class', l0 + ls + lp + 1, l0 + ls + lp + lc + lm + le + 1 - py::INT, bc,
    bc + strlen(c0) + strlen(m1) + strlen(c1), '', true, CASE language WHEN 'java' THEN 'spring:restcontroller' ELSE '' END, doc_id FROM placed
  UNION ALL SELECT analysis_id, path, CASE language WHEN 'python' THEN '_open' WHEN 'java' THEN 'run' ELSE 'open' END, 'method', l0 + ls + lp + lc + 1, l0 + ls + lp + lc + lm + 1 - py::INT, bm,
    bm + strlen(m1), concat(CASE language WHEN 'java' THEN 'M' ELSE 'Box' END, doc_id), language = 'java', CASE language WHEN 'java' THEN concat('api-handler http:GET route:/j', doc_id, '/items') ELSE '' END, doc_id FROM placed),
ids AS MATERIALIZED (SELECT s.*, concat('symbol:', path, ':', start_byte, ':', name) AS id,
  CASE WHEN owner = '' THEN concat('file:', path) ELSE concat('symbol:', path, ':', (SELECT min(c.start_byte) FROM symbols c WHERE c.analysis_id = s.analysis_id AND c.path = s.path AND c.kind = 'class'), ':', owner) END AS parent_id FROM symbols s),
said AS MATERIALIZED (
  SELECT analysis_id, path, doc_id, v.* FROM placed JOIN (VALUES
    ('python', 1, 0, 'fastapi', 'APIRouter=Made', false, false, false), ('python', 4, 0, 'fastapi', 'APIRouter=APIRouter', false, false, false), ('python', 5, 1, 'm#', 'run#=go', false, false, true),
    ('python', 8, 0, 'os', '', false, false, false), ('python', 8, 0, 'sys', '', false, false, false),
    ('java', 2, 0, 'com.acme.p@.M#', 'M#=M#', false, false, true), ('java', 3, 0, 'java.util.List.of', 'of=of', false, false, false),
    ('typescript', 1, 0, 'express', 'default=express', false, false, false), ('typescript', 2, 0, './m#', 'run#=go', false, false, true), ('typescript', 0, 0, 'name', '', true, true, false))
    v(form, nth, level, specifier, names, computed, dynamic, inside) ON v.form = placed.language),
imports AS MATERIALIZED (
  SELECT s.analysis_id, s.path, CASE WHEN s.form = 'python' THEN p.l_from + s.nth WHEN s.nth > 0 THEN s.nth ELSE p.whole - 1 END AS line_no, s.level,
    replace(replace(s.specifier, '#', (s.doc_id + 60)::VARCHAR), '@', (s.doc_id % 5)::VARCHAR) AS specifier, replace(s.names, '#', (s.doc_id + 60)::VARCHAR) AS names, s.computed, s.dynamic,
    t.path AS target, s.form, s.doc_id FROM said s JOIN placed p ON p.doc_id = s.doc_id LEFT JOIN placed t ON s.inside AND t.doc_id = s.doc_id + 60 AND t.analysis_id = s.analysis_id)"""


def _sql(select: str) -> str:
    return f"WITH {_PLACED} {select}"


IMPORTS_SQL = _sql("SELECT analysis_id, path, line_no, level, specifier, names, computed, dynamic, target FROM imports")
SYMBOLS_SQL = _sql("SELECT analysis_id, path, name, kind, start_line, end_line, start_byte, end_byte, owner, exported, tags FROM symbols")
UNRESOLVED_SQL = _sql("""SELECT analysis_id, path, line_no, concat(repeat('.', level), specifier) AS specifier,
  CASE WHEN computed THEN 'The specifier is computed.' ELSE 'No source target in the snapshot.' END AS reason FROM imports WHERE target IS NULL AND (computed OR level > 0 OR specifier LIKE './%')""")
# Who uses what: the imported run from run (or the Java class from class and method), the own run from the method and the file.
_USED = """u AS (
  SELECT o.analysis_id, o.id AS source, t.id AS target, x.kind, CASE x.place WHEN 'run' THEN o.end_line WHEN 'body' THEN o.start_line + 1 ELSE o.start_line + 4 END AS start_line FROM ids o
  JOIN (VALUES ('function', 'run', 'calls'), ('function', 'run', 'references'), ('class', 'field', 'references'), ('class', 'new', 'calls'), ('method', 'four', 'references')) x(of, place, kind) ON x.of = o.kind
  JOIN ids t ON t.analysis_id = o.analysis_id AND t.doc_id = o.doc_id + 60 AND t.name = CASE WHEN o.path LIKE '%.java' THEN concat('M', o.doc_id + 60) ELSE concat('run', o.doc_id + 60) END
  WHERE (o.path LIKE '%.java') = (x.of <> 'function')),
own AS (SELECT m.analysis_id, m.id AS source, r.id AS target, k.kind, m.start_line + (m.path LIKE '%.ts')::INT AS start_line FROM ids m JOIN ids r ON r.analysis_id = m.analysis_id AND r.path = m.path AND r.kind = 'function'
  JOIN (VALUES ('calls'), ('references')) k(kind) ON k.kind = 'calls' OR m.path LIKE '%.ts' WHERE m.kind = 'method'),
top AS (SELECT p.analysis_id, concat('file:', p.path) AS source, r.id AS target, CASE WHEN py THEN 'calls' ELSE 'references' END AS kind, CASE WHEN py THEN whole ELSE l0 + ls + lp + lc + lm + le + 2 END AS start_line
  FROM placed p JOIN ids r ON r.analysis_id = p.analysis_id AND r.path = p.path AND r.kind = 'function')"""
USES_SQL = f"""WITH {_PLACED}, {_USED.replace("CASE x.place WHEN 'run' THEN o.end_line WHEN 'body' THEN o.start_line + 1 ELSE o.start_line + 4 END",
  "CASE WHEN x.place = 'run' AND o.path LIKE '%.py' THEN o.end_line WHEN x.place = 'four' THEN o.start_line + 4 ELSE o.start_line + 1 END")}
SELECT * FROM u UNION ALL SELECT * FROM own UNION ALL SELECT * FROM top"""
NODES_SQL = _sql("""SELECT DISTINCT analysis_id, 'repo' AS id, 'repository' AS kind, 'Repository' AS name, NULL AS path, NULL AS parent_id, 0 AS start_line, 0 AS end_line FROM placed
UNION ALL SELECT DISTINCT analysis_id, 'module:.', 'module', 'Root', '.', 'repo', 0, 0 FROM placed
UNION ALL SELECT DISTINCT analysis_id, concat('module:', split_part(path, '/', 1)), 'module', split_part(path, '/', 1), split_part(path, '/', 1), 'module:.', 0, 0 FROM placed
UNION ALL SELECT analysis_id, concat('file:', path), 'file', split_part(path, '/', 2), path, concat('module:', split_part(path, '/', 1)), 1, whole + 1 FROM placed
UNION ALL SELECT analysis_id, id, 'symbol', name, path, parent_id, start_line, end_line FROM ids
UNION ALL SELECT DISTINCT analysis_id, concat('external:', split_part(specifier, '.', 1)), 'external', split_part(specifier, '.', 1), NULL, NULL, 0, 0 FROM imports
  WHERE target IS NULL AND NOT computed AND level = 0 AND specifier NOT LIKE './%'""")
EDGES_SQL = _sql("""SELECT DISTINCT analysis_id, 'repo' AS source, 'module:.' AS target, 'contains' AS kind, 0 AS start_line, NULL AS specifier, 'structural' AS resolution FROM placed
UNION ALL SELECT DISTINCT analysis_id, 'module:.', concat('module:', split_part(path, '/', 1)), 'contains', 0, NULL, 'structural' FROM placed
UNION ALL SELECT analysis_id, concat('module:', split_part(path, '/', 1)), concat('file:', path), 'contains', 0, NULL, 'structural' FROM placed
UNION ALL SELECT analysis_id, parent_id, id, 'contains', 0, NULL, 'structural' FROM ids
UNION ALL SELECT analysis_id, concat('file:', path), concat('file:', target), 'imports', line_no, specifier, 'resolved' FROM imports WHERE target IS NOT NULL
UNION ALL SELECT analysis_id, concat('file:', path), concat('external:', split_part(specifier, '.', 1)), 'imports', line_no, specifier, 'structural' FROM imports
  WHERE target IS NULL AND NOT computed AND level = 0 AND specifier NOT LIKE './%'""")

QUERIES = {"x2_wrapped_imports": (imports, IMPORTS_SQL), "x8_computed_specifiers": (unresolved, UNRESOLVED_SQL), "x9_x10_symbols_and_tags": (symbols, SYMBOLS_SQL),
           "x14_use_sites": (use_sites, USES_SQL), "x16_snapshot_nodes": (nodes, NODES_SQL), "x16_snapshot_edges": (edges, EDGES_SQL)}
