"""Relationship extraction over the rendered corpus; the SQL states what the renderer wrote."""
from pyspark.sql import functions as F

from ..operators import extract
from ..session import cut_lineage
from ..sources import snapshots
from . import bindings as b
from .intake_queries import files_of


def x1(spark, folder):
    lines = extract.source_lines(files_of(spark, folder))
    placed = extract.line_offsets(lines)
    return placed.join(lines.select("analysis_id", "file_id", "line_no", F.md5("line").alias("digest")), ["analysis_id", "file_id", "line_no"])


X1_SQL = b.with_members("""SELECT analysis_id, file_id, line_no, md5(line) AS digest,
  CAST(coalesce(sum(length(line) + 1) OVER w, 0) AS BIGINT) AS char_offset, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER w, 0) AS BIGINT) AS byte_offset
FROM (SELECT analysis_id, file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files) x
WINDOW w AS (PARTITION BY analysis_id, file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

# What the renderer wrote into each language, as (line, specifier, kind, type_only, dynamic, level, step to the named document).
_WRITTEN = """said AS (
  SELECT f.*, split_part(path, '/', 1) AS dir, m.* FROM files f JOIN (VALUES
    ('python', 1, 'os', 'imports', false, false, 0, 0), ('python', 2, 'fastapi', 'imports', false, false, 0, 0), ('python', 3, 'fastapi', 'imports', false, false, 0, 0),
    ('python', 4, '.d', 'imports', false, false, 1, 60), ('python', 5, 'dir.d', 'imports', false, false, 0, 120),
    ('java', 2, 'acme', 'imports', false, false, 0, 60), ('java', 3, 'value', 'imports', false, false, 0, 120), ('java', 4, 'java.util.List', 'imports', false, false, 0, 0),
    ('java', 5, 'org.springframework.boot.*', 'imports', false, false, 0, 0),
    ('ts', 1, 'express', 'imports', false, false, 0, 0), ('ts', 2, './d', 'imports', false, false, 0, 60), ('ts', 3, './d.js', 'imports', true, false, 0, 120),
    ('ts', 4, './d', 'reexports', false, false, 0, 60), ('ts', 5, './d', 'imports', false, true, 0, 120), ('tsx', 1, './d', 'imports', false, false, 0, 60),
    ('js', 1, './d', 'imports', false, false, 0, 60)) m(form, line_no, said, kind, type_only, dynamic, level, step)
  ON m.form = CASE ord % 12 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'ts' WHEN 3 THEN 'tsx' WHEN 5 THEN 'js' END),
written AS (SELECT *, CASE said WHEN '.d' THEN concat('d', ord + 60) WHEN 'dir.d' THEN concat(dir, '.d', ord + 120) WHEN 'acme' THEN concat('com.acme.', dir, '.d', ord + 60)
    WHEN 'value' THEN concat('com.acme.', dir, '.d', ord + 120, '.VALUE') WHEN './d' THEN concat('./d', ord + step) WHEN './d.js' THEN concat('./d', ord + 120, '.js') ELSE said END AS specifier,
  CASE WHEN step > 0 THEN concat(dir, '/d', ord + step, CASE form WHEN 'python' THEN '.py' WHEN 'java' THEN '.java' WHEN 'ts' THEN '.ts' WHEN 'tsx' THEN '.tsx' ELSE '.js' END) END AS meant FROM said),
resolved AS (SELECT w.*, f.path AS target FROM written w LEFT JOIN (SELECT analysis_id, path FROM files) f ON f.analysis_id = w.analysis_id AND f.path = w.meant)"""


def x2(spark, folder):
    return extract.imports(files_of(spark, folder)).select("analysis_id", "file_id", "line_no", "specifier", "kind", "type_only", "dynamic", "level")


X2_SQL = b.with_members("SELECT analysis_id, file_id, line_no, specifier, kind, type_only, dynamic, level FROM written", _WRITTEN)


def x3(spark, folder):
    files = files_of(spark, folder).where("language = 'java'")
    return files.select("analysis_id", "file_id", F.length(extract.mask_comments(F.col("content"))).cast("long").alias("characters"),
                        extract.mask_comments(F.col("content")).contains("class").alias("code_left"), extract.mask_comments(F.col("content")).contains("//").alias("comment_left"))


X3_SQL = b.with_members("SELECT analysis_id, file_id, length(content) AS characters, true AS code_left, false AS comment_left FROM files WHERE language = 'java'")


def _resolver(name, language):
    def call(spark, folder):
        files = files_of(spark, folder)
        found = cut_lineage(extract.imports(files))
        hits = getattr(extract, name)(found, files)
        return found.where(F.col("language").isin(*language)).join(hits, ["analysis_id", "import_id"]).select("analysis_id", "path", "line_no", "target")
    return call


def _resolver_sql(languages):
    return b.with_members(f"SELECT analysis_id, path, line_no, target FROM resolved WHERE target IS NOT NULL AND language IN {languages}", _WRITTEN)


def _split(spark, folder):
    files = files_of(spark, folder)
    return extract.split_unresolved(extract.resolve(extract.imports(files), files), files)


def x7(spark, folder):
    return _split(spark, folder)[0].select("analysis_id", "path", "line_no", "target")


X7_SQL = b.with_members("""SELECT analysis_id, path, line_no, concat('external:', split_part(specifier, '.', 1)) AS target FROM resolved WHERE target IS NULL AND level = 0 AND specifier NOT LIKE './%'""", _WRITTEN)


def x8(spark, folder):
    return _split(spark, folder)[1].select("analysis_id", "path", "line_no", "specifier")


X8_SQL = b.with_members("""SELECT analysis_id, path, line_no, concat(repeat('.', level), specifier) AS specifier FROM resolved WHERE target IS NULL AND (level > 0 OR specifier LIKE './%')""", _WRITTEN)


def x9(spark, folder):
    return extract.python_declarations(files_of(spark, folder)).select("analysis_id", "path", "name", "kind", "start_line", "end_line", "owner")


X9_SQL = b.with_members("""SELECT analysis_id, path, replace(n, '#', cast(ord AS string)) AS name, kind, s AS start_line, e AS end_line, replace(o, '#', cast(ord AS string)) AS owner FROM files JOIN (VALUES
  ('run#', 'function', 7, 9, ''), ('helper#', 'function', 10, 11, ''), ('Model#', 'class', 12, 14, ''), ('save', 'method', 13, 14, 'Model#')) v(n, kind, s, e, o) ON true WHERE language = 'python'""")


def x10(spark, folder):
    return extract.python_routes(files_of(spark, folder))


X10_SQL = b.with_members("""SELECT analysis_id, file_id, concat('run', ord) AS name, unnest(['api-handler', 'http:GET', concat('route:/api/items/', ord)]) AS tag FROM files WHERE language = 'python'""")


def x13(spark, folder):
    return extract.local_calls(files_of(spark, folder))


X13_SQL = b.with_members("""SELECT analysis_id, file_id, concat('run', ord) AS caller, concat('helper', ord) AS callee, 9 AS line_no FROM files WHERE language = 'python'
UNION ALL SELECT analysis_id, file_id, 'save', concat('run', ord), 14 FROM files WHERE language = 'python'""")


def x14(spark, folder):
    files = files_of(spark, folder)
    exported = extract.python_declarations(files).where("owner = ''").select("analysis_id", "path", "name", F.concat_ws(":", F.lit("symbol"), "path", "name").alias("symbol_id"))
    return extract.symbol_references(extract.resolve(extract.imports(files), files), exported).select("analysis_id", "file_id", "line_no", "symbol_id")


X14_SQL = b.with_members("""SELECT analysis_id, file_id, line_no, concat('symbol:', target, ':run', ord + 60) AS symbol_id FROM resolved WHERE language = 'python' AND line_no = 4 AND target IS NOT NULL""", _WRITTEN)


def x15(spark, folder):
    return extract.module_hierarchy(files_of(spark, folder))


X15_SQL = b.with_members("""SELECT analysis_id, concat('module:', p) AS id, p AS path, CASE WHEN p = '.' THEN 'Root' ELSE regexp_extract(p, '([^/]*)$', 1) END AS name,
  CASE WHEN p = '.' THEN 'repo' WHEN p NOT LIKE '%/%' THEN 'module:.' ELSE concat('module:', split_part(p, '/', 1)) END AS parent_id FROM (
  SELECT DISTINCT analysis_id, '.' AS p FROM files UNION SELECT analysis_id, split_part(path, '/', 1) FROM files UNION SELECT analysis_id, regexp_replace(path, '/[^/]*$', '') FROM files) x""")


def x16(spark, folder):
    b.open_tables(spark, folder)
    rows = spark.sql("SELECT 'g' AS analysis_id, concat('c', l_suppkey) AS source, concat('p', l_partkey) AS target, CASE WHEN l_returnflag = 'R' THEN 'imports' ELSE 'calls' END AS kind, "
                     "CASE WHEN l_linestatus = 'O' THEN l_linenumber END AS start_line, l_orderkey AS ord, l_extendedprice AS price FROM lineitem")
    return extract.first_wins(rows, ["analysis_id", "source", "target", "kind", "start_line"], ["ord", "price"]).withColumn("start_line", F.coalesce("start_line", F.lit(0)))


X16_SQL = """SELECT analysis_id, source, target, kind, coalesce(start_line, 0) AS start_line, ord, price FROM (SELECT 'g' AS analysis_id, concat('c', l_suppkey) AS source, concat('p', l_partkey) AS target, CASE WHEN l_returnflag = 'R' THEN 'imports' ELSE 'calls' END AS kind,
  CASE WHEN l_linestatus = 'O' THEN l_linenumber END AS start_line, l_orderkey AS ord, l_extendedprice AS price FROM lineitem) x
QUALIFY row_number() OVER (PARTITION BY source, target, kind, start_line ORDER BY ord, price) = 1"""

def package_files(spark, folder):
    """A workspace package per source and a script per document, which reaches its neighbours through the package's star
    pattern, its nested conditions, an alias and a path that is not exported."""
    b.open_tables(spark, folder)
    return cut_lineage(snapshots.profile_files(spark.sql("""
      WITH d AS (SELECT coalesce(lang, 'und') AS analysis_id, coalesce(source, 'none') AS s, doc_id FROM documents WHERE doc_id IS NOT NULL)
      SELECT analysis_id, concat('kits/', s, '/src/parts/d', doc_id, '.ts') AS path, concat(
        'import "@kit/', s, '/part/d', doc_id, '";\\n', 'import "@kit/', s, '";\\n', 'import "~/', s, '/src/parts/d', doc_id, '";\\n',
        'import "@kit/', s, '/src/parts/d', doc_id, '";\\n', 'import "outside', doc_id, '";\\n') AS content, doc_id AS ord FROM d
      UNION ALL SELECT DISTINCT analysis_id, concat('kits/', s, '/package.json'), concat('{"name": "@kit/', s,
        '", "exports": {"./*": null, "./part/*": "./src/parts/*.ts", ".": {"node": "./no.js", "import": {"default": "./src/entry.ts"}}}}'), -2L FROM d
      UNION ALL SELECT DISTINCT analysis_id, concat('kits/', s, '/src/entry.ts'), 'export const a = 1;\\n', -1L FROM d
      UNION ALL SELECT DISTINCT analysis_id, 'tsconfig.json', '{"compilerOptions": {"paths": {"~/*": ["none/*", "kits/*"]}}}', -3L FROM d""")))


def x6_packages(spark, folder):
    files = package_files(spark, folder)
    resolved = extract.resolve(extract.imports(files), files)
    return resolved.select("analysis_id", "path", "line_no", "specifier", "target")


X6_PACKAGES_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS analysis_id, coalesce(source, 'none') AS s, doc_id, concat('kits/', coalesce(source, 'none'), '/src/parts/d', doc_id, '.ts') AS path
           FROM documents WHERE doc_id IS NOT NULL)
SELECT analysis_id, path, 1 AS line_no, concat('@kit/', s, '/part/d', doc_id) AS specifier, path AS target FROM d
UNION ALL SELECT analysis_id, path, 2, concat('@kit/', s), concat('kits/', s, '/src/entry.ts') FROM d
UNION ALL SELECT analysis_id, path, 3, concat('~/', s, '/src/parts/d', doc_id), path FROM d
UNION ALL SELECT analysis_id, path, 4, concat('@kit/', s, '/src/parts/d', doc_id), NULL FROM d
UNION ALL SELECT analysis_id, path, 5, concat('outside', doc_id), NULL FROM d"""


QUERIES = {
    "x6_package_exports": (x6_packages, X6_PACKAGES_SQL),
    "x1_source_lines": (x1, X1_SQL), "x2_import_extract": (x2, X2_SQL), "x3_comment_mask": (x3, X3_SQL),
    "x4_import_resolve_python": (_resolver("resolve_python", ["python"]), _resolver_sql("('python', '')")), "x5_import_resolve_java": (_resolver("resolve_java", ["java"]), _resolver_sql("('java', '')")),
    "x6_import_resolve_js": (_resolver("resolve_script", ["typescript", "javascript"]), _resolver_sql("('typescript', 'javascript')")), "x7_external_nodes": (x7, X7_SQL), "x8_unresolved_refs": (x8, X8_SQL),
    "x9_declarations": (x9, X9_SQL), "x10_route_tags": (x10, X10_SQL), "x13_local_calls": (x13, X13_SQL), "x14_symbol_references": (x14, X14_SQL), "x15_module_hierarchy": (x15, X15_SQL),
    "x16_adapter_union": (x16, X16_SQL),
}
