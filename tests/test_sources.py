"""Statements, declarations, tags and use sites on small sources that wrap lines, nest blocks and hide code in text."""
import pytest
from pyspark.sql import functions as F

from codestrata.operators import declarations, extract, source_code
from codestrata.plans import snapshot
from codestrata.sources import snapshots

BODIES = {
"web/depot.py":'"""Docstring\nimport ghost\n"""\nfrom fastapi import (\n    APIRouter as Made,  # maker\n    Depends,\n)\nfrom .store import (keep,\n  drop as lose)\nimport os; import sys\nfrom fastapi import APIRouter\nshelves = APIRouter(\n  prefix="/depot",\n)\n@shelves.get(\n    "/x",\n)\ndef f(\n    a,\n):\n    return keep(a)\n\nclass Box:\n    size = 1\n\n    @property\n    def wide(self):\n        def inner():\n            return lose(\n                1)\n        return inner()\n    # end\n\nif os:\n    def hidden(): pass\nvalue = f(1)\n',
"web/store.py":"def keep(a):\n    return a\ndef drop(b): return b\n",
"src/com/acme/Boiler.java":'package com.acme;\nimport com.acme.Valve;\nimport java.util.List;\n/** Boiler { not code } */\n@RestController\n@RequestMapping(value = {"/heat", "/h"})\npublic class Boiler extends Base {\n  private final Valve valve = new Valve();\n  // { stray\n  @GetMapping(\n    "/now"\n  )\n  public String now(@RequestParam("unit") String unit) throws IOException {\n    if (unit == null) { return "}"; }\n    return Valve.read(unit);\n  }\n  @PostMapping\n  void set(int x) { this.x = x; }\n  enum Mode { ON, OFF }\n  static class Inner {\n    Inner(int a) { }\n  }\n}\n',
"src/com/acme/Valve.java":'package com.acme;\npublic class Valve {\n  static String read(String u) { return u; }\n}\n',
"ui/list.tsx":'import express, { Router } from "express";\nimport {\n  load,\n  save as keep,\n} from "./data";\nimport type { Shape } from "./data";\nconst app = express();\nexport type Row = {\n  id: number;\n};\nexport interface Props { rows: Row[] }\nexport enum Mode { A, B }\nexport const Table = ({ rows }: Props) => {\n  const x = load(`a ${1} {`);\n  return <div>{rows.map((r) => { return keep(r); })}</div>;\n};\nexport default class Store extends Base<Row> {\n  static count = 1;\n  constructor(private a: string) { super(); }\n  get size(): number { return 1; }\n  async fetch({ id }: { id: number }, b = 2): Promise<Row> {\n    return load(id);\n  }\n  click = (e) => {\n    keep(e)\n  }\n}\nfunction show(req, res) {\n  const re = /["{]/;\n  res.send("ok")\n}\nconst twice = (n: number) => n * 2;\napp.get("/rows", show);\nconst mod = await import(\n  name + "/x");\nexport { show };\n',
"ui/data.ts":'export function load(x) { return x }\nexport const save = async (y) => {\n  return y\n}\nexport interface Shape { a: number }\n',
"app/api/items/route.ts":'export async function GET(req: Request) {\n  return new Response("x")\n}\n',
}


def corpus(spark, bodies):
    rows = spark.createDataFrame([("a", p, c, i) for i, (p, c) in enumerate(bodies.items())], "analysis_id string, path string, content string, ord long")
    return snapshots.profile_files(rows)


@pytest.fixture(scope="module")
def tables(spark):
    files = corpus(spark, BODIES)
    return {"files": files, **snapshot.graph(files)}


def test_imports_over_several_lines(tables):
    found = {(r.path, r.line_no, r.level, r.specifier, tuple((b.name, b.alias) for b in r.bindings), r.type_only, r.dynamic, r.computed) for r in tables["imports"].collect()}
    assert found == {
        ("web/depot.py", 4, 0, "fastapi", (("APIRouter", "Made"), ("Depends", "Depends")), False, False, False),
        ("web/depot.py", 8, 1, "store", (("keep", "keep"), ("drop", "lose")), False, False, False), ("web/depot.py", 10, 0, "os", (), False, False, False),
        ("web/depot.py", 10, 0, "sys", (), False, False, False), ("web/depot.py", 11, 0, "fastapi", (("APIRouter", "APIRouter"),), False, False, False),
        ("src/com/acme/Boiler.java", 2, 0, "com.acme.Valve", (("Valve", "Valve"),), False, False, False), ("src/com/acme/Boiler.java", 3, 0, "java.util.List", (("List", "List"),), False, False, False),
        ("ui/list.tsx", 1, 0, "express", (("default", "express"), ("Router", "Router")), False, False, False), ("ui/list.tsx", 2, 0, "./data", (("load", "load"), ("save", "keep")), False, False, False),
        ("ui/list.tsx", 6, 0, "./data", (("Shape", "Shape"),), True, False, False), ("ui/list.tsx", 34, 0, 'name + "/x"', (), False, True, True)}
    assert {(r.specifier, r.line_no, r.reason) for r in tables["unresolved"].collect()} == {('name + "/x"', 34, "The specifier is computed.")}


def test_ranges_owners_and_tags(tables):
    found = {(r.path.split("/")[-1], r.name, r.kind, r.start_line, r.end_line, r.owner, r.exported, tuple(r.tags)) for r in tables["declarations"].where("kind <> 'variable'").collect()}
    assert found == {
        ("depot.py", "f", "function", 15, 21, "", True, ("api-handler", "http:GET", "route:/depot/x")), ("depot.py", "Box", "class", 23, 31, "", True, ()),
        ("depot.py", "wide", "method", 26, 31, "Box", True, ()), ("store.py", "keep", "function", 1, 2, "", True, ()), ("store.py", "drop", "function", 3, 3, "", True, ()),
        ("Boiler.java", "Boiler", "class", 7, 23, "", True, ("spring:restcontroller",)), ("Boiler.java", "now", "method", 10, 16, "Boiler", True, ("api-handler", "http:GET", "route:/heat/now")),
        ("Boiler.java", "set", "method", 17, 18, "Boiler", True, ("api-handler", "http:POST")), ("Boiler.java", "Mode", "enum", 19, 19, "", True, ()),
        ("Boiler.java", "Inner", "class", 20, 22, "", True, ()), ("Boiler.java", "Inner", "method", 21, 21, "Inner", True, ()),
        ("Valve.java", "Valve", "class", 2, 4, "", True, ()), ("Valve.java", "read", "method", 3, 3, "Valve", True, ()),
        ("list.tsx", "Row", "type_alias", 8, 10, "", True, ()), ("list.tsx", "Props", "interface", 11, 11, "", True, ()), ("list.tsx", "Mode", "enum", 12, 12, "", True, ()),
        ("list.tsx", "Table", "function", 13, 16, "", True, ("react-component",)), ("list.tsx", "Store", "class", 17, 27, "", True, ()),
        ("list.tsx", "constructor", "method", 19, 19, "Store", False, ()), ("list.tsx", "get size", "method", 20, 20, "Store", False, ()),
        ("list.tsx", "fetch", "method", 21, 23, "Store", False, ()), ("list.tsx", "click", "method", 24, 26, "Store", False, ()),
        ("list.tsx", "show", "function", 28, 31, "", True, ("api-handler", "http:GET", "route:/rows")), ("list.tsx", "twice", "function", 32, 32, "", False, ()),
        ("data.ts", "load", "function", 1, 1, "", True, ()), ("data.ts", "save", "function", 2, 4, "", True, ()), ("data.ts", "Shape", "interface", 5, 5, "", True, ()),
        ("route.ts", "GET", "function", 1, 3, "", True, ("api-handler", "http:GET"))}


def test_bytes_cut_the_declarations_out_of_the_files(tables):
    for r in tables["declarations"].collect():
        said = BODIES[r.path].encode()[r.start_byte:r.end_byte].decode()
        name = r.name.split(" ")[-1]
        assert name in said and said == said.lstrip() or r.path.endswith(".py"), (r.path, r.name, said)
        assert BODIES[r.path].encode()[:r.start_byte].count(b"\n") == r.start_line - 1
        if r.kind not in ("variable", "type_alias") and not r.path.endswith(".py") and r.name != "twice":
            assert said.endswith("}")


def test_uses_come_from_the_innermost_symbol(tables):
    def told(symbol):
        return symbol.split(":")[-1] if symbol.startswith("symbol") else symbol
    found = {(told(r.source), told(r.target), r.kind, r.start_line) for r in tables["edges"].where("kind IN ('calls', 'references')").collect()}
    assert found == {
        ("Boiler", "Valve", "references", 8), ("Boiler", "Valve", "calls", 8), ("now", "Valve", "references", 15),
        *{(s, t, k, n) for s, t, n in (("Table", "load", 14), ("Table", "save", 15), ("fetch", "load", 22), ("click", "save", 25), ("f", "keep", 21), ("wide", "drop", 29)) for k in ("calls", "references")},
        ("file:ui/list.tsx", "show", "references", 33), ("file:ui/list.tsx", "show", "references", 36), ("file:web/depot.py", "f", "calls", 36)}


def test_nodes_and_edges_hang_together(tables):
    nodes = {r.id: r for r in tables["nodes"].collect()}
    edges = tables["edges"].collect()
    assert len(nodes) == tables["nodes"].count() and len({e.id for e in edges}) == len(edges)
    assert all(e.source in nodes and e.target in nodes for e in edges)
    assert nodes["module:src/com/acme"].parent_id == "module:src/com" and nodes["external:express"].kind == "external"
    inside = [e for e in edges if e.kind == "contains"]
    assert {e.target for e in inside} == {i for i, n in nodes.items() if n.parent_id} and len(inside) == len(nodes) - 1 - sum(n.kind == "external" for n in nodes.values())
    assert {(e.source, e.target) for e in edges if e.kind == "imports" and e.resolution == "resolved"} == {
        ("file:web/depot.py", "file:web/store.py"), ("file:src/com/acme/Boiler.java", "file:src/com/acme/Valve.java"), ("file:ui/list.tsx", "file:ui/data.ts")}


def test_tables_are_stored_by_snapshot(spark, tables, tmp_path):
    snapshot.write({"nodes": tables["nodes"]}, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "nodes"))
    assert (tmp_path / "out" / "nodes" / "analysis_id=a").is_dir() and back.count() == tables["nodes"].count()


ODD = {"empty.py": "", "open.py": "def f(\n  x\n", "mixed.py": "if x: import json\ntry: import yaml\nexcept ImportError: yaml = None\nimport a.b as c, d\nfrom . import (\n  e)\nx = 'import no' \\\n  \"\\\"import no\"\n",
       "urls.py": "from django.urls import path as at\nurlpatterns = [\n  at('home/', home),\n  at(\n   'away/', away),\n  other('x'),\n]\n",
       "view.py": "from rest_framework.decorators import api_view as seen\n@seen(['POST', 'GET'])\ndef make(request): pass\n@cached\n@seen()\ndef look(r):\n  pass\n",
       "Odd.java": "class Odd {\n  Runnable r = new Runnable() {\n    public void run() { }\n  };\n  int[] a = {1, 2};\n  void go() {\n    for (int i = 0; i < 2; i++) { }\n  }\n",
       "pages/api/x.js": "export default async function (req, res) {\n  res.end()\n}\nfunction handler() { return `${1}}` }\n", "no.ts": "// function gone() { }\nconst s = 'class Ghost { }'\nlet t = /}/\n"}


def test_odd_sources(spark):
    files = corpus(spark, ODD)
    found = {(r.path, r.specifier, r.level, r.line_no) for r in extract.imports(files).where("path = 'mixed.py'").collect()}
    assert found == {("mixed.py", "json", 0, 1), ("mixed.py", "yaml", 0, 2), ("mixed.py", "a.b", 0, 4), ("mixed.py", "d", 0, 4), ("mixed.py", "", 1, 5)}
    seen = {(r.path, r.name, r.kind, r.start_line, r.end_line, tuple(r.tags)) for r in declarations.declarations(files).where("kind <> 'variable'").collect()}
    assert seen == {
        ("open.py", "f", "function", 1, 2, ()), ("urls.py", "route@3", "route", 3, 3, ("api-handler", "http:ROUTE", "route:home/")), ("urls.py", "route@4", "route", 4, 4, ("api-handler", "http:ROUTE", "route:away/")),
        ("view.py", "make", "function", 2, 3, ("api-handler", "http:POST")), ("view.py", "look", "function", 4, 7, ("api-handler", "http:ROUTE")),
        ("Odd.java", "Odd", "class", 1, 9, ()), ("Odd.java", "go", "method", 6, 8, ()),
        ("pages/api/x.js", "default", "function", 1, 3, ("api-handler",)), ("pages/api/x.js", "handler", "function", 4, 4, ("api-handler",))}


def test_shielding_keeps_lengths_and_text(spark):
    raw = "a = 'b{' # c \"d\n/* é\n{ */ \"x\\\"y\" // z\n"
    row = spark.range(1).select(F.lit(raw).alias("raw")).select(
        "raw", *[source_code.shield(F.col("raw"), p).alias(n) for n, p in (("py", source_code.PYTHON_TEXT), ("java", source_code.JAVA_TEXT), ("script", source_code.SCRIPT_TEXT))])
    for name in ("py", "java", "script"):
        got = row.select(source_code.restore(F.col(name)).alias("back"), F.length(name).alias("n"), source_code.byte_length(F.col(name)).alias("bytes"), source_code.breaks(F.col(name)).alias("lines")).first()
        assert got.back == raw and got.n == len(raw) and got.bytes == len(raw.encode()) and got.lines == 3
