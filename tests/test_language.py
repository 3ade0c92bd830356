"""Language rules on small sources."""
from pyspark.sql import functions as F

from codestrata.operators import extract, overview
from codestrata.sources import snapshots


def corpus(spark, bodies):
    rows = spark.createDataFrame([("a", p, c, i) for i, (p, c) in enumerate(bodies.items())], "analysis_id string, path string, content string, ord long")
    return snapshots.profile_files(rows)


def targets(spark, bodies):
    files = corpus(spark, bodies)
    resolved = extract.resolve(extract.imports(files), files)
    external, unresolved = extract.split_unresolved(resolved, files)
    return ({(r.path, r.target) for r in resolved.where("target IS NOT NULL").collect()}, {r.target for r in external.collect()}, {r.specifier for r in unresolved.collect()}, resolved)


SHOP = {"shop/orders.py": "from flask import Flask\nfrom .pricing import total, discount\nweb = Flask(__name__)\n\n@web.get('/orders/total')\ndef order_total():\n    amount = total([1, 2])\n    return amount\n",
        "shop/pricing.py": "def total(parts):\n    return sum(parts)\n\ndef discount(x):\n    return x\n", "requirements.txt": "flask==3.0\nredis>=5\n"}


def test_python_service(spark):
    hits, external, unresolved, _ = targets(spark, SHOP)
    assert hits == {("shop/orders.py", "shop/pricing.py")} and external == {"external:flask"} and not unresolved
    files = corpus(spark, SHOP)
    found = {r.name: (r.kind, r.start_line, r.end_line) for r in extract.python_declarations(files).collect()}
    assert found["order_total"] == ("function", 5, 8) and found["discount"] == ("function", 4, 5)
    seen = {(r.kind, r.label) for r in overview.detected(files, overview.manifest_dependencies(files)).collect()}
    assert ("framework", "flask") in seen


def test_only_routers_make_routes(spark):
    files = corpus(spark, {"web/depot.py": "from fastapi import APIRouter\nshelves = APIRouter(prefix='/depot')\nmemo = object()\n@shelves.post('/boxes')\ndef store():\n    pass\n@memo.post('/ghost')\ndef remember():\n    pass\n"})
    tags = {(r.name, r.tag) for r in extract.python_routes(files).collect()}
    assert ("store", "route:/depot/boxes") in tags and {n for n, _ in tags} == {"store"}


def test_java_imports(spark):
    hits, external, _, _ = targets(spark, {
        "src/com/acme/Application.java": "package com.acme;\nimport com.acme.Service;\nimport com.acme.sub.*;\n// import com.acme.Ghost;\nimport org.spring.Boot;\nclass Application {}\n",
        "src/com/acme/Service.java": "package com.acme;\nclass Service {}\n", "src/com/acme/sub/Part.java": "package com.acme.sub;\nclass Part {}\n"})
    assert {t for _, t in hits} == {"src/com/acme/Service.java", "src/com/acme/sub/Part.java"} and external == {"external:org"}


def test_script_imports(spark):
    hits, external, unresolved, resolved = targets(spark, {
        "types.ts": "export interface User {}\n", "lib/index.ts": "export const a = 1;\n", "packages/util/package.json": '{"name":"@shop/util","exports":{".":{"types":"./src/index.ts"}}}',
        "packages/util/src/index.ts": "export const u = 1;\n",
        "src/use.ts": 'import type { User } from "../types";\nimport fs from "node:fs";\nimport "./missing";\nconst m = import("../types.js");\nimport { a } from "../lib";\nimport { u } from "@shop/util";\nimport "../../../etc/passwd";\n// import "./ghost"\n'})
    assert {t for _, t in hits} == {"types.ts", "lib/index.ts", "packages/util/src/index.ts"}
    assert external == {"external:node:fs"} and unresolved == {"./missing", "../../../etc/passwd"}
    kinds = {(r.specifier, r.type_only, r.dynamic) for r in resolved.collect()}
    assert ("../types", True, False) in kinds and ("../types.js", False, True) in kinds


def test_masking_keeps_lines(spark):
    raw = 'a // b\n/* c\n d */ "s // t" \'q\'\n'
    got = spark.range(1).select(extract.mask_comments(F.lit(raw)).alias("x")).first().x
    assert len(got) == len(raw) and got.count("\n") == 3 and "b" not in got and "t" not in got and got.startswith("a ")
