"""Exports with subpaths, stars and nested conditions; path aliases and base URLs."""
import json

from codestrata.operators import extract
from codestrata.session import cut_lineage
from test_language import corpus


def targets(spark, bodies):
    files = cut_lineage(corpus(spark, bodies))
    resolved = cut_lineage(extract.resolve(cut_lineage(extract.imports(files)), files))
    external, unresolved = extract.split_unresolved(resolved, files)
    return {(r.path, r.target) for r in resolved.where("target IS NOT NULL").collect()}, {r.target for r in external.collect()}, {r.specifier for r in unresolved.collect()}


def package(name, exported):
    return json.dumps({"name": name, "exports": exported})


def test_exports_by_path_star_and_nested_condition(spark):
    hits, external, unresolved = targets(spark, {
        "libs/paint/package.json": package("@art/paint", {
            ".": {"browser": "./no.js", "import": {"node": "./no.js", "default": "./src/main.js"}, "require": "./src/old.cjs"},
            "./mix": "./src/mix.ts", "./tint/*": "./src/tints/*.ts", "./tint/dark/*": {"types": "./src/night/*.ts"}, "./closed": None}),
        "libs/paint/src/main.ts": "export const m = 1\n", "libs/paint/src/mix.ts": "export const x = 1\n", "libs/paint/src/old.cjs": "\n",
        "libs/paint/src/tints/red.ts": "export const r = 1\n", "libs/paint/src/night/red.ts": "export const n = 1\n", "libs/paint/src/hidden.ts": "\n",
        "web/a.ts": 'import "@art/paint";\nimport "@art/paint/mix";\nimport "@art/paint/tint/red";\n',
        "web/b.ts": 'import "@art/paint/tint/dark/red";\nimport "@art/paint/src/hidden";\nimport "@art/paint/closed";\nimport "react";\n'})
    assert hits == {("web/a.ts", "libs/paint/src/main.ts"), ("web/a.ts", "libs/paint/src/mix.ts"), ("web/a.ts", "libs/paint/src/tints/red.ts"),
                    ("web/b.ts", "libs/paint/src/night/red.ts")}
    assert external == {"external:react"} and unresolved == {"@art/paint/src/hidden", "@art/paint/closed"}


def test_a_bare_export_and_a_package_without_exports(spark):
    hits, *_ = targets(spark, {"one/package.json": package("one", "./lib.ts"), "one/lib.ts": "\n", "two/package.json": '{"name": "two"}', "two/index.js": "\n", "two/deep/x.ts": "\n",
                               "three/package.json": package("three", {"types": {"import": {"default": "./t.d.ts"}}}), "three/t.d.ts": "\n",
                               "use.ts": 'import "one";\nimport "two";\nimport "two/deep/x";\nimport "three";\n'})
    assert {t for _, t in hits} == {"one/lib.ts", "two/index.js", "two/deep/x.ts", "three/t.d.ts"}


def test_aliases_of_the_nearest_configuration(spark):
    hits, external, unresolved = targets(spark, {
        "tsconfig.json": '{ // top\n "compilerOptions": {"paths": {"@/*": ["missing/*", "src/*"], "@/ui/*": ["ui/*"], "conf": ["src/conf.ts"]}}}',
        "src/a.ts": "\n", "src/conf.ts": "\n", "ui/a.ts": "\n", "app/tsconfig.json": '{"compilerOptions": {"baseUrl": "code"}}', "app/code/util/t.ts": "\n",
        "src/use.ts": 'import "@/a";\nimport "@/ui/a";\nimport "conf";\nimport "@/gone";\nimport "left-pad";\n',
        "app/code/use.ts": 'import "util/t";\nimport "@/a";\n'})
    assert hits == {("src/use.ts", "src/a.ts"), ("src/use.ts", "ui/a.ts"), ("src/use.ts", "src/conf.ts"), ("app/code/use.ts", "app/code/util/t.ts")}
    assert unresolved == {"@/gone"} and external == {"external:left-pad", "external:@/a"}
