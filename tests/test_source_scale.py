"""Imports are computed once, and shortened patterns mean what the plain ones do."""
from pyspark.sql import functions as F

from codestrata.operators import extract
from codestrata.operators import source_code as code
from codestrata.sources import snapshots


def corpus(spark, bodies):
    rows = spark.createDataFrame([("a", p, c, i) for i, (p, c) in enumerate(bodies.items())], "analysis_id string, path string, content string, ord long")
    return snapshots.profile_files(rows)


def counted(spark, rows, column):
    """The rows, and an accumulator of how often ``column`` was computed."""
    seen = spark.sparkContext.accumulator(0)

    def same(value):
        seen.add(1)
        return value
    return rows.withColumn(column, F.udf(same, rows.schema[column].dataType).asNondeterministic()(column)), seen


BODIES = {"src/a.ts": 'import { b } from "./b";\nimport fs from "fs";\n', "src/b.ts": "export const b = 1;\n", "m.py": "import os\nfrom .n import x\n", "n.py": "x = 1\n",
          "p/A.java": "package p;\nimport p.B;\nclass A {}\n", "p/B.java": "package p;\nclass B {}\n"}


def test_imports_are_computed_once_for_all_resolvers(spark):
    files = corpus(spark, BODIES)
    found, seen = counted(spark, extract.imports(files), "specifier")
    resolved = extract.resolve(found, files).collect()
    assert {(r.path, r.target) for r in resolved if r.target} == {("src/a.ts", "src/b.ts"), ("m.py", "n.py"), ("p/A.java", "p/B.java")}
    assert seen.value == len(resolved) == 5


def test_braces_and_patterns_are_judged_as_before(spark):
    plain = r"(?<=[(,=:\[?|&<]\s{0,20}|\b(?:import|export|type)\s{0,20})\{([^{};]*)\}"
    samples = ["f({a})", "x = {b: {c}}", "class A {x}", "import {a} from 'x'", "export   { a, b }", "retype {a}", "type {a}", ": \n {a}", "=" + " " * 21 + "{a}", "=" + " " * 20 + "{a}", "{", "({a;})", "import{a}{b}"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string")
    for r in rows.select("s", F.regexp_replace("s", plain, "<$1>").alias("old"), F.regexp_replace("s", code._VALUE_BRACES, "<$1>").alias("new")).collect():
        assert r.old == r.new, r.s
    whole = {code.PYTHON_TEXT: r"#[^\n]*|\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|" + code._QUOTED, code.JAVA_TEXT: r"//[^\n]*|/\*[\s\S]*?\*/|\"{3}[\s\S]*?\"{3}|" + code._QUOTED,
             code.SCRIPT_TEXT: (r"//[^\n]*|/\*[\s\S]*?\*/|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`|" + code._QUOTED
                                + r"|(?<=[=(,:;!&|?{}\[\n]\s{0,20})/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")}
    samples = ['"""a"b""c"""" x', '"""open "a" b', "'''it''s'''' y'z'", "''''a'''", '""""""', "a /* b * c **/ d /* open", "/**/ x /***/ y /*/ z", "x = /a[/]b/g + y / z / 2", "f(/\\//) // t", "= /* c */ /re/", "/re/ a", "\n   /re/.test('#')", "# 'a'\nb = '#'"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string")
    for new, old in whole.items():
        for r in rows.select("s", F.regexp_extract_all("s", F.lit(old), F.lit(0)).alias("old"), F.regexp_extract_all("s", F.lit(new), F.lit(0)).alias("new")).collect():
            assert r.old == r.new, r.s


def test_counts_of_characters(spark):
    value = "a\n[({]})\\^-\U0001f600" * 2
    for some in ("\n", "([{", ")]}", "\\^-", code._IN_LITERAL + code._IN_COMMENT + code._IN_VALUE):
        assert spark.range(1).select(code.count_of(F.lit(value), some).alias("n")).first().n == sum(c in some for c in value)
