"""Declarations: what is read of a text is read once and without its comments."""
import re

from pyspark.sql import functions as F

from codestrata.operators import declarations
from codestrata.sources import snapshots


def corpus(spark, bodies):
    rows = spark.createDataFrame([("a", p, c, i) for i, (p, c) in enumerate(bodies.items())], "analysis_id string, path string, content string, ord long")
    return snapshots.profile_files(rows)


def test_names_of_declarations_behind_long_gaps(spark):
    plain = re.compile(r"\b(?:def|class|interface|enum|record|function\s*\*?|type|const|let|var)\s+$")
    gaps = [" ", "\n", " " * 70, " " * 51 + "\n"]
    heads = ["def", "x; class", "undef", "function", "function *", "async function   *", "a" * 60 + " let", "a" * 60 + "let", "interface", "return", "", "x" * 80 + "interface", "x" * 80 + " interface"]
    befores = [h + g for h in heads for g in gaps] + ["", "def"]
    rows = spark.createDataFrame([(b + "name = 1", len(b)) for b in befores], "said string, at int")
    got = [r.d for r in rows.coalesce(1).select(declarations._declared(F.col("said"), F.col("at")).alias("d")).collect()]
    assert got == [bool(plain.search(b)) for b in befores]


def test_script_texts_keep_one_blank_for_a_comment(spark):
    files = corpus(spark, {"a.ts": "// " + "long comment " * 50 + "\nexport/* c */default   go;\n", "b.ts": "let x = 1;\n"})
    assert [r.said for r in declarations.script_texts(files).collect()] == [" \nexport default go;\n"]
    found = {r.name: r.exported for r in declarations.scripts(corpus(spark, {
        "c.ts": "/* " + "words " * 40 + "*/\nfunction go() {\n}\n// x\nclass Box {\n  open() {\n  }\n}\nexport default go;\n"})).collect()}
    assert found == {"go": True, "Box": False, "open": False}
