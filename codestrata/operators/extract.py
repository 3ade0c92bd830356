"""Relationships out of source text: lines, imports, declarations, and their resolution as joins over a whole corpus."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, paths, text
from ..functions.binding import let
from ..session import cut_lineage
from . import declarations, packages
from . import source_code as code
from .packages import package_root, workspace_packages
from .source_code import FILE, LITERAL

# Comments and string literals, longest forms first.
COMMENT_OR_STRING = (r'//[^\n]*|/\*[\s\S]*?\*/|"""[\s\S]*?"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'")
SCRIPT_EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts"]
SCRIPT_INDEXES = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]


def source_lines(files: DataFrame) -> DataFrame:
    """One row per line, without its terminator; no shuffle."""
    spread = files.select(*FILE, "path", "language", "ord", F.posexplode(text.lines_with_ends(F.col("content"))).alias("at", "raw"))
    return spread.select(*FILE, "path", "language", "ord", (F.col("at") + 1).alias("line_no"), F.regexp_replace("raw", f"[{text.LINE_BREAKS}]+$", "").alias("line"), "raw")


def line_offsets(lines: DataFrame) -> DataFrame:
    """Character and byte offset of every line start. Only lengths are shuffled, and a file is one bounded group."""
    sizes = lines.select(*FILE, "line_no", F.length("raw").alias("c"), F.octet_length("raw").alias("b"))
    before = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*FILE, "line_no", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("char_offset"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("byte_offset"))


def mask_comments(content: Column, keep_strings: bool = False) -> Column:
    """Comments (and string literals) blanked, line breaks kept."""
    blank = lambda m: text.mask_all(m, " ", r"\n")
    return text.replace_matches(content, COMMENT_OR_STRING, (lambda m: F.when(m.startswith("/"), blank(m)).otherwise(m)) if keep_strings else blank)


_NAME = r"[A-Za-z_$][\w$]*"
# Script statements that name a module: the first group of each says which it is.
_SCRIPT_FORMS = {
    "clause": rf"(?<![\w$.])import\s+(type\s+(?!from\b))?([^;()=]*?)\s*\bfrom\s*({LITERAL})",
    "reexport": rf"(?<![\w$.])export\s+(type\s+)?(\*(?:\s*as\s+{_NAME})?|\{{[^{{}}]*\}})\s*from\s*({LITERAL})",
    "plain": rf"(?<![\w$.])import\s*()()({LITERAL})",
    "equals": rf"(?<![\w$.])import\s+(type\s+)?({_NAME})\s*=\s*require\s*\(\s*({LITERAL})\s*\)",
    "dynamic": r"(?<![\w$.])import\s*()()\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)",
    "require": r"(?<![\w$.])require\s*()()\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)",
}
_PYTHON_LEAD = r"^\s*(?:(?:try|else|finally|(?:if|elif|except|with|for|while)\b[^:\n]*)\s*:\s*)?"


def imports(files: DataFrame, parts: code.Parts | None = None) -> DataFrame:
    """Import statements of Python, Java and script files, however many lines they take; text in strings and comments is none.

    Columns: analysis_id, file_id, path, language, line_no, level, specifier, names, bindings (name and alias in the file),
    kind, type_only, dynamic, computed (the specifier is an expression and its text), import_id.
    """
    no_names, no_bindings = F.array().cast("array<string>"), F.array().cast("array<struct<name:string,alias:string>>")

    def rows(source: DataFrame, specifier: Column, line: Column, *, level=F.lit(0), bindings=no_bindings, kind=F.lit("imports"), type_only=F.lit(False), dynamic=F.lit(False),
             computed=F.lit(False)) -> DataFrame:
        return source.select(*FILE, "path", "language", line.cast("int").alias("line_no"), level.cast("int").alias("level"), specifier.alias("specifier"), bindings.alias("bindings"),
                             kind.alias("kind"), type_only.alias("type_only"), dynamic.alias("dynamic"), computed.alias("computed"))

    statements = code.python_statements(files) if parts is None else parts.statements
    said = F.regexp_replace("said", r"\\(\r?\n)", " $1").alias("said")
    # Both forms read the few statements that hold the word.
    python = cut_lineage(statements.where(F.col("said").contains("import")).select(*FILE, "path", F.lit("python").alias("language"), "line", said))
    said = F.col("said")
    from_form = _PYTHON_LEAD + r"from\s*((?:\.\s*)*)([\w.]*)\s*\bimport\b([\s\S]*)"
    level = F.length(F.regexp_replace(F.regexp_extract(said, from_form, 1), r"\s", ""))
    found = [rows(python.where(said.rlike(from_form)), F.regexp_extract(said, from_form, 2), F.col("line"), level=level,
                  bindings=declarations.imported_names(F.concat(F.lit("import "), F.regexp_extract(said, from_form, 3))))]
    plain_form = _PYTHON_LEAD + r"import\s+([\w.][\s\S]*)"
    plain = python.where(said.rlike(plain_form)).withColumn("item", F.explode(F.split(F.regexp_extract(said, plain_form, 1), ",")))
    found.append(rows(plain, F.regexp_extract("item", r"^\s*([\w.]+)", 1), F.col("line")))

    java = code.brace_pieces(files.where("language = 'java'"), code.JAVA_TEXT) if parts is None else parts.java
    java_form = r"^(\s*)import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"
    name = F.regexp_extract(said, java_form, 2)
    last = F.element_at(F.split(name, r"\."), -1)
    found.append(rows(java.where(said.rlike(java_form)), name, F.col("line") + code.breaks(code.first_of(F.col("piece"), F.regexp_extract(said, java_form, 1))),
                      bindings=F.when(last != "*", F.array(F.struct(last.alias("name"), last.alias("alias")))).otherwise(no_bindings)))

    every = "(?=[eir])(?:" + "|".join(f"(?:{form})" for form in _SCRIPT_FORMS.values()) + ")"
    # A file's text is shielded once: its hits are made in one expression.
    placed = lambda raw, bare: F.transform(code.matches_with_places(bare, every), lambda h: F.struct(
        code.breaks(F.substring(raw, F.lit(1), h["at"])).alias("after"), h["text"].alias("text")))
    hits = let(code.shield(F.col("content"), code.SCRIPT_TEXT), lambda raw: let(code.bare(raw), lambda bare: F.when(bare.rlike(r"\b(?:import|export|require)\b"), placed(raw, bare))))
    scripts = files.where(F.col("language").isin(code.SCRIPTS) & F.col("content").rlike("import|export|require"))
    scripts = scripts.select(*FILE, "path", "language", F.explode(hits).alias("hit")).withColumn("text", F.col("hit.text"))
    scripts = scripts.withColumn("form", F.coalesce(*[F.when(F.col("text").rlike(f"^{form}"), F.lit(kind)) for kind, form in _SCRIPT_FORMS.items()]))
    part = lambda n: F.coalesce(*[F.when(F.col("form") == kind, F.regexp_extract("text", form, n)) for kind, form in _SCRIPT_FORMS.items()])
    scripts = scripts.withColumn("marked", part(1) != "").withColumn("clause", part(2)).withColumn("target", F.regexp_replace(part(3), r"^\s+|\s+$", "")).where("form IS NOT NULL")
    listed = F.filter(F.split(F.regexp_extract("clause", r"\{([^}]*)\}", 1), ","), lambda n: n.rlike(r"\S"))
    all_types = (F.size(listed) > 0) & F.forall(listed, lambda n: n.rlike(r"^\s*type\s+[\w$]"))
    member = rf"^\s*(?:type\s+)?({_NAME})(?:\s+as\s+({_NAME}))?"
    named = F.transform(listed, lambda n: F.struct(F.regexp_extract(n, member, 1).alias("name"), F.when(F.regexp_extract(n, member, 2) == "", F.regexp_extract(n, member, 1))
                                                   .otherwise(F.regexp_extract(n, member, 2)).alias("alias")))
    default = F.regexp_extract("clause", rf"^\s*({_NAME})\s*(?:,|$)", 1)
    defaults = F.when((F.col("form") == "clause") & (default != ""), F.array(F.struct(F.lit("default").alias("name"), default.alias("alias")))).otherwise(no_bindings)
    literal = F.col("target").rlike(rf"^{LITERAL}$") & ~code.restore(F.col("target")).rlike(r"\$\{")
    found.append(rows(scripts, F.when(literal, code.unquoted(F.col("target"))).otherwise(F.trim(code.restore(F.col("target")))), 1 + F.col("hit.after"),
                      bindings=F.concat(defaults, named), kind=F.when(F.col("form") == "reexport", "reexports").otherwise("imports"), type_only=F.col("marked") | all_types,
                      dynamic=F.col("form") == "dynamic", computed=~literal))
    whole = reduce(DataFrame.unionByName, found).withColumn("names", F.coalesce(F.transform("bindings", lambda b: b["name"]), no_names))
    return whole.withColumn("import_id", F.concat_ws("#", "file_id", "line_no", "kind", "specifier", "dynamic"))


def _first_match(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """candidates: analysis_id, import_id, candidates (paths in order of preference). The first that exists wins."""
    tried = candidates.select("analysis_id", "import_id", F.posexplode("candidates").alias("rank", "path"))
    known = files.select("analysis_id", "path").distinct()
    return tried.join(known, ["analysis_id", "path"]).groupBy("analysis_id", "import_id").agg(F.min_by("path", "rank").alias("target"))


def resolve_python(found: DataFrame, files: DataFrame) -> DataFrame:
    """Module file, package file, then the same below src/; for from-imports the imported names as modules after that."""
    folder = F.split(paths.parent_directory(F.col("path")), "/")
    depth = F.when(paths.parent_directory(F.col("path")) == ".", 0).otherwise(F.size(folder))
    base = F.when(F.col("level") > 0, F.slice(folder, F.lit(1), F.greatest(depth - F.col("level") + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    dotted = lambda m: F.filter(F.split(m, r"\."), lambda p: p != "")
    spread = lambda stem: F.array(*[F.concat(F.lit(a), stem, F.lit(z)) for a in ("", "src/") for z in (".py", "/__init__.py")])
    bound = found.where("language = 'python'").withColumn("_base", base)
    module = F.when(F.col("specifier") != "", spread(F.array_join(F.concat("_base", dotted(F.col("specifier"))), "/"))).otherwise(F.array().cast("array<string>"))
    named = F.flatten(F.transform("names", lambda n: spread(F.array_join(F.concat(F.col("_base"), dotted(F.col("specifier")), F.array(n)), "/"))))
    return _first_match(bound.withColumn("candidates", F.concat(module, named)).dropDuplicates(["analysis_id", "import_id"]), files)


def java_classes(files: DataFrame) -> DataFrame:
    package = F.regexp_extract(mask_comments(F.col("content")), r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    return files.where("language = 'java'").select("analysis_id", "path", "ord", package.alias("package"), paths.stem(F.col("path")).alias("stem")).where("package <> ''").select(
        "analysis_id", "path", "ord", F.concat_ws(".", "package", "stem").alias("qualified"))


def resolve_java(found: DataFrame, files: DataFrame) -> DataFrame:
    """The class itself, else the first class the name continues (static members), else the first class below a wildcard."""
    def prefixes(name: Column) -> Column:
        parts = F.split(name, r"\.")
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))

    classes = cut_lineage(java_classes(files))
    asked = found.where("language = 'java'").select("analysis_id", "import_id", "specifier").distinct()
    pick = lambda rows, tier: rows.select("analysis_id", "import_id", F.lit(tier).alias("tier"), "ord", "path")
    exact = asked.join(classes.withColumnRenamed("qualified", "specifier"), ["analysis_id", "specifier"])
    owner = asked.withColumn("qualified", F.explode(prefixes(F.col("specifier")))).join(classes, ["analysis_id", "qualified"])
    below = classes.withColumn("prefix", F.explode(prefixes(F.col("qualified")))).groupBy("analysis_id", "prefix").agg(F.min(F.struct("ord", "path")).alias("first"))
    wild = asked.where("specifier LIKE '%.*'").withColumn("prefix", F.regexp_replace("specifier", r"\.\*$", "")).join(below, ["analysis_id", "prefix"]).select("*", "first.*")
    hits = pick(exact, 0).unionByName(pick(owner, 1)).unionByName(pick(wild, 2))
    return hits.groupBy("analysis_id", "import_id").agg(F.min(F.struct("tier", "ord", "path")).alias("best")).select("analysis_id", "import_id", F.col("best.path").alias("target"))


def joined_path(folder: Column, relative: Column) -> Column:
    """Normal form of a relative path; a path that climbs out of the snapshot is null."""
    parts = F.filter(F.split(F.concat_ws("/", folder, relative), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array(F.lit("")), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return let(walked, lambda w: F.when(F.get(w, F.lit(0)) == "", F.array_join(F.slice(w, F.lit(2), F.size(w)), "/")))


def script_candidates(target: Column) -> Column:
    """Paths a script specifier may mean, in probing order; a .js name may stand for its TypeScript source."""
    swapped = F.regexp_replace(target, r"\.(js|jsx|mjs|cjs)$", "")
    swap = (F.when(target.endswith(".mjs"), F.array(*[F.concat(swapped, F.lit(e)) for e in (".mts", ".d.mts")]))
            .when(target.endswith(".cjs"), F.array(*[F.concat(swapped, F.lit(e)) for e in (".cts", ".d.cts")]))
            .when(target.rlike(r"\.jsx?$"), F.array(*[F.concat(swapped, F.lit(e)) for e in (".ts", ".tsx", ".d.ts")])).otherwise(F.array().cast("array<string>")))
    rest = F.array(target, *[F.concat(target, F.lit(e)) for e in SCRIPT_EXTENSIONS], *[F.concat(target, F.lit(f"/index{e}")) for e in SCRIPT_INDEXES])
    return F.filter(F.concat(swap, rest), lambda p: p.rlike(r"(?i)\.([cm]?[jt]s|[jt]sx)$"))


def resolve_script(found: DataFrame, files: DataFrame) -> DataFrame:
    """Relative specifiers from their folder; others through path aliases, the base URL, then the workspace package of that name."""
    def below(folder: Column, relative: Column) -> Column:
        return let(joined_path(F.when(folder == ".", "").otherwise(folder), relative), script_candidates)

    scripts = found.where(F.col("language").isin("typescript", "javascript") & ~F.col("computed")).dropDuplicates(["analysis_id", "import_id"])
    near = scripts.where(F.col("specifier").startswith(".")).withColumn("candidates", below(paths.parent_directory(F.col("path")), F.col("specifier")))
    bare = cut_lineage(scripts.where(~F.col("specifier").startswith(".")).select("analysis_id", "import_id", "path", "specifier"))
    both = bare.join(packages.aliased(bare, files), ["analysis_id", "import_id"], "left").join(packages.entries(bare, files), ["analysis_id", "import_id"], "left")
    root = F.concat_ws("/", "owner", F.coalesce("base", F.lit(".")))
    by_alias = F.flatten(F.transform("targets", lambda t: below(root, F.replace(t, F.lit("*"), F.col("star")))))
    by_base = F.when(F.col("base").isNotNull(), below(root, F.col("specifier")))
    tried = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in (by_alias, by_base, below(F.col("folder"), F.col("entry")))])
    rows = near.select("analysis_id", "import_id", "candidates").unionByName(both.select("analysis_id", "import_id", tried.alias("candidates")))
    return _first_match(rows, files)


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """Imports with their target path, null when nothing in the snapshot matches. They are written once: all resolvers read them."""
    found = cut_lineage(found)
    hits = resolve_python(found, files).unionByName(resolve_java(found, files)).unionByName(resolve_script(found, files))
    return found.join(hits, ["analysis_id", "import_id"], "left")


def _is_local(row_packages: Column) -> Column:
    script = F.col("language").isin("typescript", "javascript")
    return (F.col("level") > 0) | (script & (F.col("specifier").rlike(r"^[./#]|^[A-Za-z]:[/\\]") | row_packages))


def split_unresolved(resolved: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(external edges, unresolved references) of the imports without target: local names are never invented as edges, and a
    computed specifier is unresolved whatever it says."""
    names = workspace_packages(files).select("analysis_id", F.col("package").alias("root"), F.lit(True).alias("ours"))
    script = F.col("language").isin("typescript", "javascript")
    root = F.when(script, package_root(F.col("specifier"))).otherwise(F.element_at(F.split("specifier", r"\."), 1))
    open_ends = cut_lineage(resolved.where("target IS NULL").withColumn("root", root).join(names, ["analysis_id", "root"], "left"))
    meant = packages.aliased(open_ends.where(script), files).where("targets IS NOT NULL").select("analysis_id", "import_id", F.lit(True).alias("alias"))
    open_ends = open_ends.join(meant, ["analysis_id", "import_id"], "left")
    local = _is_local(F.coalesce("ours", F.lit(False)) | F.coalesce("alias", F.lit(False))) | F.col("computed")
    external = open_ends.where(~local & (F.col("root") != "")).select(*FILE, "path", "line_no", "specifier", "kind", "type_only", "dynamic", F.concat(F.lit("external:"), "root").alias("target"), "root")
    unresolved = open_ends.where(local).select(*FILE, "path", "line_no", F.concat(F.repeat(F.lit("."), F.col("level")), "specifier").alias("specifier"),
                                              F.when(F.col("computed"), "The specifier is computed.").otherwise("No source target in the snapshot.").alias("reason"))
    return external, unresolved


def import_edges(resolved: DataFrame) -> DataFrame:
    rows = resolved.where("target IS NOT NULL").select(
        "analysis_id", F.col("file_id").alias("source"), F.concat(F.lit("file:"), "target").alias("target"), "kind", "file_id", F.col("line_no").alias("start_line"), "specifier",
        F.lit("resolved").alias("resolution"), "type_only", "dynamic")
    return rows.withColumn("id", identity.edge_key(*[F.col(c) for c in ("source", "target", "kind", "file_id", "start_line", "specifier")]))


def python_declarations(files: DataFrame) -> DataFrame:
    """Functions, methods and classes of Python files with their line ranges."""
    return declarations.python(files)


def python_routes(files: DataFrame) -> DataFrame:
    """Route tags of Python files, one row per tag."""
    return declarations.python_tagged(files).select(*FILE, "name", F.explode("tags").alias("tag")).distinct()


def local_calls(files: DataFrame) -> DataFrame:
    """Calls of a Python file's own top-level names, from the innermost enclosing function or the file; never to itself."""
    own = files.where("language = 'python'")
    parts = code.parts_of(own)
    declared = declarations.declarations(own, parts)
    callers = declared.select(*FILE, F.col("symbol_id").alias("source"), F.col("name").alias("caller"))
    found = declarations.uses(parts, declarations.local_symbols(declared), declared.where("kind <> 'class'")).where("called")
    return found.join(callers, [*FILE, "source"], "left").select(*FILE, "caller", F.col("name").alias("callee"), "line_no")


def symbol_references(resolved: DataFrame, exported: DataFrame) -> DataFrame:
    """Imported names that mean exactly one exported symbol of the resolved file. exported: analysis_id, path, name, symbol_id."""
    named = resolved.where("target IS NOT NULL").select("analysis_id", "import_id", "file_id", "line_no", F.col("target").alias("path"), F.explode("names").alias("name"))
    hits = named.join(exported, ["analysis_id", "path", "name"])
    return hits.groupBy("analysis_id", "import_id", "file_id", "line_no", "name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1").drop("n")


def use_edges(parts: code.Parts, resolved: DataFrame, declared: DataFrame) -> DataFrame:
    """Edges from the symbol (or file) around each use of a name to the one symbol it stands for, in all languages.

    Names are those that imports bring in and, in scripts and Python, the file's own top-level functions and classes.
    ``calls`` where a callable is called, ``references`` for every use of an imported or script name.
    """
    languages = declared.select(*FILE, "language").distinct()
    imported = declarations.imported_symbols(resolved, declared).withColumn("imported", F.lit(True))
    local = declarations.local_symbols(declared.where("language <> 'java'")).withColumn("imported", F.lit(False))
    local = local.join(imported.select(*FILE, "name").distinct(), [*FILE, "name"], "left_anti")
    used = declarations.uses(parts, imported.unionByName(local), declared)
    used = used.join(imported.select(*FILE, "name", "imported").distinct(), [*FILE, "name"], "left").join(languages, FILE, "left")
    refers = F.coalesce("imported", F.lit(False)) | F.col("language").isin(code.SCRIPTS)
    kinds = F.filter(F.array(F.when(refers, F.lit("references")), F.when(F.col("called") & F.col("callable"), F.lit("calls"))), lambda k: k.isNotNull())
    edges = used.select("analysis_id", "source", F.col("symbol_id").alias("target"), F.explode(kinds).alias("kind"), "file_id", F.col("line_no").alias("start_line")).distinct()
    return edges.withColumn("specifier", F.lit(None).cast("string")).withColumn("resolution", F.lit("resolved"))


def module_hierarchy(files: DataFrame) -> DataFrame:
    """Every ancestor folder once, with its parent; the top folder hangs below the root module, the root below the repository."""
    above = files.select("analysis_id", F.explode(F.concat(F.array(F.lit(".")), paths.ancestors(F.col("path")))).alias("path")).distinct()
    parent = F.when(F.col("path") == ".", "repo").otherwise(F.concat(F.lit("module:"), paths.parent_directory(F.col("path"))))
    name = F.when(F.col("path") == ".", "Root").otherwise(paths.base_name(F.col("path")))
    return above.select("analysis_id", F.concat(F.lit("module:"), "path").alias("id"), "path", name.alias("name"), parent.alias("parent_id"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union of adapters reduced to the first row of each key; null key parts are equal."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])
