"""Declarations of Python, Java and scripts with their ranges, owners, signatures and framework tags; use sites.

All languages give one table: analysis_id, file_id, path, language, place and end_place (the statements or pieces from the
one that declares to the last inside), level (indentation or brace depth), name, kind, start_line, head_line, end_line,
start_byte, end_byte, signature, exported, owner, owner_id, symbol_id, tags.
"""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import cut_lineage
from . import source_code as code
from .source_code import FILE, LITERAL

# What frameworks are recognised by.
ROUTER_MAKERS = "FastAPI|APIRouter|Flask|Blueprint"
ROUTE_METHODS = ["get", "post", "put", "patch", "delete", "head", "options", "api_view", "route"]
STEREOTYPES = ["RestController", "Controller", "Service", "Repository", "Component", "Configuration"]
HTTP_EXPORTS = "GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS"
EXPRESS_METHODS = "get|post|put|patch|delete|head|options|all|use"

COLUMNS = ["analysis_id", "file_id", "path", "language", "place", "end_place", "level", "name", "kind", "start_line", "head_line", "end_line", "start_byte", "end_byte", "signature",
           "exported", "owner", "owner_id", "symbol_id", "tags"]
HEAD = r"^\s*(async\s+def|def|class)\s+(\w+)"


def _no_tags() -> Column:
    return F.array().cast("array<string>")


def _symbol(path: str = "path", byte: str = "start_byte", name: str = "name") -> Column:
    return F.concat_ws(":", F.lit("symbol"), F.col(path), F.col(byte).cast("string"), F.col(name))


def _signature(shielded: Column) -> Column:
    """The head on one line, whole."""
    return F.trim(F.regexp_replace(code.restore(shielded), r"\s+", " "))


def joined_route(prefix: Column, route: Column) -> Column:
    whole = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(prefix, "^/+|/+$", ""), F.lit("/"), F.regexp_replace(route, "^/+", "")), "//+", "/")
    return F.when(whole == "/", "/").otherwise(F.regexp_replace(whole, "/+$", ""))


def imported_names(statement: Column) -> Column:
    """(name, alias) of what a Python from-import lists; the alias is the name where none is given."""
    listed = F.split(F.regexp_extract(statement, r"\bimport\b\s*\(?([^)]*)", 1), ",")
    form = r"^[\s\\]*(\w+|\*)(?:\s+as\s+(\w+))?"
    parts = F.transform(listed, lambda n: F.struct(F.regexp_extract(n, form, 1).alias("name"), F.regexp_extract(n, form, 2).alias("alias")))
    parts = F.filter(parts, lambda n: n["name"] != "")
    return F.transform(parts, lambda n: F.struct(n["name"].alias("name"), F.when(n["alias"] == "", n["name"]).otherwise(n["alias"]).alias("alias")))


# Python --------------------------------------------------------------------------------------------------------------

def python(files: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """Functions, classes and methods that stand at the top or directly in a class; decorators belong to them.

    A declaration ends with the last statement before the next one that is indented no deeper.
    """
    rows = code.python_statements(files) if statements is None else statements
    bare = F.col("said")
    rows = rows.withColumn("word", F.regexp_extract(bare, HEAD, 1)).withColumn("name", F.regexp_extract(bare, HEAD, 2)).withColumn("mark", bare.rlike(r"^\s*@"))
    # Only decorators and heads are read from here on, so no other text goes through the sweeps.
    rows = rows.withColumn("text", F.when(F.col("mark"), F.col("text"))).withColumn("said", F.when(F.col("word") != "", F.col("said")))
    ordered = Window.partitionBy(*FILE).orderBy("statement")
    # Decorators and the head they stand before share the count of other statements before them.
    run = F.coalesce(F.sum(F.when(F.col("mark"), 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("run", run).withColumn("before_end", F.lag(F.struct("end_line", "end_byte")).over(ordered))
    marks = Window.partitionBy(*FILE, "run")
    marked = F.col("mark") | (F.col("word") != "")
    rows = rows.withColumn("first", F.min(F.when(marked, F.struct("statement", "line", "byte"))).over(marks))
    rows = rows.withColumn("decorators", F.array_sort(F.collect_list(F.when(F.col("mark"), F.struct("statement", "text"))).over(marks)))
    whole = Window.partitionBy(*FILE)
    rows = rows.withColumn("levels", F.collect_set("indent").over(whole)).withColumn("last", F.max(F.struct("statement", "end_line", "end_byte")).over(whole))
    head = (F.col("word") != "") & F.col("indent").isNotNull()

    # The next statement at the same level or above ends it: neighbours in the sweep of its level.
    swept = rows.where("indent IS NOT NULL").withColumn("level", F.explode(F.filter("levels", lambda v: v >= F.col("indent"))))
    ends = swept.withColumn("stop", F.lead(F.struct("statement", "before_end")).over(Window.partitionBy(*FILE, "level").orderBy("statement")))
    ends = ends.where(head & (F.col("level") == F.col("indent")))
    end = F.coalesce("stop.before_end", F.struct("last.end_line", "last.end_byte"))
    ends = ends.withColumn("end", end).withColumn("stop_at", F.coalesce("stop.statement", F.col("last.statement") + 1))

    around = code.above(rows, "statement", F.col("levels"), F.col("indent"), F.struct("statement", "word", "name", F.col("first.byte").alias("byte")), head)
    found = ends.join(around, [*FILE, "statement"], "left").withColumn("around", F.coalesce("around", F.array().cast(around.schema["around"].dataType)))
    found = found.where(F.forall("around", lambda a: a["carried"]["word"] == "class"))
    owner = F.try_element_at("around", F.lit(-1))["carried"]
    kind = F.when(F.col("word") == "class", "class").when(F.size("around") > 0, "method").otherwise("function")
    owner_id = F.when(owner.isNotNull(), F.concat_ws(":", F.lit("symbol"), "path", owner["byte"].cast("string"), owner["name"]))
    found = found.select(
        *FILE, "path", F.lit("python").alias("language"), F.col("statement").alias("place"), (F.col("stop_at") - 1).alias("end_place"), F.col("indent").alias("level"), "name", kind.alias("kind"), F.col("first.line").alias("start_line"),
        F.col("line").alias("head_line"), F.col("end.end_line").alias("end_line"), F.col("first.byte").alias("start_byte"), F.col("end.end_byte").alias("end_byte"),
        _signature(F.col("said")).alias("signature"), (~F.col("name").startswith("_")).alias("exported"),
        F.coalesce(owner["name"], F.lit("")).alias("owner"), owner_id.alias("owner_id"), "decorators")
    return found.withColumn("symbol_id", _symbol())


def python_tagged(files: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """Declarations with route tags. A receiver counts only if the file makes it from a router class at its top level."""
    rows = code.python_statements(files) if statements is None else statements
    bare = F.col("said")
    made = rf"^(\w+)\s*(?::[^=]+)?=\s*(?:{ROUTER_MAKERS})\s*\("
    prefix = F.regexp_extract(bare, rf"\b(?:url_)?prefix\s*=\s*({LITERAL})", 1)
    receivers = rows.where((F.col("indent") == 0) & bare.rlike(made)).groupBy(*FILE, F.regexp_extract(bare, made, 1).alias("receiver")).agg(F.max_by(code.unquoted(prefix), "statement").alias("prefix"))
    views = rows.where(bare.rlike(r"^from\s+rest_framework\.decorators\s+import\b")).select(*FILE, F.explode(imported_names(bare)).alias("item"))
    views = views.where("item.name = 'api_view'").select(*FILE, F.col("item.alias").alias("receiver")).distinct()

    declared = cut_lineage(python(files, rows))
    form = rf"^\s*@\s*(\w+)(?:\.(\w+))?\s*\(\s*({LITERAL})?"
    marks = declared.select(*FILE, "place", F.posexplode("decorators").alias("nth", "mark")).withColumn("line_text", F.col("mark.text"))
    marks = marks.where(F.col("line_text").rlike(form)).select(
        *FILE, "place", "nth", F.regexp_extract("line_text", form, 1).alias("receiver"), F.lower(F.regexp_extract("line_text", form, 2)).alias("method"),
        F.regexp_extract("line_text", form, 3).alias("route"), F.regexp_extract("line_text", rf"\(\s*[\[(]\s*({LITERAL})", 1).alias("listed"))
    routed = marks.where(F.col("method").isin(ROUTE_METHODS)).join(receivers, [*FILE, "receiver"])
    path = joined_route(F.col("prefix"), code.unquoted(F.col("route")))
    tags = F.array(F.lit("api-handler"), F.concat(F.lit("http:"), F.upper("method")), F.when(F.col("route") != "", F.concat(F.lit("route:"), path)))
    routed = routed.select(*FILE, "place", "nth", tags.alias("tags"))
    viewed = marks.where("method = ''").join(views, [*FILE, "receiver"])
    method = F.when(F.col("listed") != "", F.upper(code.unquoted(F.col("listed")))).otherwise("ROUTE")
    viewed = viewed.select(*FILE, "place", "nth", F.array(F.lit("api-handler"), F.concat(F.lit("http:"), method)).alias("tags"))
    tagged = routed.unionByName(viewed).groupBy(*FILE, "place").agg(F.array_sort(F.collect_list(F.struct("nth", "tags"))).alias("rows"))
    tagged = tagged.select(*FILE, "place", F.filter(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["tags"]))), lambda t: t.isNotNull()).alias("tags"))
    found = declared.drop("decorators").join(tagged, [*FILE, "place"], "left").withColumn("tags", F.coalesce("tags", _no_tags()))
    return found.select(*COLUMNS).unionByName(django_routes(rows))


def django_routes(statements: DataFrame) -> DataFrame:
    """Calls of path() and re_path() from django.urls with a literal route, each a symbol of kind ``route``."""
    bare = F.col("said")
    helpers = statements.where(bare.rlike(r"^\s*from\s+django\.urls\s+import\b")).select(*FILE, F.explode(imported_names(bare)).alias("item"))
    helpers = helpers.where(F.col("item.name").isin("path", "re_path")).select(*FILE, F.col("item.alias").alias("helper")).distinct()
    calls = rf"(?<![\w.])\w+\s*\(\s*{LITERAL}"
    used = statements.where(F.col("text").rlike(calls)).join(helpers.select(*FILE).distinct(), FILE, "left_semi").select(
        *FILE, "path", "statement", "line", "byte", "text", F.posexplode(code.matches_with_places(F.col("text"), calls)).alias("nth", "hit"))
    used = used.withColumn("helper", F.regexp_extract("hit.text", r"^(\w+)", 1)).join(helpers, [*FILE, "helper"])
    skipped = F.substring("text", F.lit(1), F.col("hit.at"))
    line, at = F.col("line") + code.breaks(skipped), F.col("byte") + code.byte_length(skipped)
    route = code.unquoted(F.regexp_extract("hit.text", rf"({LITERAL})", 1))
    found = used.select(*FILE, "path", F.lit("python").alias("language"), F.col("statement").alias("place"), F.col("statement").alias("end_place"), F.lit(0).alias("level"), F.concat(F.lit("route@"), line.cast("string")).alias("name"), F.lit("route").alias("kind"),
                        line.alias("start_line"), line.alias("head_line"), line.alias("end_line"), at.alias("start_byte"), (at + code.byte_length(F.col("hit.text"))).alias("end_byte"),
                        _signature(F.col("hit.text")).alias("signature"), F.lit(True).alias("exported"), F.lit("").alias("owner"), F.lit(None).cast("string").alias("owner_id"),
                        F.array(F.lit("api-handler"), F.lit("http:ROUTE"), F.concat(F.lit("route:"), route)).alias("tags"))
    return found.withColumn("symbol_id", _symbol()).select(*COLUMNS)


# Java ----------------------------------------------------------------------------------------------------------------

_JAVA_TYPE = r"^([\s\S]*?)(?=[ceir])(?<![.\w$])(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)"
_JAVA_METHOD = r"([A-Za-z_$][\w$]*)\s*\((?:[^(){};]|\([^()]*\))*\)\s*(?:throws\s+[\w.$,\s]+)?$"
_JAVA_MAPPING = rf"@(Get|Post|Put|Patch|Delete|Request)Mapping\b(?:\s*\(\s*(?:(?:value|path)\s*=\s*)?[\[\uE27B]?\s*({LITERAL}))?"
_NOT_NAMES = ["if", "for", "while", "switch", "catch", "synchronized", "try", "do", "else", "return", "new"]
LEADING = r"^(\s*)"


def java(files: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """Types with a body and the methods directly in them, with Spring's stereotypes and mappings.

    A type starts at its keyword, a method at its first annotation or modifier; the route of a type's last mapping stands
    before those of its methods. Value braces in annotations are no blocks.
    """
    found = code.blocks(code.brace_pieces(files.where("language = 'java'"), code.JAVA_TEXT) if pieces is None else pieces)
    found = cut_lineage(found.withColumn("is_type", F.col("bare").rlike(_JAVA_TYPE)))
    types = found.where("is_type").withColumn("prefix", F.regexp_extract("bare", _JAVA_TYPE, 1)).withColumn("skipped", code.first_of(F.col("head"), F.col("prefix")))
    mapping = rf"^[\s\S]*{_JAVA_MAPPING}"
    base = F.regexp_extract("prefix", mapping, 2)
    stereotypes = F.filter(F.array(*[F.when(F.col("prefix").rlike(rf"@{s}\b"), F.lit(f"spring:{s.lower()}")) for s in STEREOTYPES]), lambda t: t.isNotNull())
    types = types.select(
        *FILE, "path", "language", F.col("seq").alias("place"), F.col("end_seq").alias("end_place"), F.col("depth").alias("level"), F.regexp_extract("bare", _JAVA_TYPE, 3).alias("name"), F.regexp_extract("bare", _JAVA_TYPE, 2).alias("kind"),
        (F.col("line") + code.breaks(F.col("skipped"))).alias("start_line"), "end_line", (F.col("byte") + code.byte_length(F.col("skipped"))).alias("start_byte"), "end_byte",
        F.expr("substring(bare, length(prefix) + 1)").alias("text"), stereotypes.alias("tags"),
        F.when(F.regexp_extract("prefix", mapping, 1) == "Request", code.unquoted(base)).otherwise("").alias("base"), F.lit("").alias("owner"), F.lit(None).cast("string").alias("owner_id")) \
        .withColumn("symbol_id", _symbol())

    plain = F.trim(F.regexp_replace("bare", r"\s+", " "))
    heads = found.where(~F.col("is_type") & plain.rlike(_JAVA_METHOD) & ~plain.rlike(r"(?:=|\bnew)\s*(?:new\s+)?[\w.<>$]+\s*\([^()]*\)$"))
    heads = heads.withColumn("name", F.regexp_extract(plain, _JAVA_METHOD, 1)).where(~F.col("name").isin(_NOT_NAMES)).withColumn("lead", F.regexp_extract("bare", LEADING, 1))
    heads = heads.withColumn("skipped", code.first_of(F.col("head"), F.col("lead"))).withColumn("mapped", F.regexp_extract("bare", mapping, 1)).withColumn("route", F.regexp_extract("bare", mapping, 2))
    homes = types.select(*FILE, F.col("place").alias("parent"), F.col("name").alias("owner"), F.col("symbol_id").alias("owner_id"), "base")
    heads = heads.join(homes, [*FILE, "parent"])
    said = code.unquoted(F.col("route"))
    route = F.when(F.col("route") != "", F.concat(F.lit("route:"), F.when(F.col("base") != "", joined_route(F.col("base"), said)).otherwise(said)))
    tags = F.when(F.col("mapped") != "", F.filter(F.array(F.lit("api-handler"), F.concat(F.lit("http:"), F.upper("mapped")), route), lambda t: t.isNotNull())).otherwise(_no_tags())
    methods = heads.select(
        *FILE, "path", "language", F.col("seq").alias("place"), F.col("end_seq").alias("end_place"), F.col("depth").alias("level"), "name", F.lit("method").alias("kind"), (F.col("line") + code.breaks(F.col("skipped"))).alias("start_line"), "end_line",
        (F.col("byte") + code.byte_length(F.col("skipped"))).alias("start_byte"), "end_byte", F.expr("substring(bare, length(lead) + 1)").alias("text"), tags.alias("tags"), "owner", "owner_id") \
        .withColumn("symbol_id", _symbol())
    both = types.drop("base").unionByName(methods)
    return both.select(*FILE, "path", "language", "place", "end_place", "level", "name", "kind", "start_line", F.col("start_line").alias("head_line"), "end_line", "start_byte", "end_byte",
                       _signature(F.col("text")).alias("signature"), (~F.col("name").startswith("_")).alias("exported"), "owner", "owner_id", "symbol_id", "tags")


# Scripts -------------------------------------------------------------------------------------------------------------

_NAME = r"[A-Za-z_$][\w$]*"
_MARKS = r"((?:export\s+|default\s+|declare\s+|abstract\s+|async\s+)*)"
_PARAMS = r"(?:<[^{};]*>\s*)?\((?:[^(){};]|\((?:[^(){};]|\([^(){};]*\))*\))*\)(?:\s*:[^{};=]+)?\s*"
_BEGINS = r"^([\s\S]*?)(?=[a-z])(?<![\w$.])"
# What the end of a block's head may declare: group 1 what stands before, 2 the marks, 3 the name.
_SCRIPT_HEADS = {
    "function": rf"{_BEGINS}{_MARKS}function\s*\*?\s*({_NAME})?\s*{_PARAMS}$",
    "class": rf"{_BEGINS}{_MARKS}class\b\s*((?!extends\b|implements\b){_NAME})?[^;]*$",
    "interface": rf"{_BEGINS}{_MARKS}interface\s+({_NAME})[^;]*$",
    "enum": rf"{_BEGINS}{_MARKS}(?:const\s+)?enum\s+({_NAME})\s*$",
    "arrow": rf"{_BEGINS}{_MARKS}(?:const|let|var)\s+({_NAME})\s*(?::[^;\n]*?)?=\s*(?:async\s*)?(?:{_PARAMS}=>|{_NAME}\s*=>|function\s*\*?\s*(?:{_NAME})?\s*{_PARAMS})\s*$",
}
_MEMBER = rf"^(\s*)((?:(?:public|private|protected|static|readonly|override|abstract|async)\s+|\*\s*)*)((?:(?:get|set)\s+)?#?{_NAME})\s*\??\s*{_PARAMS}$"
_MEMBER_ARROW = rf"^(\s*)((?:(?:public|private|protected|static|readonly|override)\s+)*)(#?{_NAME})\s*(?::[^;=]+)?=\s*(?:async\s*)?(?:{_PARAMS}|{_NAME}\s*)=>\s*$"
_DECORATORS = rf"^(\s*)(?:@[\w$.]+(?:\((?:[^(){{}}]|\([^(){{}}]*\))*\))?\s*)+"
# Declarations without a block of their own, one for each line that begins with one.
_ONE_LINERS = rf"(?m)^[ \t]*((?:export\s+|declare\s+)*)(type|const|let|var)\s+({_NAME})(?=\s*[=:<;])[^\n]*"


def script_texts(files: DataFrame) -> DataFrame:
    """Bare text (``said``) of script files, written once: a comment or a run of blanks is one blank, so places do not count."""
    own = files.where(F.col("language").isin(code.SCRIPTS) & F.col("content").rlike("import|export"))
    return cut_lineage(own.select(*FILE, code.squeezed(code.shield(F.col("content"), code.SCRIPT_TEXT)).alias("said")))


def scripts(files: DataFrame, pieces: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Functions, classes, interfaces, enums, type aliases, methods, and variables at the top of script files.

    Functions count wherever a block declares them, methods directly in a class; arrow functions go by the name they are
    assigned to. Exported is what is marked so, listed in an export clause or named as the default.
    """
    own = files.where(F.col("language").isin(code.SCRIPTS))
    pieces = code.brace_pieces(own, code.SCRIPT_TEXT) if pieces is None else pieces
    # No form begins with white space, and comments are white space: what leads is passed over before the forms are tried.
    lead, rest = F.regexp_extract("bare", LEADING, 1), F.regexp_replace("bare", r"^\s+", "")
    form = let(rest, lambda text: F.coalesce(*[F.when(text.rlike(form), F.lit(kind)) for kind, form in _SCRIPT_HEADS.items()]))
    blocks = cut_lineage(code.blocks(pieces).withColumn("form", form))
    heads = blocks
    part = lambda n: let(rest, lambda text: F.coalesce(*[F.when(F.col("form") == kind, F.regexp_extract(text, form, n)) for kind, form in _SCRIPT_HEADS.items()]))
    named = heads.where("form IS NOT NULL").withColumn("prefix", F.concat(lead, part(1))).withColumn("marks", part(2)).withColumn("name", part(3))
    named = named.withColumn("kind", F.when(F.col("form") == "arrow", "function").otherwise(F.col("form"))).withColumn("name", F.when(F.col("name") == "", "default").otherwise(F.col("name")))
    classes = named.where("form = 'class'").withColumn("start_byte", F.col("byte") + code.byte_length(code.first_of(F.col("head"), F.col("prefix")))).withColumn("symbol_id", _symbol())
    classes = classes.select(*FILE, F.col("seq").alias("parent"), F.col("name").alias("owner"), F.col("symbol_id").alias("owner_id"))

    # A member's decorators belong to it, but the forms look behind them.
    members = heads.where("form IS NULL").join(classes, [*FILE, "parent"]).withColumn("said", F.regexp_replace("bare", _DECORATORS, "$1"))
    arrow = F.col("said").rlike(_MEMBER_ARROW)
    name = F.when(arrow, F.regexp_extract("said", _MEMBER_ARROW, 3)).otherwise(F.regexp_extract("said", _MEMBER, 3))
    members = members.where(F.col("said").rlike(_MEMBER) | arrow).withColumn("name", F.regexp_replace(name, r"\s+", " ")).where(~F.col("name").isin(*_NOT_NAMES))
    members = members.withColumn("prefix", F.regexp_extract("bare", LEADING, 1)).withColumn("kind", F.lit("method")).withColumn("marks", F.lit(""))
    columns = [*FILE, "path", "language", "seq", "end_seq", "depth", "head", "bare", "prefix", "line", "byte", "name", "kind", "marks", "end_line", "end_byte"]
    nobody = [F.lit("").alias("owner"), F.lit(None).cast("string").alias("owner_id")]
    found = named.select(*columns, *nobody).unionByName(members.select(*columns, "owner", "owner_id")).withColumn("skipped", code.first_of(F.col("head"), F.col("prefix")))
    found = found.select(
        *FILE, "path", "language", F.col("seq").alias("place"), F.col("end_seq").alias("end_place"), F.col("depth").alias("level"), "name", "kind", "marks", (F.col("line") + code.breaks(F.col("skipped"))).alias("start_line"), "end_line",
        (F.col("byte") + code.byte_length(F.col("skipped"))).alias("start_byte"), "end_byte", F.expr("substring(bare, length(prefix) + 1)").alias("text"), "owner", "owner_id")

    lines = pieces.where(F.col("depth") == 0).withColumnRenamed("said", "bare").where(F.col("bare").rlike(_ONE_LINERS))
    lines = lines.select(*FILE, "path", "language", "seq", "piece", "bare", "line", "byte", F.posexplode(code.matches_with_places(F.col("bare"), _ONE_LINERS)).alias("nth", "hit"))
    # A declaration whose line ends with the piece's opening brace is that block's; the last one of a piece ends with it.
    lines = lines.withColumn("to_end", F.col("hit.at") + F.length("hit.text") >= F.length(F.regexp_replace("bare", r"\s+$", "")))
    lines = lines.where(~(F.col("to_end") & F.col("hit.text").endswith("{") & F.col("hit.text").rlike(rf"(?:=>|\bfunction\b.*|\b(?:class|enum)\b.*)\s*\{{$")))
    lead = F.length(F.regexp_extract("hit.text", r"^(\s*)", 1))
    skipped = F.substring("piece", F.lit(1), F.col("hit.at") + lead)
    last = F.col("nth") == F.max("nth").over(Window.partitionBy(*FILE, "seq"))
    until = F.when(last, F.length(F.regexp_replace("bare", r"\s+$", ""))).otherwise(F.col("hit.at") + F.length(F.regexp_replace("hit.text", r"\s+$", "")))
    reached = F.substring("piece", F.lit(1), until)
    # One that opens a block reaches to the block's end.
    opened = blocks.select(*FILE, "seq", F.struct("end_seq", "end_line", "end_byte").alias("block"))
    lines = lines.join(opened, [*FILE, "seq"], "left").withColumn("block", F.when(F.col("to_end") & F.col("hit.text").endswith("{"), F.col("block")))
    word, value = F.regexp_extract("hit.text", _ONE_LINERS, 2), F.col("hit.text").rlike(rf"=\s*(?:async\s*)?(?:{_PARAMS}|{_NAME}\s*)=>")
    lines = lines.select(
        *FILE, "path", "language", F.col("seq").alias("place"), F.coalesce("block.end_seq", "seq").alias("end_place"), F.lit(0).alias("level"), F.regexp_extract("hit.text", _ONE_LINERS, 3).alias("name"),
        F.when(word == "type", "type_alias").when(value, "function").otherwise("variable").alias("kind"), F.regexp_extract("hit.text", _ONE_LINERS, 1).alias("marks"),
        (F.col("line") + code.breaks(skipped)).alias("start_line"), F.coalesce("block.end_line", F.col("line") + code.breaks(reached)).alias("end_line"), (F.col("byte") + code.byte_length(skipped)).alias("start_byte"),
        F.coalesce("block.end_byte", F.col("byte") + code.byte_length(reached)).alias("end_byte"), F.regexp_replace("hit.text", r"\{$", "").alias("text"), *nobody)

    found = found.unionByName(lines).withColumn("symbol_id", _symbol())
    texts = script_texts(files) if texts is None else texts
    listed = texts.where(F.col("said").rlike(r"\bexport\b")).select(*FILE, F.explode(F.concat(
        F.flatten(F.transform(F.regexp_extract_all("said", F.lit(r"\bexport\s+(?:type\s+)?\{([^{}]*)\}(?!\s*from\b)"), F.lit(1)),
                              lambda x: F.transform(F.split(x, ","), lambda n: F.regexp_extract(n, rf"^\s*(?:type\s+)?({_NAME})", 1)))),
        F.regexp_extract_all("said", F.lit(rf"\bexport\s+default\s+({_NAME})\s*(?:;|\n|$)"), F.lit(1)))).alias("name")).distinct().withColumn("listed", F.lit(True))
    found = found.join(listed, [*FILE, "name"], "left")
    exported = F.col("marks").rlike(r"\b(?:export|default)\b") | (F.coalesce("listed", F.lit(False)) & (F.col("owner") == ""))
    return found.select(*FILE, "path", "language", "place", "end_place", "level", "name", "kind", "start_line", F.col("start_line").alias("head_line"), "end_line", "start_byte", "end_byte",
                        _signature(F.col("text")).alias("signature"), exported.alias("exported"), "owner", "owner_id", "symbol_id", F.col("marks").contains("default").alias("is_default"))


def script_tagged(files: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """Script declarations with tags: React components, handlers of route files and api pages, Express registrations."""
    own = files.where(F.col("language").isin(code.SCRIPTS))
    pieces = code.brace_pieces(own, code.SCRIPT_TEXT) if pieces is None else pieces
    texts = script_texts(files)
    declared = cut_lineage(scripts(files, pieces, texts))
    # Markup inside a function whose name begins with a capital makes it a component.
    markup = pieces.where(F.col("path").rlike(r"(?i)\.[jt]sx$|\.js$") & F.col("said").rlike(r"(?:\breturn|\(|=>|&&|\?|:)\s*<(?:[A-Za-z][\w.$]*|(?=>))"))
    drawn = code.enclosing(markup.select(*FILE, F.col("seq").alias("at")), spans_of(declared.where("kind = 'function'"))).where("span IS NOT NULL")
    drawn = drawn.select(*FILE, F.col("span.symbol_id").alias("symbol_id")).distinct().withColumn("draws", F.lit(True))
    found = declared.join(drawn, [*FILE, "symbol_id"], "left")
    file_route = F.col("path").rlike(r"(^|/)app/(.*/)?route\.[cm]?[jt]s$") & F.col("exported") & F.col("name").rlike(f"^({HTTP_EXPORTS})$")
    api_page = F.col("path").rlike(r"(^|/)pages/api/") & (F.col("is_default") | (F.col("name") == "handler"))
    rules = F.array(F.when(F.coalesce("draws", F.lit(False)) & (F.col("kind") == "function") & F.col("name").rlike("^[A-Z]"), F.lit("react-component")), F.when(file_route | api_page, F.lit("api-handler")),
                    F.when(file_route, F.concat(F.lit("http:"), "name")))

    texts = texts.where(F.col("said").rlike(r"\bimport\b"))
    clause = rf"\bimport\s+([^;]*?)\s+from\s+({LITERAL})"
    from_express = F.filter(F.arrays_zip(F.regexp_extract_all("said", F.lit(clause), F.lit(1)).alias("names"), F.regexp_extract_all("said", F.lit(clause), F.lit(2)).alias("source")),
                            lambda c: code.unquoted(c["source"]) == "express")
    words = F.array_distinct(F.flatten(F.transform(from_express, lambda c: F.regexp_extract_all(c["names"], F.lit(rf"({_NAME})(?=\s*(?:,|\}}|$))"), F.lit(1)))))
    texts = texts.withColumn("makers", words).where(F.size("makers") > 0)
    made = rf"\b(?:const|let|var)\s+({_NAME})\s*(?::[^=;]+)?=\s*({_NAME})(?:\.{_NAME})?\s*\("
    receivers = F.arrays_zip(F.regexp_extract_all("said", F.lit(made), F.lit(1)).alias("name"), F.regexp_extract_all("said", F.lit(made), F.lit(2)).alias("maker"))
    texts = texts.withColumn("receivers", F.transform(F.filter(receivers, lambda r: F.array_contains("makers", r["maker"])), lambda r: r["name"]))
    call = rf"(?<![\w$.])({_NAME})\.({EXPRESS_METHODS})\(\s*({LITERAL})\s*,([^;]*?)\)\s*(?:;|\n|$)"
    groups = [F.regexp_extract_all("said", F.lit(call), F.lit(n)).alias(c) for n, c in enumerate(("receiver", "method", "route", "handlers"), 1)]
    calls = texts.select(*FILE, "receivers", F.explode(F.arrays_zip(*groups)).alias("c")).where("array_contains(receivers, c.receiver)")
    calls = calls.withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all("c.handlers", F.lit(rf"(?:^|,)\s*({_NAME})\s*(?=,|$)"), F.lit(1)))))
    role = F.when(F.col("c.method") == "use", "api-middleware").otherwise("api-handler")
    tags = F.array(role, F.concat(F.lit("http:"), F.upper("c.method")), F.concat(F.lit("route:"), code.unquoted(F.col("c.route"))))
    served = calls.select(*FILE, "name", F.explode(tags).alias("tag")).groupBy(*FILE, "name").agg(F.array_sort(F.collect_set("tag")).alias("served"))
    found = found.join(served.withColumn("owner", F.lit("")).withColumn("kind", F.lit("function")), [*FILE, "name", "owner", "kind"], "left")
    every = F.concat(F.filter(rules, lambda t: t.isNotNull()), F.coalesce("served", _no_tags()))
    return found.withColumn("tags", F.array_distinct(every)).select(*COLUMNS)


# All languages, and what uses what ------------------------------------------------------------------------------------

def declarations(files: DataFrame, parts: code.Parts | None = None) -> DataFrame:
    parts = parts or code.parts_of(files)
    return cut_lineage(python_tagged(files, parts.statements).unionByName(java(files, parts.java)).unionByName(script_tagged(files, parts.scripts)))


def spans_of(declared: DataFrame) -> DataFrame:
    return declared.select(*FILE, "level", F.col("place").alias("opened"), F.col("end_place").alias("closed"), "symbol_id", "name", "kind")


_USES = {"python": r"(?=[A-Za-z_])(?<![\w.])[A-Za-z_]\w*(?:\s*\()?", "java": r"(?=[A-Za-z_$])(?<![\w$.])[A-Za-z_$][\w$]*(?:\s*\()?",
         # An import clause is one match, so the names in it are no uses.
         "script": rf"(?=[A-Za-z_$])(?<![\w$.])(?:(?:import|export)\b(?:\s+type\b)?[^;=()]*?\bfrom\s*{LITERAL}|{_NAME}(?:\s*(?:<[\w$\s,.\[\]]*>)?\()?)"}
_DECLARES = r"\b(?:def|class|interface|enum|record|function\s*\*?|type|const|let|var)\s+$"
_NEAR = 64


def _declared(said: Column, at: Column) -> Column:
    """Whether the word behind the first ``at`` characters is the name of a declaration. The characters nearest to it tell,
    if more of them than a keyword has stand before the blanks and stars between the two."""
    before = lambda size: F.substring(said, at - size + 1, size)
    return let(before(F.least(at, F.lit(_NEAR))), lambda near: F.when(near.rlike(r"^[\s\S]{10,}[^\s*][\s*]*$"), near.rlike(_DECLARES)).otherwise(before(at).rlike(_DECLARES)))


def uses(parts: code.Parts, names: DataFrame, declared: DataFrame) -> DataFrame:
    """Where the names of each file's ``names`` (analysis_id, file_id, name, symbol_id, callable) stand in its code.

    Columns: analysis_id, file_id, name, line_no, called, symbol_id, callable, source (the innermost function or class around the use,
    else the file). Only names a file knows are rows; declarations' own names and import statements are no uses.
    """
    known = names.groupBy(*FILE).agg(F.collect_set("name").alias("known"))
    statements = parts.statements.where(~F.col("said").rlike(r"^\s*(?:from|import)\b"))
    rows = [statements.select(*FILE, F.lit("python").alias("form"), F.col("statement").alias("at"), "line", F.col("text").alias("raw"), "said")]
    for form, pieces in (("java", parts.java), ("script", parts.scripts)):
        pieces = pieces.where(~F.col("said").rlike(r"^\s*(?:import|package)\b[^;]*;")) if form == "java" else pieces
        rows.append(pieces.select(*FILE, F.lit(form).alias("form"), F.col("seq").alias("at"), "line", F.col("piece").alias("raw"), "said"))
    spread = reduce(DataFrame.unionByName, rows).join(known, FILE)
    hits = F.coalesce(*[F.when(F.col("form") == form, code.matches_with_places(F.col("said"), pattern)) for form, pattern in _USES.items()])
    word = lambda h: F.regexp_extract(h["text"], r"^([\w$]+)", 1)
    hits = F.filter(hits, lambda h: F.array_contains("known", word(h)) & ~h["text"].rlike(r"\bfrom\s*\W") & ~_declared(F.col("said"), h["at"]))
    spread = spread.withColumn("hit", F.explode(hits))
    found = spread.select(*FILE, "at", word(F.col("hit")).alias("name"), (F.col("line") + code.breaks(F.substring("raw", F.lit(1), F.col("hit.at")))).alias("line_no"),
                          F.col("hit.text").endswith("(").alias("called"), F.col("hit.at").alias("column"))
    homes = spans_of(declared.where(~F.col("kind").isin("variable", "type_alias", "route")))
    placed = code.enclosing(found, homes)
    source = F.coalesce(F.col("span.symbol_id"), F.col("file_id"))
    placed = placed.withColumn("source", source).select(*FILE, "name", "line_no", "called", "source").distinct()
    one = names.groupBy(*FILE, "name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id"), F.max("callable").alias("callable")).where("n = 1").drop("n")
    return placed.join(one, [*FILE, "name"]).where("source <> symbol_id")


def imported_symbols(resolved: DataFrame, declared: DataFrame) -> DataFrame:
    """Names that imports bring into a file and the one top-level symbol of the resolved file each stands for."""
    named = resolved.where("target IS NOT NULL AND kind = 'imports'").select("analysis_id", "file_id", "target", F.explode("bindings").alias("b"))
    named = named.select("analysis_id", "file_id", F.col("target").alias("path"), F.col("b.name").alias("original"), F.col("b.alias").alias("name")).distinct()
    tops = declared.where("owner = '' AND kind <> 'route'").select("analysis_id", "path", F.col("name").alias("original"), "symbol_id", F.col("kind").isin("function", "class").alias("callable"))
    return named.join(tops, ["analysis_id", "path", "original"]).select("analysis_id", "file_id", "name", "symbol_id", "callable")


def local_symbols(declared: DataFrame) -> DataFrame:
    tops = declared.where("owner = '' AND kind IN ('function', 'class')")
    return tops.select("analysis_id", "file_id", "name", "symbol_id", F.lit(True).alias("callable"))
