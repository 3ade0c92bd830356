"""Source text as rows: pieces between structural characters, logical statements, and what encloses what.

Comments and string literals are shielded first: each of their ASCII characters moves to a private code point (U+E000 and
up for literals, U+E100 and up for comments), so that patterns, brackets and line ends see code only, while every length stays
as it was and the text can be restored.
Pieces of a file are then counted by running sums over the file (lines, bytes, bracket depth); statements are the islands
between places where the depth is zero. Nothing is compared with everything: what encloses a row is found by one sweep over
each (file, level), where a level is an indentation or a brace depth, so a row is copied once for each level of its nesting.

A file is one bounded group; its rows are sorted in its task and spill to disk. A text that itself holds code points from
U+E000 to U+E07E gets ASCII characters for them when restored.
"""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage

FILE = ["analysis_id", "file_id"]
_ASCII = "".join(map(chr, [9, 10, 13, *range(32, 127)]))
_IN_LITERAL = "".join(chr(0xE000 + ord(c)) for c in _ASCII)
_IN_COMMENT = "".join(chr(0xE100 + ord(c)) for c in _ASCII)
_IN_VALUE = "\ue27b\ue27d"      # braces that hold no statements
HIDDEN = r"[\uE000-\uE27E]"
LITERAL = r"[\uE022\uE027\uE060][\uE000-\uE07E]*"      # a string literal, quotes included

# What is shielded in each language, longest forms first. The bodies are possessive: each character is looked at once.
_QUOTED = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"' r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_DOUBLES, _SINGLES = r'"{3}[^"]*+(?:"(?!"")[^"]*+)*+"{3}', r"'{3}[^']*+(?:'(?!'')[^']*+)*+'{3}"
_REMARK = r"//[^\n]*|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
PYTHON_TEXT = rf"#[^\n]*|{_DOUBLES}|{_SINGLES}|{_QUOTED}"
JAVA_TEXT = f"{_REMARK}|{_DOUBLES}|{_QUOTED}"
SCRIPT_TEXT = (_REMARK + r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`|" + _QUOTED
               + r"|/(?<=[=(,:;!&|?{}\[\n]\s{0,20}/)(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
SCRIPTS = ["typescript", "javascript"]


def shield(content: Column, pattern: str) -> Column:
    comment = lambda m: m.startswith("#") | m.startswith("//") | m.startswith("/*")
    return text.replace_matches(content, pattern, lambda m: F.when(comment(m), F.translate(m, _ASCII, _IN_COMMENT)).otherwise(F.translate(m, _ASCII, _IN_LITERAL)))


def restore(shielded: Column) -> Column:
    return F.translate(shielded, _IN_LITERAL + _IN_COMMENT + _IN_VALUE, _ASCII + _ASCII + "{}")


def bare(shielded: Column) -> Column:
    """Comments as spaces; every character keeps its place."""
    return F.translate(shielded, _IN_COMMENT, " " * len(_IN_COMMENT))


def squeezed(shielded: Column) -> Column:
    """The bare text with one blank for each run of comments and blanks."""
    return F.regexp_replace(shielded, f"[ {any_of(_IN_COMMENT)}]+", " ")


def first_of(shielded: Column, prefix: Column) -> Column:
    """The characters of the text that ``prefix``, found in its bare form, covers."""
    return F.substring(shielded, F.lit(1), F.length(prefix))


def unquoted(literal: Column) -> Column:
    """The text of a shielded string literal."""
    return F.regexp_replace(restore(literal), r"^['\"`]+|['\"`]+$", "")


def any_of(characters: str) -> str:
    """What stands between the brackets of a pattern for any of the characters, neighbours as ranges."""
    codes = sorted(map(ord, characters))
    firsts = [c for c in codes if c - 1 not in codes]
    lasts = [c for c in codes if c + 1 not in codes]
    return "".join(rf"\x{{{first:X}}}-\x{{{last:X}}}" for first, last in zip(firsts, lasts))


def count_of(value: Column, characters: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, f"[{any_of(characters)}]+", ""))


def breaks(shielded: Column) -> Column:
    """Line feeds, inside literals and comments too."""
    return count_of(shielded, "\n\ue00a\ue10a")


def byte_length(shielded: Column) -> Column:
    """Bytes of the restored text: a hidden character takes three bytes and stands for one."""
    return F.octet_length(shielded) - 2 * count_of(shielded, _IN_LITERAL + _IN_COMMENT + _IN_VALUE)


def with_places(files: DataFrame, pieces: Column, keep: list[str]) -> DataFrame:
    """One row for each piece with ``seq``, ``line`` and ``byte`` of its start. The pieces together are the whole text."""
    spread = files.select(*FILE, *keep, F.posexplode(pieces).alias("seq", "piece"))
    before = Window.partitionBy(*FILE).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (spread.withColumn("line", (1 + F.coalesce(F.sum(breaks(F.col("piece"))).over(before), F.lit(0))).cast("int"))
            .withColumn("byte", F.coalesce(F.sum(byte_length(F.col("piece"))).over(before), F.lit(0)).cast("long")))


def matches_with_places(value: Column, pattern: str) -> Column:
    """Matches of a pattern in a text, each with the characters before it (``at``)."""
    found, gaps = F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), F.split(value, pattern, -1)
    pairs = F.zip_with(gaps, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    at = lambda done, pair: done["at"] + F.length(pair["gap"])
    step = lambda done, pair: F.struct(
        F.concat(done["rows"], F.array(F.struct(at(done, pair).alias("at"), pair["hit"].alias("text")))).alias("rows"),
        (at(done, pair) + F.coalesce(F.length(pair["hit"]), F.lit(0))).alias("at"))
    start = F.struct(F.array().cast("array<struct<at:int,text:string>>").alias("rows"), F.lit(0).alias("at"))
    return F.filter(F.aggregate(pairs, start, step, lambda done: done["rows"]), lambda r: r["text"].isNotNull())


# Python: statements and indentation ----------------------------------------------------------------------------------

def python_statements(files: DataFrame) -> DataFrame:
    """Logical statements: brackets and backslashes join lines, semicolons part them, strings never end one.

    Columns: analysis_id, file_id, path, statement, text (shielded), said (bare), line, end_line, byte, end_byte, indent (null
    after a semicolon). Blank lines and lines of comments are no statements; a docstring is one. In text whose brackets do not
    match, a statement ends with the first line that closes as many as are open.
    """
    shielded = shield(F.col("content"), PYTHON_TEXT)
    pieces = F.regexp_extract_all(shielded, F.lit(r"[^\n;]*[\n;]|[^\n;]+"), F.lit(0))
    rows = with_places(files.where("language = 'python'"), pieces, ["path"])
    ordered = Window.partitionBy(*FILE).orderBy("seq")
    rows = rows.withColumn("net", count_of(F.col("piece"), "([{") - count_of(F.col("piece"), ")]}"))
    open_before = F.coalesce(F.sum("net").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lag("piece").over(ordered)
    rows = rows.withColumn("begins", (last.isNull() | ((open_before <= 0) & ~last.rlike(r"\\\r?\n$"))).cast("int"))
    rows = rows.withColumn("starts_line", F.coalesce(last.endswith("\n"), F.lit(True)))
    rows = rows.withColumn("statement", F.sum("begins").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda p: p["piece"]), "")
    found = rows.groupBy(*FILE, "path", "statement").agg(whole.alias("text"), F.min("line").alias("line"), F.min("byte").alias("byte"), F.min_by("starts_line", "seq").alias("starts_line"))
    found = found.where(F.col("text").rlike(rf"[^\s;{any_of(_IN_COMMENT)}]")).withColumn("said", bare(F.col("text"))).withColumn("bare", F.regexp_replace("said", r"[\s;]+$", ""))
    return found.select(*FILE, "path", "statement", "text", "said", "line", (F.col("line") + breaks(first_of(F.col("text"), F.col("bare")))).alias("end_line"), "byte",
                        (F.col("byte") + byte_length(F.col("text"))).alias("end_byte"),
                        F.when(F.col("starts_line"), F.length(F.regexp_extract("text", r"^([ \t]*)", 1))).alias("indent"))


def above(rows: DataFrame, order: str, levels: Column, level: Column, carried: Column, ask: Column) -> DataFrame:
    """For rows where ``ask`` holds: every row that encloses them, as (``level``, ``carried``), outermost first in ``around``.

    ``levels`` are the levels of the row's file. A row stands in the sweep of each level from its own up, and an asking row
    in those below too; the last row at or under a level before it encloses it if that row is exactly at the level.
    """
    spread = rows.withColumn("_mine", level).withColumn("_ask", ask).withColumn("_carried", carried)
    spread = spread.withColumn("_level", F.explode(F.filter(levels, lambda v: F.coalesce((v >= F.col("_mine")) | F.col("_ask"), F.col("_ask")))))
    sweep = Window.partitionBy(*FILE, "_level").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("_mine") <= F.col("_level"), F.struct("_mine", "_carried")), ignorenulls=True).over(sweep)
    spread = spread.withColumn("_seen", seen).where(F.col("_ask") & (F.col("_level") < F.coalesce("_mine", F.lit(1 << 30))) & (F.col("_seen._mine") == F.col("_level")))
    return spread.groupBy(*FILE, order).agg(F.array_sort(F.collect_list(F.struct(F.col("_level").alias("level"), F.col("_seen._carried").alias("carried")))).alias("around"))


# Java and scripts: blocks in braces ----------------------------------------------------------------------------------

# Braces that hold no statements: after ( , = : [ ? | & < they are values, parameters or types, after import names.
# What stands before is looked at behind the brace, so once for each brace and not for each character.
_VALUE_BRACES = r"\{(?<=(?:[(,=:\[?|&<]\s{0,20}|\b(?:import|export|type)\s{0,20})\{)([^{};]*)\}"


def brace_pieces(files: DataFrame, pattern: str) -> DataFrame:
    """Pieces that end with a brace or semicolon, with line, byte and brace depth of their start and their bare text (``said``); value braces part nothing."""
    shielded = shield(F.col("content"), pattern)
    for _ in range(4):
        shielded = F.regexp_replace(shielded, _VALUE_BRACES, f"{_IN_VALUE[0]}$1{_IN_VALUE[1]}")
    pieces = F.regexp_extract_all(shielded, F.lit(r"[^{};]*[{};]|[^{};]+"), F.lit(0))
    rows = with_places(files, pieces, ["path", "language"])
    step = F.when(F.col("piece").endswith("{"), 1).when(F.col("piece").endswith("}"), -1).otherwise(0)
    before = Window.partitionBy(*FILE).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)).cast("int")).withColumn("said", bare(F.col("piece")))


def blocks(pieces: DataFrame) -> DataFrame:
    """Every block with its head (the piece before its brace), where it ends, and its parent block.

    Columns: analysis_id, file_id, path, language, seq, head, bare, line, byte, depth, end_seq, end_line, end_byte, parent.
    In the sweep of a depth, the row after an opening brace is the closing one; a block that is never closed ends with the
    file.
    """
    ends_line, ends_byte = F.col("line") + breaks(F.col("piece")), F.col("byte") + byte_length(F.col("piece"))
    whole = Window.partitionBy(*FILE)
    rows = pieces.withColumn("stop_line", ends_line.cast("int")).withColumn("stop_byte", ends_byte) \
                 .withColumn("last", F.max(F.struct("seq", "stop_line", "stop_byte")).over(whole))
    opens, closes = F.col("piece").endswith("{"), F.col("piece").endswith("}")
    levels = F.when(opens, F.array(F.col("depth"), F.col("depth") - 1)).when(closes, F.array(F.col("depth") - 1))
    rows = rows.where(opens | closes).withColumn("opens", opens).withColumn("level", F.explode(levels))
    own = F.col("opens") & (F.col("level") == F.col("depth"))
    sweep = Window.partitionBy(*FILE, "level").orderBy("seq")
    # An opening brace asks in the sweep one level up for its parent; that row neither opens nor closes the level.
    rows = rows.withColumn("parent", F.last(F.when(own, F.col("seq")), ignorenulls=True).over(sweep.rowsBetween(Window.unboundedPreceding, -1)))
    asked = rows.where(F.col("opens") & ~own).select(*FILE, "seq", "parent")
    closed = rows.where(own | ~F.col("opens"))
    after = F.lead(F.when(~F.col("opens"), F.struct("seq", "stop_line", "stop_byte"))).over(sweep)
    closed = closed.withColumn("end", F.coalesce(after, F.col("last"))).where("opens").drop("parent")
    return closed.join(asked, [*FILE, "seq"]).select(
        *FILE, "path", "language", "seq", F.regexp_replace("piece", r"\{$", "").alias("head"), F.regexp_replace("said", r"\{$", "").alias("bare"), "line", "byte", "depth",
        F.col("end.seq").alias("end_seq"), F.col("end.stop_line").alias("end_line"), F.col("end.stop_byte").alias("end_byte"), "parent")


def enclosing(places: DataFrame, spans: DataFrame) -> DataFrame:
    """Each place (analysis_id, file_id, at, ...) with the innermost span around it as struct ``span``, null for none.

    spans: analysis_id, file_id, level, opened, closed, and more. Spans of one level of a file never overlap, so the last one
    opened at a level before the place is the only one that can hold it. Places are copied once for each level that the file's
    spans have, and swept with the spans of that level.
    """
    keys = [c for c in places.columns if c not in FILE]
    rest = [c for c in spans.columns if c not in [*FILE, "level"]]
    levels = spans.groupBy(*FILE).agg(F.collect_set("level").alias("levels"))
    asked = places.withColumn("_row", F.struct(*keys)).join(levels, FILE, "left")
    asked = asked.select(*FILE, F.explode_outer("levels").alias("level"), F.col("at").alias("_at"), F.lit(1).alias("_turn"), "_row", F.lit(None).cast(spans.select(F.struct(*rest).alias("s")).schema["s"].dataType).alias("_span"))
    opened = spans.select(*FILE, "level", F.col("opened").alias("_at"), F.lit(0).alias("_turn"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.struct(*rest).alias("_span"))
    sweep = Window.partitionBy(*FILE, "level").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    seen = asked.unionByName(opened).withColumn("_seen", F.last("_span", ignorenulls=True).over(sweep)).where("_turn = 1")
    held = F.when(F.col("_seen.closed") >= F.col("_at"), F.struct("level", F.col("_seen").alias("span")))
    found = seen.groupBy(*FILE, "_row").agg(F.max_by(held, F.when(held.isNotNull(), F.col("level"))).alias("_best"), F.max(F.when(held.isNotNull(), 1)).alias("_any"))
    return found.select(*FILE, "_row.*", F.when(F.col("_any") == 1, F.col("_best.span")).alias("span"))


@dataclass
class Parts:
    """Statements of Python files and pieces of Java and script files, written once for all that reads them."""
    statements: DataFrame
    java: DataFrame
    scripts: DataFrame


def parts_of(files: DataFrame) -> Parts:
    return Parts(cut_lineage(python_statements(files)), cut_lineage(brace_pieces(files.where("language = 'java'"), JAVA_TEXT)),
                 cut_lineage(brace_pieces(files.where(F.col("language").isin(SCRIPTS)), SCRIPT_TEXT)))
