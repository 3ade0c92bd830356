"""Source files to citable text chunks."""
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ranking import top_per_group
from ..session import cut_lineage

# Chunk sizes in characters.
CUT_CHARS, LONG_LINE_CHARS = 4800, 8000
SMALL_CHARS, GROUP_CHARS, GROUP_GAP_LINES, GROUP_NAMES = 700, 1800, 3, 8
PREVIEW_BYTES = 500_000

FILE_KEY = ["analysis_id", "file_id"]


def select_regions(regions: DataFrame) -> DataFrame:
    """Smallest regions first, skipping any that shares a line with one already taken.

    Files are cut into islands of touching regions first. Lone regions are taken as they are; only real overlaps are
    folded, one short list per island.
    """
    before = Window.partitionBy(*FILE_KEY).orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*FILE_KEY).orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce((F.col("start_line") > F.max("end_line").over(before)), F.lit(True)).cast("int")
    island = regions.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(upto)).drop("_fresh")
    island = island.withColumn("_size", F.count("*").over(Window.partitionBy(*FILE_KEY, "_island")))
    names = regions.columns
    lone = island.where("_size = 1").select(*names)
    ordered = F.array_sort(F.collect_list(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "start_line", "end_line", F.struct(*names).alias("row"))))
    folded = island.where("_size > 1").groupBy(*FILE_KEY, "_island").agg(ordered.alias("_all")).select(F.explode(F.expr(
        "aggregate(_all, slice(_all, 1, 0), (a, x) -> if(exists(a, t -> x.start_line <= t.end_line AND t.start_line <= x.end_line), a, concat(a, array(x))))")).alias("k"))
    return lone.unionByName(folded.select("k.row.*"))


def uncovered_runs(files: DataFrame, regions: DataFrame) -> DataFrame:
    """Maximal runs of lines outside every region. files: analysis_id, file_id, language, lines (count)."""
    spans = regions.select(*FILE_KEY, "start_line", "end_line")
    before = Window.partitionBy(*FILE_KEY).orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spans.withColumn("_from", F.coalesce(F.max("end_line").over(before), F.lit(0)) + 1).select(
        *FILE_KEY, F.col("_from").alias("start_line"), (F.col("start_line") - 1).alias("end_line"))
    # Files and what lies in them grow together: neither side of these joins is ever collected, however small it is written.
    tails = files.join(spans.groupBy(*FILE_KEY).agg(F.max("end_line").alias("_last")).hint("merge"), FILE_KEY, "left").select(
        *FILE_KEY, (F.coalesce("_last", F.lit(0)) + 1).alias("start_line"), F.col("lines").alias("end_line"))
    kind = F.when(F.col("language") == "markdown", "documentation").otherwise("top-level")
    known = files.select(*FILE_KEY, "language", "lines")
    runs = gaps.unionByName(tails).join(known.hint("merge"), FILE_KEY).withColumn("end_line", F.least("end_line", "lines"))
    return runs.where("start_line <= end_line").select(*FILE_KEY, "start_line", "end_line", kind.alias("kind"))


_PIECE = "struct<s:int,e:int,o:int>"
_FOLD = f"""transform(regions, r -> named_struct('r', r, 'cuts', aggregate(
  transform(sequence(r.start_line, least(r.end_line, size(lines))), n -> named_struct('n', n, 'len', length(element_at(lines, n)))),
  named_struct('start', r.start_line, 'chars', 0, 'out', cast(array() AS array<{_PIECE}>)),
  (a, x) -> CASE
    WHEN x.len > {LONG_LINE_CHARS} THEN named_struct('start', x.n + 1, 'chars', 0, 'out', concat(a.out,
      if(a.chars > 0, array(named_struct('s', a.start, 'e', x.n - 1, 'o', 0)), cast(array() AS array<{_PIECE}>)),
      transform(sequence(0, x.len - 1, {CUT_CHARS}), o -> named_struct('s', x.n, 'e', x.n, 'o', o))))
    WHEN a.chars > 0 AND a.chars + x.len > {CUT_CHARS} THEN named_struct('start', x.n, 'chars', x.len,
      'out', concat(a.out, array(named_struct('s', a.start, 'e', x.n - 1, 'o', 0))))
    ELSE named_struct('start', a.start, 'chars', a.chars + x.len, 'out', a.out) END,
  a -> if(a.chars > 0, concat(a.out, array(named_struct('s', a.start, 'e', least(r.end_line, size(lines)), 'o', 0))), a.out))))"""


def split_regions(files: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions cut into pieces of bounded size, with their text.

    A file's regions are disjoint, so the list carried beside its row is at most as long as the file. The cuts are a
    fold over line lengths inside the row: no shuffle of line text, no Python.
    """
    carried = ["start_line", "end_line", "kind", "symbol_id", "symbol", "signature"]
    per_file = regions.groupBy(*FILE_KEY).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) if c.endswith("_line") else F.col(c) for c in carried]))).alias("regions"))
    base = files.select(*FILE_KEY, "path", "language", text.lines_with_ends(F.col("content")).alias("lines")).join(per_file.hint("merge"), FILE_KEY)
    base = base.withColumn("regions", F.expr("filter(regions, r -> r.start_line <= size(lines))"))
    # Each piece takes its text along inside the row; what is exploded no longer holds the file's lines.
    whole = ("CASE WHEN c.s = c.e AND length(element_at(lines, c.s)) > %d THEN substring(element_at(lines, c.s), c.o + 1, %d) "
             "ELSE array_join(slice(lines, c.s, c.e - c.s + 1), '') END" % (LONG_LINE_CHARS, CUT_CHARS))
    pieces = F.expr(f"flatten(transform({_FOLD}, f -> transform(f.cuts, c -> named_struct('c', c, 'r', f.r, 'text', {whole}))))")
    cut = base.select(*FILE_KEY, "path", "language", F.explode(pieces).alias("p"))
    return cut.select(*FILE_KEY, "path", "language", F.col("p.c.s").alias("start_line"), F.col("p.c.e").alias("end_line"),
                      F.col("p.c.o").alias("offset"), F.col("p.r.kind").alias("kind"), F.col("p.r.symbol_id").alias("symbol_id"),
                      F.coalesce("p.r.symbol", F.lit("")).alias("symbol"), F.coalesce("p.r.signature", F.lit("")).alias("signature"), F.col("p.text").alias("text"))


def group_type(body: Column, symbol_id: Column, kind: Column) -> Column:
    source = F.regexp_replace(body, r"^\s+", "")
    imports = (source.startswith("import ") | source.startswith("export * from ") | (source.startswith("export { ") & source.contains(" from ")))
    return (F.when(F.length(body) > SMALL_CHARS, F.lit(None)).when(imports, "imports").when(symbol_id.isNotNull(), "declarations")
            .when(kind.isin("statement", "top-level"), "statements"))


def group_small(pieces: DataFrame) -> DataFrame:
    """Neighbouring small pieces of one type packed into one citable span of bounded size.

    The fold streams over piece sizes only, in file order, keeping one open group; texts are joined by Spark inside each group (at most 1,800
    characters). Pieces cover their file without gaps, so a running sum of sizes gives character offsets.
    """
    typed = pieces.withColumn("type", group_type(F.col("text"), F.col("symbol_id"), F.col("kind")))
    meta = typed.select(*FILE_KEY, "start_line", "end_line", "offset", "type", F.length("text").alias("size"), (~F.col("text").rlike(r"\S")).alias("blank"))

    def pack(batches):
        file, group, kind, last, opened, at, waiting = None, -1, None, 0, 0, 0, []
        for rows in batches:
            out = []
            for a, f, start, end, offset, this, size, blank in rows.itertuples(index=False, name=None):
                if (a, f) != file:
                    file, group, kind, at, waiting = (a, f), -1, None, 0, []
                begin, at = at, at + size
                if blank:
                    waiting.append((a, f, start, offset))
                    continue
                if kind is not None and this == kind and start <= last + GROUP_GAP_LINES and at - opened <= GROUP_CHARS:
                    out += [(*w, group) for w in waiting]
                else:
                    # A span is measured by whole lines: a piece from inside a line opens at that line's start.
                    group, opened, kind = group + 1, begin - offset, this if isinstance(this, str) else None
                waiting, last = [], end
                out.append((a, f, start, offset, group))
            yield pd.DataFrame(out, columns=["analysis_id", "file_id", "start_line", "offset", "group"])

    in_order = meta.repartition(*FILE_KEY).sortWithinPartitions(*FILE_KEY, "start_line", "offset")
    placed = in_order.mapInPandas(pack, "analysis_id string, file_id string, start_line int, offset int, `group` int")
    members = typed.join(placed, [*FILE_KEY, "start_line", "offset"])
    real = F.col("text").rlike(r"\S")
    merged = members.groupBy(*FILE_KEY, "path", "language", "group").agg(
        F.sum(real.cast("int")).alias("n"), F.min("start_line").alias("start_line"), F.max(F.when(real, F.col("end_line"))).alias("end_line"),
        F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("start_line", "offset", "text", "symbol", "kind", "symbol_id", "signature", "type"))).alias("m"))
    first = F.element_at("m", 1)
    names = F.array_join(F.slice(F.array_distinct(F.filter(F.transform("m", lambda x: x["symbol"]), lambda x: x != "")), 1, GROUP_NAMES), ", ")
    single = F.col("n") == 1
    return merged.select(*FILE_KEY, "path", "language", "start_line", "end_line", "offset",
                         F.when(single, first["kind"]).otherwise(first["type"]).alias("kind"), F.when(single, first["symbol_id"]).alias("symbol_id"),
                         F.when(single, first["symbol"]).otherwise("").alias("symbol"), F.when(single, first["signature"]).otherwise(names).alias("signature"),
                         F.array_join(F.transform("m", lambda x: x["text"]), "").alias("text"))


def chunk_records(pieces: DataFrame, config: str) -> DataFrame:
    """Header, embedding text, content hash and id of each non-blank piece."""
    header = F.concat(F.lit("File: "), "path", F.lit("\nLanguage: "), "language", F.lit("\nSymbol: "), "symbol", F.lit("\nSignature: "), "signature",
                      F.lit("\nLines: "), "start_line", F.lit("-"), "end_line", F.lit("\n"))
    rows = pieces.where(F.col("text").rlike(r"\S")).withColumn("embedding_text", F.concat(header, "text"))
    rows = rows.withColumn("input_hash", F.sha2(F.concat(F.lit(config), "embedding_text"), 256)).withColumn("embedding_config", F.lit(config))
    return rows.withColumn("id", F.concat_ws(":", F.lit("chunk"), "path", "start_line", "end_line", "offset", F.substring("input_hash", 1, 8)))


def build_chunks(files: DataFrame, regions: DataFrame, config: str, grouped: bool = True) -> DataFrame:
    """files: file records.  regions: analysis_id, file_id, start_line, end_line, kind, symbol_id, symbol, signature."""
    chosen = select_regions(regions)
    sized = files.select(*FILE_KEY, "language", F.size(text.lines_with_ends(F.col("content"))).alias("lines"))
    runs = uncovered_runs(sized, chosen)
    pieces = split_regions(files, chosen.unionByName(runs, allowMissingColumns=True))
    return chunk_records(group_small(pieces) if grouped else pieces, config)


def path_score(path: Column) -> Column:
    """Higher for overview documents and manifests, entry-like names and service folders."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    overview = name.startswith("readme") | name.isin("package.json", "pyproject.toml", "pom.xml")
    entry = F.element_at(F.split(name, r"\."), 1).isin("main", "index", "app", "server", "routes", "api")
    service = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in ("routes", "api", "services", "server", "src")]))
    return F.when(overview, 6).otherwise(0) + F.when(entry, 5).otherwise(0) + F.when(service, 2).otherwise(0)


def preview_order(chunks: DataFrame) -> DataFrame:
    """Add the round-robin order: first chunk of every path, best paths first, then the second of every path, …"""
    inside = Window.partitionBy("analysis_id", "path").orderBy("ord")
    return chunks.withColumn("round", F.row_number().over(inside)).withColumn("priority", -path_score(F.col("path")))


def select_preview(chunks: DataFrame, budget: int = PREVIEW_BYTES, batch: int = 1000) -> DataFrame:
    """Half of each snapshot's chunks at most, within a byte budget, spread over its files.

    chunks: analysis_id, id, path, ord, size.  A chunk that would pass the budget is discarded; a full round that adds
    nothing ends the selection. The greedy rule is exact but no snapshot is gathered whole: each pass folds the next
    ``batch`` chunks that still fit what is left, and what does not fit now never will.
    """
    ordered = cut_lineage(preview_order(chunks).select("analysis_id", "id", "size", F.struct("round", "priority", "path", "ord").alias("at")))
    state = ordered.groupBy("analysis_id").agg(F.ceil(F.count("*") / 2).cast("long").alias("target"), F.min("at").alias("at")).select(
        "analysis_id", F.lit(budget).cast("long").alias("left"), F.lit(0).cast("long").alias("taken"), "target", F.lit(0).cast("long").alias("last_round"),
        F.lit(None).cast(ordered.schema["at"].dataType).alias("after"))
    schema = "analysis_id string, id string, `left` long, taken long, target long, last_round long, position long"

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        left, taken, target, last = (int(rows[c].iloc[0]) for c in ("left", "taken", "target", "last_round"))
        kept, live = [], True
        for key, size, turn in zip(rows.id, rows["size"], rows["round"]):
            if taken >= target or turn > last + 1:
                live = False
                break
            if size <= left:
                left, taken, last = left - int(size), taken + 1, int(turn)
                kept.append(key)
        head = rows.analysis_id.iloc[0]
        more = int(rows.position.iloc[-1]) if live and taken < target and len(rows) == batch else -1
        return pd.DataFrame([(head, k, 0, 0, 0, 0, 0) for k in kept] + [(head, None, left, taken, target, last, more)],
                            columns=["analysis_id", "id", "left", "taken", "target", "last_round", "position"])

    chosen = None
    while True:
        ahead = ordered.join(state, "analysis_id").where((F.col("size") <= F.col("left")) & (F.col("after").isNull() | (F.col("at") > F.col("after"))))
        nearest = cut_lineage(top_per_group(ahead, ["analysis_id"], [F.col("at")], batch, "position"))
        folded = cut_lineage(nearest.select("analysis_id", "id", "size", F.col("at.round").alias("round"), F.col("position").cast("long").alias("position"),
                                            "left", "taken", "target", "last_round").groupBy("analysis_id").applyInPandas(fold, schema))
        kept = folded.where("id IS NOT NULL").select("analysis_id", "id")
        chosen = kept if chosen is None else chosen.unionByName(kept)
        resumed = folded.where("id IS NULL AND position > 0")
        if resumed.isEmpty():
            return chosen
        place = nearest.select("analysis_id", F.col("position").cast("long").alias("position"), F.col("at").alias("after"))
        state = cut_lineage(resumed.join(place, ["analysis_id", "position"]).select("analysis_id", "left", "taken", "target", "last_round", "after"))


def coverage(chunks: DataFrame, selected: DataFrame) -> DataFrame:
    total = chunks.groupBy("analysis_id").agg(F.count("*").alias("total_chunks"))
    kept = selected.groupBy("analysis_id").agg(F.count("*").alias("indexed_chunks"))
    return total.join(kept, "analysis_id", "left").na.fill(0, ["indexed_chunks"])
