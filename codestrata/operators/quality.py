"""Data-quality checks: each returns the rows that break a rule."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import vectors


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an endpoint that is not a node, and which end it is."""
    known = nodes.select("analysis_id", "id")
    sides = [edges.join(known.withColumnRenamed("id", side), ["analysis_id", side], "left_anti")
             .select("analysis_id", "id", F.lit(side).alias("side"), F.col(side).alias("missing")) for side in ("source", "target")]
    return sides[0].unionByName(sides[1])


def duplicate_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def bad_ranges(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose file is unknown or whose lines or bytes fall outside it.

    rows: analysis_id, id, file_id, start_line, end_line, start_byte, end_byte.  files: …, line_count, byte_count.
    """
    known = files.select("analysis_id", "file_id", "line_count", "byte_count", F.lit(True).alias("known"))
    joined = rows.where("file_id IS NOT NULL").join(known, ["analysis_id", "file_id"], "left")
    lines = F.col("start_line").isNull() | ((F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("line_count")))
    spans = F.col("start_byte").isNull() | ((F.col("start_byte") >= 0) & (F.col("start_byte") <= F.col("end_byte")) & (F.col("end_byte") <= F.col("byte_count")))
    reason = (F.when(F.col("known").isNull(), "unknown_file").when(~F.coalesce(lines, F.lit(False)), "lines")
              .when(~F.coalesce(spans, F.lit(False)), "bytes"))
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("analysis_id", "id", "reason")


def broken_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Long table of (analysis_id, id, rule) for every rule that does not hold; a null counts as broken."""
    marks = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    broken = F.filter(F.array(*marks), lambda m: m.isNotNull())
    return rows.select("analysis_id", "id", F.explode(broken).alias("rule"))


def node_rules() -> dict[str, Column]:
    return {"id": F.col("id").isNotNull(), "kind": F.col("kind").isin(schemas.NODE_KINDS), "name": F.col("name").isNotNull(),
            "start_line": F.col("start_line").isNull() | (F.col("start_line") >= 1)}


def edge_rules() -> dict[str, Column]:
    return {"id": F.col("id").isNotNull(), "kind": F.col("kind").isin(schemas.EDGE_KINDS), "source": F.col("source").isNotNull(),
            "target": F.col("target").isNotNull(), "resolution": F.col("resolution").isin(schemas.RESOLUTIONS)}


def count_mismatches(declared: DataFrame, actual: dict[str, DataFrame]) -> DataFrame:
    """Declared against counted rows per snapshot and table; only differences are returned."""
    counted = [frame.groupBy("analysis_id").agg(F.count("*").alias("actual")).withColumn("table_name", F.lit(name))
               for name, frame in actual.items()]
    found = reduce(DataFrame.unionByName, counted)
    joined = declared.join(found, ["analysis_id", "table_name"], "full_outer")
    return joined.select("analysis_id", "table_name", F.coalesce("declared", F.lit(0)).alias("declared"),
                         F.coalesce("actual", F.lit(0)).alias("actual")).where("declared <> actual")


def bad_citations(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Citations of a file outside the snapshot, or of lines outside the file.

    citations: analysis_id, citation_id, file_id, start_line, end_line.
    """
    known = files.select("analysis_id", "file_id", "line_count")
    joined = citations.join(known, ["analysis_id", "file_id"], "left")
    inside = (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("line_count"))
    reason = F.when(F.col("line_count").isNull(), "unknown_file").when(~F.coalesce(inside, F.lit(False)), "lines")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("analysis_id", "citation_id", "reason")


def grounding(blocks: DataFrame, registry: DataFrame, relations: DataFrame) -> DataFrame:
    """Judge answers by their blocks.

    blocks: answer_id, block_no, kind, citation_ids, edge_ids.  registry: answer_id, citation_id.  relations: answer_id,
    edge_id.  An answer is valid when it has 1-20 blocks, cites and relates only what it was given, and every fact is cited.
    """
    def strangers(column: str, item: str, allowed: DataFrame, name: str) -> DataFrame:
        named = blocks.select("answer_id", F.explode(column).alias(item))
        outside = named.join(allowed.select("answer_id", item), ["answer_id", item], "left_anti")
        return outside.groupBy("answer_id").agg(F.count("*").alias(name))

    uncited = ((F.col("kind") == "fact") & (F.size("citation_ids") == 0)).cast("long")
    base = blocks.groupBy("answer_id").agg(F.count("*").alias("blocks"), F.sum(uncited).alias("uncited_facts"),
                                           F.sum((~F.col("kind").isin(schemas.BLOCK_KINDS)).cast("long")).alias("odd_kinds"),
                                           F.max((F.col("kind") == "inference").cast("int")).alias("has_inference"))
    used = (blocks.select("answer_id", F.explode("citation_ids").alias("citation_id"))
            .join(registry.select("answer_id", "citation_id"), ["answer_id", "citation_id"], "left_semi").distinct()
            .groupBy("answer_id").agg(F.count("*").alias("citations_used")))
    joined = (base.join(strangers("citation_ids", "citation_id", registry, "unknown_citations"), "answer_id", "left")
              .join(strangers("edge_ids", "edge_id", relations, "unknown_edges"), "answer_id", "left").join(used, "answer_id", "left")
              .na.fill(0, ["unknown_citations", "unknown_edges", "citations_used"]))
    reason = (F.when((F.col("blocks") < 1) | (F.col("blocks") > 20) | (F.col("odd_kinds") > 0), "shape")
              .when(F.col("unknown_citations") > 0, "citation").when(F.col("unknown_edges") > 0, "relationship")
              .when(F.col("uncited_facts") > 0, "uncited_fact"))
    return joined.select("answer_id", "blocks", "citations_used", reason.isNull().alias("valid"), reason.alias("reason"),
                         (F.col("has_inference") == 1).alias("inference_warning"))


def used_citations(blocks: DataFrame, registry: DataFrame) -> DataFrame:
    """The registered citations that an answer's blocks use: answer_id, citation_id, first_block, uses (blocks that name it).

    blocks: answer_id, block_no, citation_ids.  registry: answer_id, citation_id. A citation named twice in a block counts once.
    """
    named = blocks.select("answer_id", "block_no", F.explode(F.array_distinct("citation_ids")).alias("citation_id"))
    known = named.join(registry.select("answer_id", "citation_id"), ["answer_id", "citation_id"], "left_semi")
    return known.groupBy("answer_id", "citation_id").agg(F.min("block_no").alias("first_block"), F.count("*").alias("uses"))


def bad_vectors(rows: DataFrame, dimensions: int) -> DataFrame:
    """rows: id, embedding. Vectors of wrong size, with odd values, or of length zero."""
    return rows.select("id", vectors.vector_problem(F.col("embedding"), dimensions).alias("problem")).where("problem IS NOT NULL")


def batch_mismatches(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Batches whose answer has another number of vectors than were asked for."""
    a = sent.groupBy("batch_id").agg(F.count("*").alias("asked"))
    b = received.groupBy("batch_id").agg(F.count("*").alias("returned"))
    return a.join(b, "batch_id", "full_outer").na.fill(0).where("asked <> returned")
