"""Build snapshots' tables from their members: files, the graph of nodes and edges, regions, chunks and the overview."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, paths
from ..operators import chunking, declarations, extract, overview, source_code
from ..session import cut_lineage
from ..sources import snapshots

CODE = ["python", "java", "typescript", "javascript"]
NODE = {"kind": "string", "name": "string", "path": "string", "file_id": "string", "parent_id": "string", "language": "string", "symbol_kind": "string",
        "start_line": "int", "end_line": "int", "start_byte": "long", "end_byte": "long", "signature": "string", "exported": "boolean", "tags": "array<string>"}
EDGE = {"source": "string", "target": "string", "kind": "string", "file_id": "string", "start_line": "int", "specifier": "string", "resolution": "string",
        "type_only": "boolean", "dynamic": "boolean"}
EDGE_KEY = ["analysis_id", "source", "target", "kind", "file_id", "start_line", "specifier"]


def _shaped(rows: DataFrame, shape: dict[str, str], rank: int) -> DataFrame:
    """All columns of a shape, null where an adapter has none, and the adapter's rank."""
    return rows.select("analysis_id", *[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in shape.items()], F.lit(rank).alias("adapter"))


def nodes_of(files: DataFrame, declared: DataFrame, externals: DataFrame) -> DataFrame:
    """Repository, folders, files, symbols and external packages; of one id the first adapter's row stays."""
    modules = extract.module_hierarchy(files)
    parent = F.concat(F.lit("module:"), paths.parent_directory(F.col("path")))
    file_rows = files.select(
        "analysis_id", F.col("file_id").alias("id"), F.lit("file").alias("kind"), paths.base_name(F.col("path")).alias("name"), "path", "file_id", parent.alias("parent_id"), "language",
        F.lit(1).alias("start_line"), F.col("line_count").alias("end_line"), F.lit(0).alias("start_byte"), F.octet_length("content").alias("end_byte"))
    symbols = declared.withColumn("id", F.col("symbol_id")).withColumn("symbol_kind", F.col("kind")).withColumn("kind", F.lit("symbol")).withColumn("parent_id", F.coalesce("owner_id", "file_id"))
    repository = files.select("analysis_id").distinct().select("analysis_id", F.lit("repo").alias("id"), F.lit("repository").alias("kind"), F.lit("Repository").alias("name"))
    packages = externals.select("analysis_id", F.col("target").alias("id"), F.lit("external").alias("kind"), F.col("root").alias("name"))
    shape = {"id": "string", **NODE}
    rows = [_shaped(r, shape, n) for n, r in enumerate((repository, modules.withColumn("kind", F.lit("module")), file_rows, symbols, packages))]
    return extract.first_wins(reduce(DataFrame.unionByName, rows), ["analysis_id", "id"], ["adapter", "name"]).drop("adapter")


def edges_of(nodes: DataFrame, imports: DataFrame, externals: DataFrame, used: DataFrame) -> DataFrame:
    """Containment, imports and uses; equal keys (null parts are equal) give one edge, of the first adapter."""
    contains = nodes.where("parent_id IS NOT NULL").select("analysis_id", F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"),
                                                           F.lit("structural").alias("resolution"))
    outside = externals.select("analysis_id", F.col("file_id").alias("source"), "target", "kind", "file_id", F.col("line_no").alias("start_line"), "specifier",
                               F.lit("structural").alias("resolution"), "type_only", "dynamic")
    rows = [_shaped(r, EDGE, n) for n, r in enumerate((contains, imports, outside, used))]
    first = extract.first_wins(reduce(DataFrame.unionByName, rows), EDGE_KEY, ["adapter", "resolution", "type_only", "dynamic"])
    return first.withColumn("id", identity.edge_key(*[F.col(c) for c in EDGE_KEY[1:]])).drop("adapter")


def graph(files: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, regions (what symbols cover), unresolved references and declarations of snapshots' code files."""
    own = files.where(F.col("language").isin(CODE))
    parts = source_code.parts_of(files)
    resolved = cut_lineage(extract.resolve(extract.imports(files, parts), files))
    externals, unresolved = extract.split_unresolved(resolved, files)
    externals = cut_lineage(externals)
    declared = declarations.declarations(files, parts)
    nodes = cut_lineage(nodes_of(own, declared, externals))
    edges = edges_of(nodes, extract.import_edges(resolved), externals, extract.use_edges(parts, resolved, declared))
    regions = declared.select("analysis_id", "file_id", "symbol_id", F.col("name").alias("symbol"), "kind", F.col("start_line").cast("int").alias("start_line"),
                              F.col("end_line").cast("int").alias("end_line"), "start_byte", "end_byte", "signature")
    return {"nodes": nodes, "edges": edges, "regions": regions, "unresolved": unresolved, "imports": resolved, "declarations": declared}


def build(members: DataFrame, config: str) -> dict[str, DataFrame]:
    """members: analysis_id, path, content, ord.  Returns the tables of ``graph`` with files, chunks, stack and entries."""
    files = cut_lineage(snapshots.profile_files(members.where(paths.is_eligible(F.col("path")))))
    tables = graph(files)
    regions = tables["regions"].where("kind <> 'class'")
    return {"files": files, **tables, "chunks": chunking.build_chunks(files, regions, config),
            "stack": overview.detected(files, overview.manifest_dependencies(files)), "entries": overview.entry_points(files)}


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table below the folder, a directory for each snapshot, so that a request reads its own snapshot only."""
    for name, table in tables.items():
        table.write.partitionBy("analysis_id").mode("errorifexists").parquet(f"{folder}/{name}")
