"""Graph operators over node and edge tables of many snapshots."""
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.ranking import top_per_group
from ..schemas import CODE_LANGUAGES
from ..session import cut_lineage, release
from .traversal import expand, present

DEFAULT_NODE_CAP, MAX_NODES, MAX_EDGES = 100, 1000, 5000
IMPACT_FILE_CAP = 501
WALK_STEPS, WALK_STARTS, WALK_BRANCHES = 8, 30, 20


def links_of(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Non-containment edges as (node -> neighbor) links."""
    live = edges.where("kind <> 'contains'").select("analysis_id", "source", "target", F.col("ord").alias("k1"),
                                                    F.col("id").alias("k2"))
    forward = live.select("analysis_id", F.col("source").alias("node"), F.col("target").alias("neighbor"), "k1", "k2")
    backward = live.select("analysis_id", F.col("target").alias("node"), F.col("source").alias("neighbor"), "k1", "k2")
    return {"dependencies": forward, "dependents": backward, "both": forward.unionByName(backward)}[direction]


def neighbors(nodes: DataFrame, edges: DataFrame, requests: DataFrame, direction: str = "both", depth: int = 1,
              cap: int = DEFAULT_NODE_CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, omitted) around each requested node. requests: request_id, analysis_id, node_id."""
    known = nodes.select("analysis_id", F.col("id").alias("node"))
    start = cut_lineage(requests.select("request_id", "analysis_id", F.col("node_id").alias("node")))
    seen, omitted = expand(present(start, known), links_of(edges, direction), depth, cap, known)
    opened = seen.where(F.col("distance") < depth)
    live = edges.where("kind <> 'contains'").select("analysis_id", "id", "source", "target", "ord")
    kept = []
    for near, far, wanted in (("source", "target", "dependencies"), ("target", "source", "dependents")):
        if direction in ("both", wanted):
            touched = live.join(opened.select("request_id", "analysis_id", F.col("node").alias(near)), ["analysis_id", near])
            kept.append(touched.join(seen.select("request_id", F.col("node").alias(far)), ["request_id", far], "left_semi")
                        .select("request_id", "analysis_id", "id", "source", "target", "ord"))
    chosen = kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1]).distinct()
    return seen, chosen, omitted


def module_candidates(nodes: DataFrame) -> DataFrame:
    """Directory boundaries: modules at most two levels deep, the root only when code sits directly in it.

    A snapshot without any boundary falls back to its repository and root rows.
    """
    depth = F.size(F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda p: ~p.isin("", ".")))
    shallow = nodes.where(F.col("kind").isin("repository", "module") & ((F.col("kind") == "repository") | (depth <= 2)))
    is_boundary = (F.col("kind") == "module") & F.col("path").isNotNull() & ~F.col("path").isin("", ".")
    bounded = shallow.where(is_boundary).select("analysis_id").distinct()
    rooted = nodes.where((F.col("kind") == "file") & (F.col("parent_id") == "module:.")
                         & F.col("language").isin(CODE_LANGUAGES)).select("analysis_id").distinct()
    roots = shallow.where("id = 'module:.'").join(rooted, "analysis_id", "left_semi").join(bounded, "analysis_id", "left_semi")
    fallback = shallow.where(~is_boundary).join(bounded, "analysis_id", "left_anti")
    return shallow.where(is_boundary).unionByName(roots).unionByName(fallback)


def container_children(nodes: DataFrame, requests: DataFrame, level: str) -> DataFrame:
    """What a focused repository or module shows: its children, or every file below it.

    Files are matched to folders through their ancestor list, an equality join, not by prefix comparison.
    requests: request_id, analysis_id, node_id.
    """
    focus = requests.join(nodes.select("analysis_id", F.col("id").alias("node_id"), F.col("kind").alias("focus_kind"),
                                       F.col("path").alias("focus_path")), ["analysis_id", "node_id"])
    focus = focus.where(F.col("focus_kind").isin("repository", "module"))
    if level == "files":
        folder = F.regexp_replace(F.coalesce("focus_path", F.lit("")), "/+$", "")
        folders = focus.select("request_id", "analysis_id", F.when(folder.isin("", "."), F.lit("")).otherwise(folder).alias("folder"))
        up = F.when(F.col("path").contains("/"), F.concat(F.array(F.lit("")), paths.ancestors(F.col("path")))).otherwise(F.array(F.lit("")))
        files = nodes.where("kind = 'file'").withColumn("folder", F.explode(up))
        return files.join(folders, ["analysis_id", "folder"]).select("request_id", *nodes.columns)
    below = nodes.join(focus.select("request_id", "analysis_id", F.col("node_id").alias("parent_id")), ["analysis_id", "parent_id"])
    itself = nodes.join(focus.select("request_id", "analysis_id", F.col("node_id").alias("id")), ["analysis_id", "id"])
    return below.select("request_id", *nodes.columns).unionByName(itself.select("request_id", *nodes.columns))


def file_symbols(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """A focused file with everything declared in it."""
    want = requests.select("request_id", "analysis_id", "node_id")
    inside = nodes.join(want.withColumnRenamed("node_id", "file_id"), ["analysis_id", "file_id"])
    itself = nodes.join(want.withColumnRenamed("node_id", "id"), ["analysis_id", "id"])
    return (inside.select("request_id", *nodes.columns).unionByName(itself.select("request_id", *nodes.columns))
            .dropDuplicates(["request_id", "analysis_id", "id"]))


def module_ancestors(nodes: DataFrame) -> DataFrame:
    """(analysis_id, node, module, up): every module on the way from a node to the root, nearest first.

    Follows parent_id, then file_id. A round joins all chains with their next parent; rounds go on until no chain grows, so
    their number is the depth of the folder tree. A chain ends where it would come to a node it has passed.
    """
    parent = F.coalesce(F.nullif(F.col("parent_id"), F.lit("")), F.when(F.col("file_id") != F.col("id"), F.col("file_id")))
    up_edges = nodes.select("analysis_id", F.col("id").alias("at"), "kind", parent.alias("next"))
    # Containers are few next to files and symbols, so they get the closure and the others join their container's.
    containers = up_edges.where("kind IN ('module', 'repository')")
    chain = cut_lineage(containers.select("analysis_id", F.col("at").alias("node"), "at", "kind", "next", F.lit(0).alias("up")))
    closure, step = chain, chain
    for round_no in count(1):
        grown = step.select("analysis_id", "node", F.col("next").alias("at")).where("at IS NOT NULL").join(
            closure.select("analysis_id", "node", "at"), ["analysis_id", "node", "at"], "left_anti")
        grown = grown.join(containers, ["analysis_id", "at"]).withColumn("up", F.lit(round_no))
        step = cut_lineage(grown.select(*chain.columns))
        if step.isEmpty():
            break
        closure = closure.unionByName(step)
    modules = closure.where("kind = 'module'").select("analysis_id", "node", F.col("at").alias("module"), "up")
    leaves = up_edges.where("kind NOT IN ('module', 'repository')").select("analysis_id", F.col("at").alias("node"), "next")
    # A symbol's parent may be a class: climb inside files until the container is reached.
    owned, climbing = None, leaves
    passed = leaves.select("analysis_id", "node", "next")
    while True:
        hit = climbing.join(modules.select("analysis_id", F.col("node").alias("next"), "module", "up"), ["analysis_id", "next"])
        hit = hit.select("analysis_id", "node", "module", (F.col("up") + 1).alias("up"))
        owned = hit if owned is None else owned.unionByName(hit)
        climbing = climbing.join(leaves.select("analysis_id", F.col("node").alias("next"), F.col("next").alias("above")),
                                 ["analysis_id", "next"]).select("analysis_id", "node", F.col("above").alias("next"))
        climbing = cut_lineage(climbing.where("next IS NOT NULL").join(passed, ["analysis_id", "node", "next"], "left_anti"))
        if climbing.isEmpty():
            break
        passed = passed.unionByName(climbing)
    return modules.unionByName(owned)


def module_rollup(nodes: DataFrame, edges: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports and re-exports lifted to the nearest selected module of each end.

    selected: analysis_id, id, and request_id where several requests select for themselves.  Returns the aggregates (one row per source, target, kind with a count) and their member
    edges as rows, so a pair of busy modules never becomes one oversized array.
    """
    by = ["request_id"] if "request_id" in selected.columns else []
    chosen = selected.select(*by, "analysis_id", F.col("id").alias("module"))
    nearest = (module_ancestors(nodes).join(chosen, ["analysis_id", "module"])
               .groupBy(*by, "analysis_id", "node").agg(F.min_by("module", "up").alias("module")))
    nearest = cut_lineage(nearest)
    lifted = (edges.where("kind IN ('imports', 'reexports')").select("analysis_id", "id", "source", "target", "kind", "ord")
              .join(nearest.select(*by, "analysis_id", F.col("node").alias("source"), F.col("module").alias("from_module")), ["analysis_id", "source"])
              .join(nearest.select(*by, "analysis_id", F.col("node").alias("target"), F.col("module").alias("to_module")), [*by, "analysis_id", "target"])
              .where("from_module <> to_module"))
    members = lifted.select(*by, "analysis_id", F.concat_ws(":", F.lit("aggregate"), "from_module", "to_module", "kind").alias("id"),
                            F.col("from_module").alias("source"), F.col("to_module").alias("target"), "kind",
                            F.col("id").alias("edge_id"), "ord")
    totals = members.groupBy(*by, "analysis_id", "id", "source", "target", "kind").agg(
        F.count("*").alias("count"), F.min(F.struct("ord", "edge_id")).alias("first"))
    return totals, members


def project(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, level: str, *, language: str | None = None,
            kind: str | None = None, limit: int = DEFAULT_NODE_CAP, drop_contains: bool = False
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A bounded view: filtered and capped candidates, the edges among them, what was left out.

    candidates: request_id plus the node columns.  Returns (nodes, edges, omitted counts).
    """
    limit = max(1, min(MAX_NODES, limit))
    if language:
        candidates = candidates.where((F.col("language") == language) | F.col("kind").isin("repository", "module"))
    if kind:
        candidates = candidates.where((F.col("kind") == kind) | F.coalesce(F.col("symbol_kind") == kind, F.lit(False)))
    order = [F.col("kind") != "repository", F.coalesce("path", F.lit("")), F.col("name"), F.col("ord"), F.col("id")]
    totals = candidates.groupBy("request_id").agg(F.count("*").alias("candidates"))
    chosen = cut_lineage(top_per_group(candidates, ["request_id"], order, limit).select(
        "request_id", "analysis_id", "id", "kind", "name", "path", "rank"))
    ends = chosen.select("request_id", "analysis_id", "id")
    live = edges.where("kind <> 'contains'") if drop_contains else edges
    induced = (live.select("analysis_id", "id", "source", "target", "kind", "ord")
               .join(ends.withColumnRenamed("id", "source"), ["analysis_id", "source"])
               .join(ends.select("request_id", F.col("id").alias("target")), ["request_id", "target"], "left_semi"))
    shown = induced.select("request_id", "analysis_id", "id", "source", "target", "kind", F.lit(1).cast("long").alias("count"),
                           F.lit(0).alias("part"), "ord", F.col("id").alias("tie"))
    if level == "modules":
        rolled, _ = module_rollup(nodes, edges, ends)
        shown = shown.unionByName(rolled.select(
            "request_id", "analysis_id", "id", "source", "target", "kind", "count", F.lit(1).alias("part"),
            F.col("first.ord").alias("ord"), F.col("first.edge_id").alias("tie")))
    shown = cut_lineage(shown)
    edge_limit = min(MAX_EDGES, limit * 2)
    kept = top_per_group(shown, ["request_id"], [F.col("part"), F.col("ord"), F.col("tie")], edge_limit)
    edge_totals = shown.groupBy("request_id").agg(F.count("*").alias("shown"))
    omitted = totals.join(edge_totals, "request_id", "left").select(
        "request_id", F.greatest(F.col("candidates") - limit, F.lit(0)).alias("omitted_nodes"),
        F.greatest(F.coalesce("shown", F.lit(0)) - edge_limit, F.lit(0)).alias("omitted_edges"))
    return chosen, kept.select("request_id", "analysis_id", "id", "source", "target", "kind", "count", "rank"), omitted


def file_of(kind: Column, node_id: Column, file_id: Column) -> Column:
    return F.when(kind == "file", node_id).otherwise(file_id)


def file_relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges folded to their files; the first edge of a pair of files stands for it.

    Targets go first: edges to what lies in no file end there. What is left is written, so the shuffles of one join are gone
    before the next one's are made.
    """
    homes = nodes.select("analysis_id", "id", file_of(F.col("kind"), F.col("id"), F.col("file_id")).alias("home")).where("home IS NOT NULL")
    carried = ["ord", "id", "kind", "file_id", "start_line", "end_line"]
    inside = cut_lineage(edges.where("kind <> 'contains'").select("analysis_id", "source", "target", *carried)
                         .join(homes.select("analysis_id", F.col("id").alias("target"), F.col("home").alias("target_file")), ["analysis_id", "target"]).drop("target"))
    folded = (inside.join(homes.select("analysis_id", F.col("id").alias("source"), F.col("home").alias("source_file")), ["analysis_id", "source"])
              .where("source_file <> target_file"))
    first = folded.groupBy("analysis_id", "source_file", "target_file").agg(F.min(F.struct(*carried)).alias("edge"))
    return first.select("analysis_id", "source_file", "target_file", F.col("edge.id").alias("edge_id"),
                        F.col("edge.kind").alias("kind"), F.col("edge.file_id").alias("file_id"),
                        F.col("edge.start_line").alias("start_line"), F.col("edge.end_line").alias("end_line"))


def with_citation(rows: DataFrame, files: DataFrame, edge_id: str = "edge_id") -> DataFrame:
    """Add citation id and path when the cited lines lie inside the cited file.

    Rows without a file match none; by the hash of their own id they spread over the tasks of the join.
    """
    known = files.select("analysis_id", "file_id", F.col("path").alias("citation_path"), "line_count").alias("k")
    spread = F.xxhash64(F.coalesce("r.file_id", F.col(f"r.{edge_id}"))) == F.xxhash64("k.file_id")
    cited = spread & (F.col("r.analysis_id") == F.col("k.analysis_id")) & (F.col("r.file_id") == F.col("k.file_id"))
    own = ["analysis_id", "file_id", *[c for c in rows.columns if c not in ("analysis_id", "file_id")]]
    joined = rows.alias("r").join(known, cited, "left").select(
        *[F.col(f"r.`{c}`") for c in own], "citation_path", "line_count")
    end = F.coalesce("end_line", "start_line")
    valid = (F.col("start_line") >= 1) & (F.col("start_line") <= end) & (end <= F.col("line_count"))
    return (joined.withColumn("citation", F.when(valid, F.concat(F.lit("E"), F.substring(F.sha2(F.col(edge_id), 256), 1, 12))))
            .withColumn("citation_path", F.when(valid, F.col("citation_path"))).drop("line_count"))


def impact(nodes: DataFrame, edges: DataFrame, files: DataFrame, requests: DataFrame, depth: int = 3,
           cap: int = IMPACT_FILE_CAP) -> tuple[DataFrame, DataFrame]:
    """Files that depend, directly or through others, on the file of each requested node.

    Returns (found, omitted): found has distance, via (path of the file it was reached through), relationship, citation.
    """
    relations = cut_lineage(file_relationships(nodes, edges))
    homes = nodes.select("analysis_id", F.col("id").alias("node_id"), file_of(F.col("kind"), F.col("id"), F.col("file_id")).alias("node"))
    start = requests.join(homes, ["analysis_id", "node_id"]).where("node IS NOT NULL")
    links = relations.select("analysis_id", F.col("target_file").alias("node"), F.col("source_file").alias("neighbor"),
                             F.col("source_file").alias("k1"), F.col("edge_id").alias("k2"))
    seen, omitted = expand(start, links, depth, cap, nodes.select("analysis_id", F.col("id").alias("node")))
    labels = nodes.select("analysis_id", "id", "path", F.coalesce("path", "name").alias("label"))
    pair = relations.select("analysis_id", F.col("source_file").alias("node"), F.col("target_file").alias("via"), "edge_id",
                            F.col("kind").alias("relationship"), "file_id", "start_line", "end_line")
    found = (seen.where("distance > 0").drop("link").join(pair, ["analysis_id", "node", "via"])
             .join(labels.select("analysis_id", F.col("id").alias("node"), "path"), ["analysis_id", "node"])
             .join(labels.select("analysis_id", F.col("id").alias("via"), F.col("label").alias("via_path")), ["analysis_id", "via"]))
    found = with_citation(found, files)
    return found.select("request_id", "analysis_id", "node", "path", "distance", "via_path", "relationship", "citation"), omitted


def impact_tests(found: DataFrame) -> DataFrame:
    return found.where(paths.looks_like_test(F.coalesce("path", F.lit(""))))


def impact_routes(found: DataFrame, starts: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes whose file is impacted or selected. starts: request_id, analysis_id, path."""
    touched = found.select("request_id", "analysis_id", "path").unionByName(starts.select("request_id", "analysis_id", "path")).distinct()
    return routes.join(touched, ["analysis_id", "path"])


def dependency_facts(nodes: DataFrame, edges: DataFrame, files: DataFrame, requests: DataFrame, direction: str = "both",
                     cap: int = 30) -> DataFrame:
    """One sentence per direct relationship of the requested node, cited when its lines are known."""
    _, kept, _ = neighbors(nodes, edges, requests, direction, 1, cap)
    numbered = top_per_group(kept, ["request_id"], [F.col("ord"), F.col("id")], cap, "number")
    detail = edges.select("analysis_id", "id", "kind", "file_id", "start_line", "end_line", "type_only")
    label = nodes.select("analysis_id", F.col("id").alias("n"), F.coalesce("path", "name").alias("label"))
    rows = (numbered.join(detail, ["analysis_id", "id"])
            .join(label.select("analysis_id", F.col("n").alias("source"), F.col("label").alias("from")), ["analysis_id", "source"])
            .join(label.select("analysis_id", F.col("n").alias("target"), F.col("label").alias("to")), ["analysis_id", "target"]))
    cited = with_citation(rows, files, "id")
    sentence = F.concat("from", F.lit(" "), "kind", F.lit(" "), "to",
                        F.when(F.coalesce("type_only", F.lit(False)), " (type-only)").otherwise(""), F.lit("."))
    facts = cited.select("request_id", "number", sentence.alias("text"), F.lit("fact").alias("block_kind"),
                         F.when(F.col("citation").isNotNull(), F.concat(F.lit("G"), "number")).alias("citation"))
    names = requests.join(nodes.select("analysis_id", F.col("id").alias("node_id"), "name"), ["analysis_id", "node_id"])
    # Fixed text: the sentence users are shown.
    empty = names.join(facts.select("request_id").distinct(), "request_id", "left_anti").select(
        "request_id", F.lit(1).alias("number"),
        F.concat(F.lit(f"No resolved {direction} were found for "), "name",
                 F.lit(" in this static analysis. Dynamic or unresolved relationships may still exist.")).alias("text"),
        F.lit("unknown").alias("block_kind"), F.lit(None).cast("string").alias("citation"))
    return facts.unionByName(empty)


def dependency_warnings(nodes: DataFrame, edges: DataFrame, requests: DataFrame, direction: str = "both", cap: int = 30) -> DataFrame:
    """What ``dependency_facts`` leaves out under the same limit: request_id, omitted, warning; no row where nothing is missing."""
    _, _, omitted = neighbors(nodes, edges, requests, direction, 1, cap)
    # Fixed text: the sentence users are shown.
    text = F.concat(F.lit("Showing a bounded view; "), F.col("omitted").cast("string"), F.lit(" additional nodes omitted."))
    return omitted.where("omitted > 0").select("request_id", "omitted", text.alias("warning"))


def suggested_files(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Up to four files to start from: the three with most dependents, one entry point, then the next ones."""
    degree = (edges.where("kind IN ('imports', 'reexports')").groupBy("analysis_id", F.col("target").alias("id"))
              .agg(F.count("*").alias("dependents")))
    files = nodes.where("kind = 'file'").select("analysis_id", "id", "path", "name").join(degree, ["analysis_id", "id"], "left")
    files = files.withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    best = top_per_group(files, ["analysis_id"], [F.desc("dependents"), F.col("path"), F.col("name"), F.col("id")], 4, "place")
    entry = (files.join(entries.select("analysis_id", "path"), ["analysis_id", "path"], "left_semi")
             .groupBy("analysis_id").agg(F.min(F.struct("path", "name", "id", "dependents")).alias("e"))
             .select("analysis_id", "e.id", "e.path", "e.dependents", F.lit(3.5).alias("slot")))
    ranked = best.select("analysis_id", "id", "path", "dependents",
                         F.when((F.col("place") <= 3) & (F.col("dependents") > 0), F.col("place").cast("double"))
                         .otherwise(F.col("place") + 10.0).alias("slot"))
    merged = ranked.unionByName(entry).groupBy("analysis_id", "id", "path", "dependents").agg(F.min("slot").alias("slot"))
    return top_per_group(merged, ["analysis_id"], [F.col("slot")], 4, "place").drop("slot")


def walk_starts(nodes: DataFrame, entries: DataFrame, routes: DataFrame) -> DataFrame:
    """Entry-point files, then route files, each once; without any, the first eight files by path. At most thirty."""
    files = nodes.where("kind = 'file'").select("analysis_id", "path", "id")
    named = entries.select("analysis_id", "path", F.lit(0).alias("tier"), "ord").unionByName(
        routes.select("analysis_id", "path", F.lit(1).alias("tier"), "ord"))
    hits = files.join(named, ["analysis_id", "path"]).groupBy("analysis_id", "id").agg(F.min(F.struct("tier", "ord")).alias("at"))
    listed = top_per_group(hits, ["analysis_id"], [F.col("at"), F.col("id")], WALK_STARTS, "place").select("analysis_id", "id", "place")
    bare = files.join(hits.select("analysis_id").distinct(), "analysis_id", "left_anti")
    first = top_per_group(bare, ["analysis_id"], [F.col("path"), F.col("id")], 8, "place").select("analysis_id", "id", "place")
    return listed.unionByName(first)


def walk(nodes: DataFrame, edges: DataFrame, files: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Greedy walks through file relationships, all requests stepping together.

    From the current file go to the unvisited target that itself has targets, smallest path first; stop at a dead end or
    after eight files.  Returns (steps, branches): branches are the first twenty options at each step.
    """
    folded = cut_lineage(file_relationships(nodes, edges))
    relations = cut_lineage(folded.join(nodes.select("analysis_id", F.col("id").alias("target_file"), F.col("path").alias("target_path")), ["analysis_id", "target_file"]))
    release(folded)
    options = relations.withColumnRenamed("source_file", "node").withColumn("target_path", F.coalesce("target_path", F.lit("")))
    sources = relations.select("analysis_id", F.col("source_file").alias("target_file"))
    homes = nodes.select("analysis_id", F.col("id").alias("node_id"), file_of(F.col("kind"), F.col("id"), F.col("file_id")).alias("node"))
    none = F.lit(None).cast("string")
    current = cut_lineage(requests.join(homes, ["analysis_id", "node_id"]).where("node IS NOT NULL").select(
        "request_id", "analysis_id", "node", F.lit(1).alias("step"), none.alias("edge_id"), none.alias("kind"), none.alias("file_id"),
        F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line")))
    steps, branches = current, None
    for number in range(1, WALK_STEPS + 1):
        # The few options of a step go to the many relations, to find them and to tell which have targets; nothing is shuffled for them.
        reached = cut_lineage(current.select("request_id", "analysis_id", "node").join(options, ["analysis_id", "node"])
                              .join(steps.select("request_id", F.col("node").alias("target_file")), ["request_id", "target_file"], "left_anti"))
        busy = sources.join(reached.select("analysis_id", "target_file"), ["analysis_id", "target_file"], "left_semi").distinct()
        open_options = reached.join(cut_lineage(busy).withColumn("dead", F.lit(False)), ["analysis_id", "target_file"], "left").withColumn("dead", F.coalesce("dead", F.lit(True)))
        order = [F.col("dead"), F.col("target_path"), F.col("target_file")]
        best = cut_lineage(top_per_group(open_options, ["request_id"], order, WALK_BRANCHES, "choice"))
        seen = best.select("request_id", F.lit(number).alias("step"), "choice", F.col("target_file").alias("branch"))
        branches = seen if branches is None else branches.unionByName(seen)
        if number == WALK_STEPS:
            break
        current = best.where("choice = 1").select("request_id", "analysis_id", F.col("target_file").alias("node"),
                                                  F.lit(number + 1).alias("step"), "edge_id", "kind", "file_id", "start_line", "end_line")
        steps = steps.unionByName(current)
    cited = with_citation(steps, files)
    return cited.select("request_id", "step", "node", F.col("kind").alias("relationship"), "citation"), branches


def directory_listing(files: DataFrame) -> DataFrame:
    """Children of every directory: sub-directories with the number of files below them, then files.

    One row per child; ``place`` is not materialised, a page is a filter on (analysis_id, parent) and a sort.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i), "/").alias("parent"), F.element_at(parts, i + 1).alias("name"),
        (i < F.size(parts) - 1).alias("folder")))
    spread = files.select("analysis_id", "path", F.explode(above).alias("a")).select("analysis_id", "path", "a.*")
    folders = (spread.where("folder").groupBy("analysis_id", "parent", "name").agg(F.count("*").alias("child_count"))
               .select("analysis_id", "parent", "name", F.lit("directory").alias("kind"), "child_count"))
    leaves = spread.where(~F.col("folder")).select("analysis_id", "parent", "name", F.lit("file").alias("kind"),
                                                    F.lit(0).cast("long").alias("child_count"))
    return folders.unionByName(leaves)


def node_search(nodes: DataFrame, requests: DataFrame, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(page, totals) of file and symbol nodes whose name or path contains the query, exact names first.

    Queries of three letters or more meet nodes through a shared three-letter piece (an equality join) and are verified;
    shorter ones compare within their snapshot.  requests: request_id, analysis_id, query.
    """
    wanted = requests.withColumn("q", F.lower(F.trim("query")))
    pool = nodes.where("kind IN ('file', 'symbol')").select(
        "analysis_id", "id", "kind", "name", F.coalesce("path", F.lit("")).alias("path"))
    lowered = pool.withColumn("lname", F.lower("name")).withColumn("lpath", F.lower("path"))
    pieces = lowered.withColumn("gram", F.explode(F.array_distinct(F.concat(_trigrams(F.col("lname")), _trigrams(F.col("lpath"))))))
    long = wanted.where(F.length("q") >= 3).withColumn("gram", F.substring("q", 1, 3))
    by_piece = pieces.join(long, ["analysis_id", "gram"]).drop("gram")
    by_scan = lowered.join(wanted.where(F.length("q") < 3), "analysis_id")
    hits = by_piece.unionByName(by_scan).where(F.col("lname").contains(F.col("q")) | F.col("lpath").contains(F.col("q")))
    order = [F.col("lname") != F.col("q"), F.col("path"), F.col("name"), F.col("id")]
    page = top_per_group(hits, ["request_id"], order, offset + limit).where(F.col("rank") > offset)
    totals = hits.groupBy("request_id").agg(F.count("*").alias("total"))
    return page.select("request_id", "id", "kind", "name", "path", "rank"), totals


def _trigrams(value: Column) -> Column:
    return F.when(F.length(value) >= 3, F.transform(F.sequence(F.lit(1), F.length(value) - 2), lambda i: F.substring(value, i, F.lit(3)))
                  ).otherwise(F.array().cast("array<string>"))
