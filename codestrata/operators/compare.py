"""Differences between two snapshots of one repository. pairs: pair_id, base_id, current_id."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ranking import top_per_group
from ..session import cut_lineage

SHOWN_RELATIONSHIPS = 250
SHOWN_LINES = 1200


def same_repository(pairs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Pairs with an ``allowed`` flag: both snapshots known and of one repository."""
    base = analyses.select(F.col("analysis_id").alias("base_id"), F.col("repository_id").alias("base_repository"))
    current = analyses.select(F.col("analysis_id").alias("current_id"), F.col("repository_id").alias("current_repository"))
    joined = pairs.join(base, "base_id", "left").join(current, "current_id", "left")
    return joined.select(*pairs.columns, F.coalesce(F.col("base_repository") == F.col("current_repository"), F.lit(False)).alias("allowed"))


def _sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    before = table.select(F.col("analysis_id").alias("base_id"), *columns)
    after = table.select(F.col("analysis_id").alias("current_id"), *columns)
    return (pairs.select("pair_id", "base_id").join(before, "base_id").drop("base_id"),
            pairs.select("pair_id", "current_id").join(after, "current_id").drop("current_id"))


def file_changes(pairs: DataFrame, files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Added, removed and modified paths with line counts; files of equal content are dropped."""
    columns = ["path", "content_hash", "line_count", *(keep or [])]
    before, after = _sides(pairs, files, columns)
    b = before.select("pair_id", "path", *[F.col(c).alias(f"old_{c}") for c in columns[1:]])
    a = after.select("pair_id", "path", *[F.col(c).alias(f"new_{c}") for c in columns[1:]])
    joined = b.join(a, ["pair_id", "path"], "full_outer").where(~F.col("old_content_hash").eqNullSafe(F.col("new_content_hash")))
    status = (F.when(F.col("old_content_hash").isNull(), "added").when(F.col("new_content_hash").isNull(), "removed").otherwise("modified"))
    return joined.select("pair_id", "path", status.alias("status"), F.coalesce("old_line_count", F.lit(0)).cast("long").alias("before_lines"),
                         F.coalesce("new_line_count", F.lit(0)).cast("long").alias("after_lines"),
                         *[F.col(f"{side}_{c}") for c in (keep or []) for side in ("old", "new")])


def identity(prefix: str = "") -> list[Column]:
    """What a node is, apart from its id and lines, which may move between commits."""
    return [F.col("kind").alias(f"{prefix}kind"), F.coalesce("path", F.lit("")).alias(f"{prefix}path"),
            F.col("name").alias(f"{prefix}name"), F.coalesce("symbol_kind", F.lit("")).alias(f"{prefix}symbol_kind")]


def symbol_delta(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per pair, how many distinct symbols appeared and disappeared."""
    symbols = nodes.where("kind = 'symbol'").select("analysis_id", *identity())
    before, after = _sides(pairs, symbols, ["kind", "path", "name", "symbol_kind"])
    marked = before.withColumn("b", F.lit(1)).withColumn("a", F.lit(0)).unionByName(after.withColumn("b", F.lit(0)).withColumn("a", F.lit(1)))
    each = marked.groupBy("pair_id", "kind", "path", "name", "symbol_kind").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return each.groupBy("pair_id").agg(F.sum(((F.col("a") == 1) & (F.col("b") == 0)).cast("long")).alias("symbols_added"),
                                       F.sum(((F.col("a") == 0) & (F.col("b") == 1)).cast("long")).alias("symbols_removed"))


def relationship_delta(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, shown: int = SHOWN_RELATIONSHIPS
                       ) -> tuple[DataFrame, DataFrame]:
    """(listed, totals): appeared and disappeared relationships by identity of both ends and kind.

    Listed are the first ``shown`` of each side in identity order; totals count all and the omitted ones.
    """
    names = nodes.select("analysis_id", "id", F.struct(*identity()).alias("who"))
    known = (edges.where("kind <> 'contains'").select("analysis_id", "source", "target", F.col("kind").alias("relation"))
             .join(names.select("analysis_id", F.col("id").alias("source"), F.col("who").alias("from")), ["analysis_id", "source"])
             .join(names.select("analysis_id", F.col("id").alias("target"), F.col("who").alias("to")), ["analysis_id", "target"]))
    before, after = _sides(pairs, known, ["from", "to", "relation"])
    marked = before.withColumn("b", F.lit(1)).withColumn("a", F.lit(0)).unionByName(after.withColumn("b", F.lit(0)).withColumn("a", F.lit(1)))
    each = marked.groupBy("pair_id", "from", "to", "relation").agg(F.max("b").alias("b"), F.max("a").alias("a")).where("a <> b")
    changes = cut_lineage(each.select("pair_id", F.when(F.col("a") == 1, "added").otherwise("removed").alias("change"), "from", "to", "relation"))
    listed = top_per_group(changes, ["pair_id", "change"], [F.col("from"), F.col("to"), F.col("relation")], shown)
    label = lambda side: F.when(F.col(f"{side}.path") != "", F.col(f"{side}.path")).otherwise(F.col(f"{side}.name"))
    rows = listed.select("pair_id", "change", "rank", label("from").alias("source"), F.col("from.name").alias("source_name"),
                         label("to").alias("target"), F.col("to.name").alias("target_name"), F.col("relation").alias("kind"))
    added, removed = [F.sum((F.col("change") == c).cast("long")) for c in ("added", "removed")]
    totals = changes.groupBy("pair_id").agg(added.alias("added"), removed.alias("removed"))
    over = F.greatest(F.col("added") - shown, F.lit(0)) + F.greatest(F.col("removed") - shown, F.lit(0))
    return rows, totals.withColumn("omitted", over)


def line_delta(pairs: DataFrame, files: DataFrame, shown: int = SHOWN_LINES) -> tuple[DataFrame, DataFrame]:
    """(lines, totals) of changed files: lines present more often on one side, with their numbers.

    Occurrences of a line text are matched in order, so only surplus copies count as added or removed.
    """
    changed = file_changes(pairs, files, ["content", "redacted"])

    def side(column: str, label: str, mark: str) -> DataFrame:
        numbered = changed.select("pair_id", "path", F.posexplode(text.lines_with_ends(F.col(column))).alias("at", "line"))
        bare = numbered.select("pair_id", "path", (F.col("at") + 1).alias(label), F.regexp_replace("line", f"[{text.LINE_BREAKS}]+$", "").alias("line"))
        again = Window.partitionBy("pair_id", "path", "line").orderBy(label)
        return bare.withColumn("copy", F.row_number().over(again)).withColumn(mark, F.lit(True))

    old, new = side("old_content", "old_number", "was"), side("new_content", "new_number", "is")
    both = old.join(new, ["pair_id", "path", "line", "copy"], "full_outer")
    moved = both.where(F.col("was").isNull() | F.col("is").isNull()).select(
        "pair_id", "path", F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"),
        F.coalesce("new_number", "old_number").cast("long").alias("number"), "line")
    moved = cut_lineage(moved)
    kept = top_per_group(moved, ["pair_id", "path"], [F.col("number"), F.col("change"), F.col("line")], shown)
    flags = changed.select("pair_id", "path", (F.coalesce("old_redacted", F.lit(False)) | F.coalesce("new_redacted", F.lit(False))).alias("redacted"))
    totals = flags.join(moved.groupBy("pair_id", "path").agg(F.count("*").alias("lines")), ["pair_id", "path"], "left").select(
        "pair_id", "path", "redacted", F.coalesce("lines", F.lit(0)).alias("lines"),
        F.greatest(F.coalesce("lines", F.lit(0)) - shown, F.lit(0)).alias("omitted_lines"))
    return kept, totals


def changed_file_coverage(changes: DataFrame, indexed: DataFrame, snapshots: DataFrame, path_filter: str = "",
                          status_filter: str = "all") -> DataFrame:
    """How much of each change set the indexed snapshot can show.

    changes: change_id, analysis_id, head_sha, base_sha, filename, previous_filename, status.  indexed: analysis_id, path.
    snapshots: analysis_id, commit_sha.  A renamed file is looked up by its old name when the snapshot is the base.
    """
    at = changes.join(snapshots, "analysis_id", "left")
    revision = F.when(F.col("commit_sha") == F.col("head_sha"), "head").when(F.col("commit_sha") == F.col("base_sha"), "base").otherwise("none")
    at = at.withColumn("revision", revision)
    old_name = (F.col("revision") == "base") & (F.col("status") == "renamed")
    at = at.withColumn("path", F.when(old_name, F.coalesce("previous_filename", "filename")).otherwise(F.col("filename")))
    hit = at.join(indexed.select("analysis_id", "path").distinct().withColumn("present", F.lit(True)), ["analysis_id", "path"], "left")
    shown = F.lower("filename").contains(path_filter.strip().lower())
    if status_filter != "all":
        shown = shown & (F.col("status") == status_filter)
    return hit.groupBy("change_id", "revision").agg(
        F.count("*").alias("files"),
        F.sum((F.coalesce("present", F.lit(False)) & (F.col("revision") != "none")).cast("long")).alias("in_snapshot"),
        F.sum(shown.cast("long")).alias("visible"))


def paged_listing(records: DataFrame, owner: str, newest: str, key: str, page: int, per_page: int) -> DataFrame:
    """One page per owner, newest first, with whether another page follows."""
    upto = page * per_page
    ranked = top_per_group(records, [owner], [F.desc(newest), F.desc(key)], upto + 1)
    more = ranked.where(F.col("rank") > upto).select(owner, F.lit(True).alias("has_more"))
    return (ranked.where((F.col("rank") > upto - per_page) & (F.col("rank") <= upto)).join(more, owner, "left")
            .withColumn("has_more", F.coalesce("has_more", F.lit(False))))
