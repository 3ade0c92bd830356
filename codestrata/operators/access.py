"""Who sees which snapshot, and latest rows per owner."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_per_group


def repository_list(grants: DataFrame, analyses: DataFrame, max_grants: int | None = None) -> DataFrame:
    """Per user and repository: the snapshot to open, of all the user's grants or of the newest ``max_grants``. A usable one goes before a newer unfinished one; newest repositories first.

    grants: user_id, analysis_id, created_at.  analyses: analysis_id, repository_id, created_at, graph_ready.
    """
    seen = grants.select("user_id", "analysis_id").distinct()
    if max_grants is not None:
        seen = top_per_group(grants, ["user_id"], [F.desc("created_at"), F.desc("analysis_id")], max_grants, "_n").select("user_id", "analysis_id")
    rows = seen.join(analyses, "analysis_id")
    best = rows.groupBy("user_id", "repository_id").agg(F.max(F.struct("graph_ready", "created_at", "analysis_id")).alias("best"), F.max("created_at").alias("newest"))
    return best.select("user_id", "repository_id", F.col("best.analysis_id").alias("latest_analysis_id"), "newest")


def access(requests: DataFrame, analyses: DataFrame, grants: DataFrame, write: bool = False) -> DataFrame:
    """requests (user_id, analysis_id, …) with an ``allowed`` flag: demos are open for reading, the rest needs a grant."""
    granted = grants.select("user_id", "analysis_id").distinct().withColumn("_granted", F.lit(True))
    rows = requests.join(analyses.select("analysis_id", F.col("demo").alias("_demo")), "analysis_id", "left").join(granted, ["user_id", "analysis_id"], "left")
    held = F.coalesce("_granted", F.lit(False)) & ~F.coalesce("_demo", F.lit(True))
    open_to_all = F.lit(False) if write else F.coalesce("_demo", F.lit(False))
    return rows.withColumn("allowed", held | open_to_all).drop("_demo", "_granted")


def snapshot_list(requests: DataFrame, analyses: DataFrame, grants: DataFrame, limit: int | None = None) -> DataFrame:
    """Snapshots of the same repository the user may open, newest first. requests: request_id, user_id, analysis_id."""
    at = requests.join(analyses.select("analysis_id", "repository_id"), "analysis_id").select("request_id", "user_id", "repository_id")
    rows = access(at.join(analyses.select("repository_id", "analysis_id", "created_at"), "repository_id"), analyses, grants).where("allowed")
    return top_per_group(rows, ["request_id"], [F.desc("created_at"), F.desc("analysis_id")], limit, "place")


def latest_turns(turns: DataFrame, owner: list[str], order: list[str], read: int = 100, shown: int = 50) -> DataFrame:
    """The last turns of each owner, to be shown in ascending order (position counts up)."""
    newest = top_per_group(turns, owner, [F.desc(c) for c in order], min(read, shown), "_back")
    counts = newest.groupBy(*owner).agg(F.count("*").alias("_n"))
    return newest.join(counts, owner).withColumn("position", F.col("_n") - F.col("_back") + 1).drop("_n", "_back")


def saved_investigations(rows: DataFrame, owner: list[str], limit: int = 100) -> DataFrame:
    """Newest first, with a flag on owners that have reached the cap."""
    listed = top_per_group(rows, owner, [F.desc("created_at"), F.desc("id")], limit, "place")
    full = listed.where(F.col("place") == limit).select(*owner, F.lit(True).alias("at_limit"))
    return listed.join(full, owner, "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))
