"""Bounded breadth-first expansion for a table of start nodes at once."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_per_group
from ..session import cut_lineage


def present(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose (analysis_id, node) is in ``known``. The nodes asked for go to the many known ones, not the other way."""
    asked = rows.select("analysis_id", "node").distinct()
    return rows.join(known.select("analysis_id", "node").join(asked, ["analysis_id", "node"], "left_semi"), ["analysis_id", "node"], "left_semi")


def expand(requests: DataFrame, links: DataFrame, depth: int, cap: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Level-by-level expansion, in the order a queue would visit, with at most ``cap`` nodes per request.

    requests: request_id, analysis_id, node.  links: analysis_id, node, neighbor, k1, k2 (k1, k2 order the links of a
    node; k2 identifies the link).  Returns (visited, omitted): visited has request_id, analysis_id, node, distance,
    position, via, link; omitted counts, per request, the distinct nodes met when the cap was already full.
    With ``known`` (analysis_id, node) only its nodes are visited or counted; just the few that a level meets are looked up.
    """
    start = requests.select("request_id", "analysis_id", "node").distinct()
    seen = cut_lineage(start.select("request_id", "analysis_id", "node", F.lit(0).alias("distance"),
                                    F.lit(0).alias("position"), F.lit(None).cast("string").alias("via"),
                                    F.lit(None).cast("string").alias("link")))
    frontier, met = seen, []
    for distance in range(1, depth + 1):
        step = frontier.select("request_id", "analysis_id", F.col("node").alias("via"), F.col("position").alias("p"))
        reached = step.join(links.withColumnRenamed("node", "via"), ["analysis_id", "via"])
        fresh = reached.withColumnRenamed("neighbor", "node").join(seen.select("request_id", "node"),
                                                                   ["request_id", "node"], "left_anti")
        first = cut_lineage(fresh.groupBy("request_id", "analysis_id", "node")
                            .agg(F.min(F.struct("p", "k1", "k2", "via")).alias("best")))
        if known is not None:
            first = cut_lineage(present(first, known))
        room = seen.groupBy("request_id").agg((F.lit(cap) - F.count("*")).alias("room"))
        ranked = top_per_group(first, ["request_id"], [F.col("best")], cap, "position")
        admitted = cut_lineage(ranked.join(room, "request_id").where(F.col("position") <= F.col("room")).select(
            "request_id", "analysis_id", "node", F.lit(distance).alias("distance"), "position",
            F.col("best.via").alias("via"), F.col("best.k2").alias("link")))
        met.append(first.select("request_id", "node"))
        seen = seen.unionByName(admitted)
        frontier = admitted
    everything = reduce(DataFrame.unionByName, met).distinct()
    omitted = (everything.join(seen.select("request_id", "node"), ["request_id", "node"], "left_anti")
               .groupBy("request_id").agg(F.count("*").alias("omitted")))
    return seen, omitted
