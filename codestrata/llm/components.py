"""Connected components of a table of links, by joins and minima only."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node with a link. links: a, b (long).

    Alternates two steps until nothing changes: every node hands the smallest node it knows to its larger neighbours, then
    to its smaller ones. Each step is a minimum per node (summed before the shuffle) and a join; the number of rounds grows
    with the logarithm of the longest chain.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        told = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if told == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = told
