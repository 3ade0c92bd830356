"""Top rows per group without sending a whole group to one task."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAP_SIDE_LIMIT = 1000  # up to this rank Spark keeps only the best rows of each group before the shuffle


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int | None, rank: str = "rank",
                  salts: int = 32) -> DataFrame:
    """The first ``k`` rows of each group in ``order`` (all rows for None), with their 1-based rank.

    Small ``k`` relies on the group-limit step Spark plans in front of the exchange. Larger ``k`` is first cut inside
    hash slices of the group, so the final window sees at most ``salts * k`` rows of a group.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    if k is None:
        return df.withColumn(rank, F.row_number().over(window))
    if k > MAP_SIDE_LIMIT:
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not _nested(df, c)]), F.lit(salts)))
        part = Window.partitionBy(*group, "_slice").orderBy(*order)
        df = sliced.withColumn("_part", F.row_number().over(part)).where(F.col("_part") <= k).drop("_slice", "_part")
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def _nested(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "array", "struct")
