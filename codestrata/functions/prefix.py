"""Prefix sums and ordinals over groups of any size.

A plain running window sends one group to one task. Here each group is cut into blocks of its order column, the block
totals (one small row per block) are accumulated, and rows are summed inside their block only.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, group: list[str], order: str, values: dict[str, Column],
                   width: int = 65536) -> DataFrame:
    """Add inclusive running sums of ``values`` by ``group`` along the unique integer column ``order``."""
    staged = df.withColumn("_block", F.floor(F.col(order) / width).cast("long"))
    for name, value in values.items():
        staged = staged.withColumn(f"_v_{name}", value)
    keys = [*group, "_block"]
    blocks = staged.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in values])
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*keys, *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_o_{n}")
                                     for n in values])
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for name in values:
        staged = staged.withColumn(f"_r_{name}", F.sum(f"_v_{name}").over(inside))
    joined = staged.join(offsets, keys)
    for name in values:
        joined = joined.withColumn(name, F.col(f"_r_{name}") + F.col(f"_o_{name}"))
    return joined.select(*df.columns, *values)


def dense_ordinal(df: DataFrame, group: list[str], order: str, name: str = "ordinal", width: int = 65536) -> DataFrame:
    """Add a gap-free 1-based position along ``order``."""
    return running_totals(df, group, order, {name: F.lit(1).cast("long")}, width)
