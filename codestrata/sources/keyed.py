"""Keyed writes over immutable tables: each returns the table after the write."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins: one row per key, the one with the highest ``order``. Aggregates before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep existing rows; add the first incoming row of each key that is not there yet."""
    rest = [c for c in incoming.columns if c not in keys]
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    added = first.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in incoming.columns])
    return existing.unionByName(added, allowMissingColumns=True)


def conditional_update(table: DataFrame, expected: DataFrame, keys: list[str], compare: list[str],
                       changes: dict[str, Column]) -> DataFrame:
    """Compare-and-set: rows whose ``compare`` columns still hold the expected values take the changes.

    ``expected`` has one row per key. The result has a ``matched`` flag; its sum is the update count.
    """
    wanted = expected.select(*keys, *[F.col(c).alias(f"_expected_{c}") for c in compare], F.lit(True).alias("_asked"))
    joined = table.join(wanted, keys, "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_expected_{c}")) for c in compare])
    matched = F.coalesce(F.col("_asked"), F.lit(False)) & same
    return joined.withColumn("matched", matched).select(
        *[F.when(F.col("matched"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
          for c in table.columns], "matched")


def delete_keys(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(doomed.select(*keys), keys, "left_anti")


def delete_repository(tables: dict[str, DataFrame], analyses: DataFrame, doomed: DataFrame) -> dict[str, DataFrame]:
    """Cascade: tables scoped by snapshot lose the snapshots of the doomed repositories, then the snapshots go."""
    gone = analyses.join(doomed.select("repository_id"), "repository_id", "left_semi").select("analysis_id")
    left = {name: delete_keys(table, gone, ["analysis_id"]) for name, table in tables.items()}
    left["analyses"] = delete_keys(analyses, doomed, ["repository_id"])
    return left


def find(table: DataFrame, equals: dict | None = None, any_of: dict | None = None, unequal: dict | None = None,
         drop: list[str] | None = None, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Filter by equality, membership and inequality; the filters and the column list reach the scan. All rows without a limit."""
    for name, value in (equals or {}).items():
        table = table.where(F.col(name) == F.lit(value))
    for name, values in (any_of or {}).items():
        table = table.where(F.col(name).isin(list(values)))
    for name, value in (unequal or {}).items():
        table = table.where(~F.col(name).eqNullSafe(F.lit(value)))
    table = table.drop(*(drop or []))
    table = table.orderBy(*order) if order else table
    return table if limit is None else table.limit(limit)


def overwrite_snapshots(table: DataFrame, path: str) -> None:
    """Idempotent sink: replace only the snapshot partitions present in the batch."""
    (table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(path))
