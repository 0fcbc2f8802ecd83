"""Ranks over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def global_rank(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the rank, from 0, of each row by `order` (unique values).

    Rows are range partitioned and written once, so that their partitions are fixed; a row's rank is its number within its
    partition plus the rows of earlier ones, a sum over one row a partition."""
    ranged = materialize(df.repartitionByRange(order).withColumn("part_", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    before = counts.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    within = F.row_number().over(Window.partitionBy("part_").orderBy(order)) - 1
    return ranged.withColumn("within_", within).join(before, "part_").withColumn(name, F.col("base_") + F.col("within_")).drop("part_", "within_", "base_")


def grouped_rank(df: DataFrame, group: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds the rank, from 0, of each row within its group by `order` (unique within a group).

    Rows are dealt by ranges of (group, order), so that a hot group covers as many partitions as it has rows for, and written once. A row's
    rank is its number within its partition's part of the group plus the rows that earlier partitions have of it: a sum over a row for each group and
    partition that meet."""
    keys = [*group, *order]
    ranged = (df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)).withColumn("part_", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    counts = ranged.groupBy(*group, "part_").agg(F.count("*").alias("n_"))
    earlier = Window.partitionBy(*group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*group, "part_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("base_"))
    within = F.row_number().over(Window.partitionBy("part_", *group).orderBy(*order)) - 1
    # Groups may be null; the names of the counted side keep the join's sides apart.
    side = before.select(*[F.col(g).alias(f"{g}_of_") for g in group], F.col("part_").alias("part_of_"), "base_")
    same = F.col("part_") == F.col("part_of_")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"{g}_of_"))
    return ranged.withColumn("within_", within).join(side, same).select(*df.columns, (F.col("base_") + F.col("within_")).alias(name))


def neighbours(df: DataFrame, group: list[str], order: list[str], columns: list[str], name: str, ahead: bool = False, parts: int | None = None) -> DataFrame:
    """Adds, as a struct, `columns` of the row before (or with `ahead`, after) each in its group by `order` (unique within a group); null for the first.

    Rows are dealt by ranges of (group, order) and written once, so that a hot group covers many partitions. Each looks within its partition; those at its
    edge take the nearest row of the group in another partition, of which there is one for each group and partition that meet."""
    keys = [*group, *order]
    ranged = (df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)).withColumn("part_", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    row, at = F.struct(*columns), F.struct(*order)
    step = F.lead if ahead else F.lag
    ends = ranged.groupBy(*group, "part_").agg((F.min_by(row, at) if ahead else F.max_by(row, at)).alias("end_"))
    ends = ends.select(*[F.col(g).alias(f"{g}_of_") for g in group], F.col("part_").alias("part_of_"), step("end_").over(Window.partitionBy(*group).orderBy("part_")).alias("next_"))
    same = F.col("part_") == F.col("part_of_")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"{g}_of_"))
    w = Window.partitionBy("part_", *group).orderBy(*order)
    near = ranged.withColumn("near_", step(F.struct(row.alias("r"))).over(w))
    return near.join(ends, same).select(*df.columns, F.when(F.col("near_").isNull(), F.col("next_")).otherwise(F.col("near_.r")).alias(name))
