"""Ranks in groups of any size: no group is ever sorted in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.storage import small, table


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], rank: str = "rank", rows: str = "group_rows", tie: Sequence[str] | None = None) -> DataFrame:
    """df with rank (1, 2, ... within its group, in order) and rows (how many its group has).

    Rows are dealt into ranges of (group, order), sorted there, and written with their range and place, so no task
    holds more than a range.  A row's rank is its place less that of its group's first row in the range,
    and the rows of the group in the ranges before.  Rows that tie are put in order by a hash of the columns in
    tie, by default all; rows equal in these take their ranks among each other at random.  Null groups are a group.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.withColumn("_rank_tie", F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in (df.columns if tie is None else tie)]))
    by = [*[F.col(c) for c in group], *ordered, "_rank_tie"]
    placed = keyed.repartitionByRange(n, *by).sortWithinPartitions(*by)
    placed = table(placed.withColumn("_rank_range", F.spark_partition_id()).withColumn("_rank_place", F.monotonically_increasing_id()), "ranges")
    counts = placed.groupBy(*group, "_rank_range").agg(F.count(F.lit(1)).alias("_rank_n"), F.min("_rank_place").alias("_rank_first"))
    before = Window.partitionBy(*group).orderBy("_rank_range").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.select(
        *[F.col(c).alias(f"_rank_g{i}") for i, c in enumerate(group)],
        F.col("_rank_range").alias("_rank_own"),
        (F.coalesce(F.sum("_rank_n").over(before), F.lit(0)) - F.col("_rank_first") + 1).alias("_rank_shift"),
        F.sum("_rank_n").over(Window.partitionBy(*group)).alias(rows),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_rank_g{i}")) for i, c in enumerate(group)]
    met = placed.join(small(begun), reduce(lambda a, b: a & b, same, F.col("_rank_range") == F.col("_rank_own")))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_rank_place") + F.col("_rank_shift")).alias(rank), rows)
