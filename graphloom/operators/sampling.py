"""Seeded splits, shuffles and samples; all follow from hashes, so a retry draws the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalar import bucket, uniform
from graphloom.operators.ranking import ranked

#: Rows among which one task looks for the last that wins.
NARROW = 100_000
#: Rows of a group up to which Spark limits a ranking before its shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
PARTIAL = 1000


def split_ordered(df: DataFrame, group: Sequence[str], order: Sequence[str], fraction: float) -> DataFrame:
    """df with is_test: the last floor(n * fraction) rows of each group in order."""
    placed = ranked(df, group, order, "_r", "_n")
    return placed.withColumn("is_test", F.col("_r") > F.col("_n") - F.floor(F.col("_n") * F.lit(fraction))).drop("_r", "_n")


def shuffle_key(key: Column, seed: int = 42) -> Column:
    """A hash to order rows by."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split_hashed(df: DataFrame, key: str, group: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """df with is_test: the first floor(n * fraction) rows of each group in hash order."""
    placed = ranked(df, group, [shuffle_key(F.col(key), seed), F.col(key)], "_r", "_n")
    return placed.withColumn("is_test", F.col("_r") <= F.floor(F.col("_n") * F.lit(fraction))).drop("_r", "_n")


def weighted_sample(df: DataFrame, key: str, weight: str, fraction: float, least: int, seed: int = 42, group: Sequence[str] = ()) -> DataFrame:
    """max(floor(n * fraction), least) rows without replacement, with chances by weight; of each group, if there are groups.

    Each row draws an exponential number of rate weight from its hash, and the least numbers win;
    rows without a positive weight are never drawn.  Without groups the greatest number that wins is found first, in
    a band narrowed by quantiles until it has few rows, and then all rows up to it stay where they are; rows
    of one key and weight win together.
    """
    lot = -F.ln(uniform(seed, F.col(key))) / F.col(weight)
    if group:
        placed = ranked(df.withColumn("draw", F.when(F.col(weight) > 0, lot)), group, [F.asc_nulls_last("draw"), F.col(key)], "_r", "_n")
        most = F.greatest(F.floor(F.col("_n") * F.lit(fraction)), F.lit(least))
        return placed.where(F.col("draw").isNotNull() & (F.col("_r") <= most)).drop("_r", "_n")
    drawn = df.where(F.col(weight) > 0).withColumn("draw", lot)
    drawn = drawn.withColumn("_at", F.struct("draw", key))
    rows = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(weight) > 0).alias("m")).first()
    amount = max(int(rows["n"] * fraction), least)
    if rows["m"] <= amount:
        return drawn.drop("_at")
    band, before, size = drawn, 0, rows["m"]  # the last row that wins is in band, after so many others
    while size > NARROW:
        share = (amount - before) / size
        ends = band.agg(F.percentile_approx("draw", [max(0.0, share - 0.001), min(1.0, share + 0.001)], 10_000).alias("e")).first()["e"]
        inner = band.where(F.col("draw").between(*ends))
        seen = band.agg(F.count_if(F.col("draw") < ends[0]).alias("below"), F.count_if(F.col("draw").between(*ends)).alias("inside")).first()
        if not (seen["below"] < amount - before <= seen["below"] + seen["inside"]) or seen["inside"] >= size:
            break
        band, before, size = inner, before + seen["below"], seen["inside"]
    cut = band.select("_at").orderBy("_at").limit(amount - before).agg(F.max("_at").alias("_cut"))  # one row
    return drawn.join(F.broadcast(cut), F.col("_at") <= F.col("_cut")).drop("_at", "_cut")


def per_class_limit(df: DataFrame, cls: str, order: Sequence[str], total: int, n_classes: int | None = None) -> DataFrame:
    """The first total // n_classes rows of each class.

    Up to ``PARTIAL`` a class, Spark keeps that many of each partition before it shuffles; more are ranked by ranges.
    """
    k = total // (n_classes or df.select(cls).distinct().count() or 1)
    if k > PARTIAL:
        return ranked(df, [cls], order, "_r", "_n").where(F.col("_r") <= k).drop("_r", "_n")
    w = Window.partitionBy(cls).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def assign_nodes(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """df with by_node, one of n at random."""
    return df.withColumn("by_node", bucket(seed, F.col(key), n))
