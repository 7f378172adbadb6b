"""Weighted averages of vectors and layered weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import ModelMismatch, NotEnough


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(value * weight) / sum(weight); null without weight."""
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def average_positions(df: DataFrame, keys: Sequence[str], vector: str, weight: Column | None = None) -> DataFrame:
    """keys, pos (from 0) and value: the weighted average of a vector column, position by position.

    Sums are combined before the shuffle, so what travels is one row per key, position and task.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    long = df.select(*keys, w.alias("_w"), F.posexplode(vector).alias("pos", "_v"))
    return long.groupBy(*keys, "pos").agg(weighted_mean(F.col("_v").cast("double"), F.col("_w")).alias("value"))


def average_vectors(df: DataFrame, keys: Sequence[str], vector: str, weight: Column | None = None) -> DataFrame:
    """keys and the averaged vector as an array of floats."""
    parts = average_positions(df, keys, vector, weight)
    pairs = F.array_sort(F.collect_list(F.struct("pos", "value")))
    out = parts.groupBy(*keys) if keys else parts.groupBy()
    return out.agg(F.transform(pairs, lambda p: p["value"].cast("float")).alias(vector))


def check_models(models: DataFrame, weights: str, keys: Sequence[str] = ()) -> None:
    """An error unless all models (a map of layers to arrays) have the same layers and lengths."""
    shape = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(weights, lambda k, v: F.size(v))))))
    shapes = models.groupBy(*keys).agg(F.countDistinct(shape).alias("n"), F.count(F.lit(1)).alias("models"))
    worst = shapes.agg(F.max("n").alias("n"), F.min("models").alias("models")).first()
    if not worst["models"]:
        raise NotEnough("weights", 0, 1)
    if worst["n"] > 1:
        raise ModelMismatch("models differ in layers or lengths")


def federated_average(models: DataFrame, weights: str, size: str, keys: Sequence[str] = (), check: bool = True) -> DataFrame:
    """keys, the averaged weights (a map of layers) and the total size of each group's models."""
    if check:
        check_models(models, weights, keys)
    long = models.select(*keys, F.col(size).cast("double").alias("_w"), F.explode(weights).alias("layer", "_v"))
    parts = average_positions(long, [*keys, "layer"], "_v", F.col("_w"))
    layers = parts.groupBy(*keys, "layer").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"].cast("float")).alias("values")
    )
    maps = layers.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "values")))).alias(weights))
    totals = models.groupBy(*keys).agg(F.sum(size).alias(size))
    # without keys both sides are one row
    return maps.join(totals, list(keys)) if keys else maps.crossJoin(F.broadcast(totals))
