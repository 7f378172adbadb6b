"""Transitive closure of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.storage import table


def path_closure(edges: DataFrame, zero: bool = False) -> DataFrame:
    """s and o of every path in edges (s, o); with zero also each node to itself.

    Each round doubles the length that paths may have: the pairs that the last round found, which are
    the farthest, meet all known ones.  So there are about log2 of the longest path rounds, each a written
    table; cycles end them by finding nothing new.
    """
    first = table(edges.where("s is not null and o is not null").select("s", "o").distinct(), "closure")
    known, delta = first, first
    while True:
        hops = known.select(F.col("s").alias("m"), F.col("o").alias("t"))
        longer = delta.join(hops, F.col("o") == F.col("m")).select("s", F.col("t").alias("o")).distinct()
        delta = table(longer.join(known, ["s", "o"], "left_anti"), "closure")
        if delta.isEmpty():
            break
        known = known.unionByName(delta)
    if zero:
        nodes = first.select("s").unionByName(first.select(F.col("o").alias("s"))).distinct()
        known = known.unionByName(nodes.select("s", F.col("s").alias("o"))).distinct()
    return known
