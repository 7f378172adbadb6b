"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import discard, join_per_key, measured_table, table


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the least node of its component) of every node in a link.

    Alternates large and small stars: each node hands its neighbours to the least node it
    knows, until only stars are left; the sum of all nodes' least neighbours falls with every round
    that changes anything, so the rounds end.  Each round is a written table, so lineage stays
    short, and a round's table goes when the next is there.  No node's neighbours are ever
    gathered: a hub's least neighbour is broadcast to its links (``join_per_key``).
    """
    u, v = F.col("u"), F.col("v")
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(u != v).distinct()
    print_of = {"n": F.count(F.lit(1)), "hashes": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    stars, now = measured_table(pairs, "components", **print_of)
    seen = None
    while now != seen and now["n"]:
        seen = now
        both = stars.unionByName(stars.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_per_key(both.where(v > u), least, "u", "n").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        large = table(large, "components-large")
        near = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        handed = join_per_key(large, near, "u", "n").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        nearest = large.groupBy("u").agg(F.min("v").alias("v"))
        found, now = measured_table(handed.unionByName(nearest).where(u != v).distinct(), "components", **print_of)
        discard(stars)
        discard(large)
        stars = found
    roots = stars.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return stars.select(u.alias("node"), v.alias("root")).unionByName(roots)
