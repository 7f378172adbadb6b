"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the output over its share of the documents.  A rate is
cut into equal parts of at most ``PART`` copies; for each part a document draws a uniform number
from a hash of the seed, its id, its text and the part, and inverts the Poisson distribution of
the part's rate.  Sums of independent Poisson numbers are Poisson numbers, so the copies of a
document follow its source's rate whatever its size, and a document of many parts is dealt out by
part before its copies are made.  Copies are then put into one global random order by a hash.

Rows that share id, text and source are numbered, and the number enters the hash: they draw
apart, so their copies keep the mean.  Which of such rows draws which number follows the input's
order; as far as the rows are equal that makes no difference.

Defined cases: a null source is a source of its own; weights default to equal shares; a source
without a weight gets no copies, so empty weights give no rows; weights of sources that do not
occur are left out of the shares; negative or infinite weights are errors; a null id or text is drawn as
such, by what else the row has; copies with equal order keys are ordered by id, text, number, part and copy; an empty
table gives no rows; long texts are hashed whole; other columns are carried unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import input_partitions, small, table
from graphloom.operators.ranking import ranked

SEED = 42
#: Values of the hash: 52 bits are exact in a double.
HASH_DIGITS = 13
#: Largest rate that one draw inverts; its distribution has fewer than 500 steps.
PART = 256.0
#: Sources up to which the rates are broadcast: a source's steps are fewer than 500 doubles, so 40 MB.
RATE_ROWS = 10_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... copies, far enough that the rest is below the hash's resolution.

    Each follows from the one before; rate is at most ``PART``, so the first does not vanish.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.exp(-rate)
    begin = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("steps"))

    def following(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.concat(a["steps"], F.array(a["sum"] + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), begin, following, lambda a: a["steps"])


def source_rates(docs: DataFrame, source: str = "source", weights: Mapping[str, float] | None = None) -> DataFrame:
    """source, n_docs, rate, parts and steps (of one part); all documents together keep their number in the mean."""
    if weights and not all(w >= 0 and math.isfinite(w) for w in weights.values()):
        raise ValueError("weights are finite and not negative")
    counts = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        pairs = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]).cast("map<string,double>")
        weighted = counts.withColumn("weight", F.coalesce(F.try_element_at(pairs, F.col("source")), F.lit(0.0)))
    totals = weighted.agg(F.sum("weight").alias("all_weights"), F.sum("n_docs").alias("all_docs"))
    rate = F.col("weight") / F.nullif(F.col("all_weights"), F.lit(0.0)) * F.col("all_docs") / F.col("n_docs")
    # one row of totals by construction
    rated = weighted.crossJoin(F.broadcast(totals)).select("source", "n_docs", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    parted = rated.select("*", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int").alias("parts"))
    return parted.select("*", F.when(F.col("rate") > 0, poisson_steps(F.col("rate") / F.col("parts"))).alias("steps"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with a number among those of one id, text and source; 0 for all others.

    Only short rows are counted to find what repeats.  The rows that do are written once, with a place,
    and numbered from that table by ranges, so no group is ever gathered and no second evaluation of the input has to agree with the first.
    """
    same = ["_id", "_text", "_own"]
    again = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = table(again.select(*[F.col(c).alias(f"{c}2") for c in same]), "mixing-repeated")
    if again.isEmpty():
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    again = small(again)
    held = F.lit(True)
    for c in same:
        held = held & F.col(c).eqNullSafe(F.col(f"{c}2"))
    repeated = table(rows.join(again, held, "left_semi").withColumn("_place", F.monotonically_increasing_id()), "mixing-equal-rows")
    numbered = ranked(repeated, same, ["_place"], tie=()).select(*rows.columns, (F.col("rank") - 1).alias("_nth"))
    return rows.join(again, held, "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("_nth")).unionByName(numbered)


def replicate(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: Mapping[str, float] | None = None, seed: int = SEED, text: str = "text"
) -> DataFrame:
    """row (all columns of docs), rate, nth (among equal rows), part, copy (within the part, from 0) and order_key of each copy, in the global order.

    The sources' table is broadcast up to a checked number of rows and otherwise joined by a shuffle.
    """
    n = input_partitions(docs)
    known = table(source_rates(docs, source, weights).where(F.col("steps").isNotNull()).withColumnRenamed("source", "_source"), "mixing-rates")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(doc_id).cast("string").alias("_id"),
        F.md5(F.col(text).cast("string").cast("binary")).alias("_text"),
        F.col(source).cast("string").alias("_own"),
    )
    rated = _numbered(rows).join(small(known, RATE_ROWS), F.col("_own").eqNullSafe(F.col("_source")))
    parted = rated.where("parts = 1").withColumn("_part", F.lit(0))
    if not known.where("parts > 1").isEmpty():
        many = rated.where("parts > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"))
        parted = parted.unionByName(many.repartition(n, "_text", "_nth", "_part"))
    own = [F.col("_id"), F.col("_text"), F.col("_nth"), F.col("_part")]
    n_copies = F.get(F.transform(F.array(uniform(seed, *own)), lambda u: F.size(F.filter("steps", lambda s: s <= u))), 0)
    drawn = parted.select("row", "rate", *own, n_copies.alias("n")).where(F.col("n") > 0)
    copies = drawn.select("row", "rate", *own, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    keyed = copies.select("*", uniform(seed, F.lit("order"), *own, F.col("copy")).alias("order_key"))
    # the keys are uniform, so ranges of equal width are even and need no sampling pass
    dealt = keyed.repartitionById(n, F.floor(F.col("order_key") * n).cast("int"))
    ordered = dealt.sortWithinPartitions("order_key", "_id", "_text", "_nth", "_part", "copy")
    return ordered.select("row", "rate", F.col("_nth").alias("nth"), F.col("_part").alias("part"), "copy", "order_key")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: Mapping[str, float] | None = None, seed: int = SEED, text: str = "text"
) -> DataFrame:
    """The copies with the columns of docs alone, in their global order: written as files, they stand in it."""
    return replicate(docs, doc_id, source, weights, seed, text).select("row.*")
