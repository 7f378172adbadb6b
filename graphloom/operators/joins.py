"""Joins that go beyond one equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import MissingContext, QueryError
from graphloom.plans.storage import small, table


def division(have: DataFrame, subject: str, item: str, required: Sequence | DataFrame) -> DataFrame:
    """The subjects that have every required item (all subjects, if none is required); required may be a table with item."""
    if isinstance(required, DataFrame):
        items = required.select(item).where(F.col(item).isNotNull()).distinct()
        n = items.count()
        kept = have.join(small(items), item, "left_semi")
    else:
        wanted = list(dict.fromkeys(required))
        n, kept = len(wanted), have.where(F.col(item).isin(wanted))
    if not n:
        return have.select(subject).distinct()
    return kept.groupBy(subject).agg(F.countDistinct(item).alias("_n")).where(F.col("_n") == n).select(subject)


def latest(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The rows with the greatest ``at`` of their keys; ties all stay.

    A grouped maximum, combined before the shuffle, meets the rows; no key's rows are sorted.
    """
    last = df.groupBy(*keys).agg(F.max(at).alias(at))
    return df.join(last, [*keys, at], "left_semi")


def latest_one(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key, the last in order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def key_join(features: DataFrame, targets: DataFrame, keys: Sequence[str], dedupe: str | None = None) -> DataFrame:
    """A training dataset: features with the target of the same keys, one row per match.

    dedupe="min" keeps the least target of each key.  Without keys there is nothing to join on.
    """
    if not keys:
        raise QueryError("a dataset needs at least one key attribute")
    if dedupe == "min":
        rest = [c for c in targets.columns if c not in keys]
        targets = targets.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_t")).select(*keys, "_t.*")
    return features.join(targets, list(keys))


def unmatched(features: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A prediction dataset: features without a target; without keys any target takes all."""
    if not keys:
        return features if targets.isEmpty() else features.limit(0)
    return features.join(targets.select(*keys), list(keys), "left_anti")


def require(df: DataFrame, found: str, key: str) -> DataFrame:
    """df, if found is bound in every row; else an error that names some of the keys without."""
    missing = [r[0] for r in df.where(F.col(found).isNull()).select(key).limit(5).collect()]
    if missing:
        raise MissingContext(f"no {found} for {key} {missing}")
    return df


#: Centers among a center's own cell, on average, from which nearest begins with narrower cells.
CELL_SITES = 4


def _narrow(sites: DataFrame, names: Sequence[str], width: float, least: float) -> float:
    """width, quartered while a center shares its cell with more than CELL_SITES on average; sites are distinct positions."""
    while width / 4 >= least:
        held = sites.groupBy(*[F.floor(F.col(c) / width) for c in names]).agg(F.count(F.lit(1)).alias("n"))
        r = held.agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("m")).first()
        if r["m"] <= CELL_SITES:
            break
        width /= 4
    return width


def nearest(points: DataFrame, point_id: str, at: Sequence[str], centers: DataFrame, center_id: str, center_at: Sequence[str]) -> DataFrame:
    """point_id, center_id and distance2 of each point's nearest center (least id among equals).

    Equal positions are one: of centers the least id stands for all, and points meet centers once a position.
    Both sides are laid on a grid and meet in the cells around a point.  A center found within one
    cell's width is the nearest; the other points go on with cells of four times the width, until
    all are settled.  The first width follows the centers' density, so that a cell holds few of them however many
    there are.  No pair outside of neighbouring cells is ever formed.
    """
    dims = range(len(at))
    xs, ys = [f"_x{i}" for i in dims], [f"_y{i}" for i in dims]
    every = centers.select(F.col(center_id).alias("_c"), *[F.col(c).cast("double").alias(y) for c, y in zip(center_at, ys, strict=True)]).dropna()
    sites = table(every.groupBy(*ys).agg(F.min("_c").alias("_c")), "nearest-sites")
    asked = points.select(F.col(point_id).alias("_p"), *[F.col(c).cast("double").alias(x) for c, x in zip(at, xs, strict=True)]).dropna()
    left = table(asked.select(*xs).distinct(), "nearest-points")
    ends = sites.agg(F.count(F.lit(1)).alias("n"), *[f(f"_y{i}").alias(f"{f.__name__}{i}") for i in dims for f in (F.min, F.max)]).first()
    if not ends["n"]:
        return asked.select(F.col("_p").alias(point_id), F.lit(None).cast(dict(centers.dtypes)[center_id]).alias(center_id), F.lit(None).cast("double").alias("distance2"))
    far = left.agg(*[F.max(F.abs(F.col(f"_x{i}"))).alias(f"m{i}") for i in dims]).first()
    span = max([ends[f"max{i}"] - ends[f"min{i}"] for i in dims] + [0.0])
    reach = max([abs(v) for i in dims for v in (ends[f"max{i}"], ends[f"min{i}"], far[f"m{i}"] or 0.0)] + [1e-9])
    width = max(2 * span / max(1.0, ends["n"] ** (1 / len(at))), reach * 1e-6)
    width = _narrow(sites, ys, width, reach * 1e-6)
    settled = None
    while True:
        last = width > 4 * reach  # one cell and its neighbours hold everything
        cells = [F.floor(F.col(x) / width).alias(f"_g{i}") for i, x in enumerate(xs)]
        around = left.select("*", *cells)
        for i in dims:
            around = around.withColumn(f"_g{i}", F.explode(F.sequence(F.col(f"_g{i}") - 1, F.col(f"_g{i}") + 1)))
        placed = sites.select("*", *[F.floor(F.col(y) / width).alias(f"_g{i}") for i, y in enumerate(ys)])
        distance = sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(xs, ys, strict=True)), F.lit(0.0))
        best = around.join(small(placed), [f"_g{i}" for i in dims]).groupBy(*xs).agg(F.min(F.struct(distance.alias("d"), F.col("_c").alias("c"))).alias("b"))
        found = table(best.where(F.lit(last) | (F.col("b.d") <= width * width)).select(*xs, F.col("b.c").alias("_c"), F.col("b.d").alias("_d")), "nearest-found")
        settled = found if settled is None else settled.unionByName(found)
        if last:
            break
        left = table(left.join(found.select(*xs), xs, "left_anti"), "nearest-points")
        if left.isEmpty():
            break
        width *= 4
    met = asked.join(settled, xs).groupBy("_p").agg(F.min(F.struct("_d", "_c")).alias("b"))
    return table(met.select(F.col("_p").alias(point_id), F.col("b._c").alias(center_id), F.col("b._d").alias("distance2")), "nearest")


def convert_units(df: DataFrame, value: str, unit: str, to: str, units: DataFrame) -> DataFrame:
    """df with ``converted``: value in the unit ``to``; null where the units have no common root.

    units holds unit, reference_unit and factor, and a unit without a reference is a root.  Each round
    doubles the hops that factors are followed over, up to the roots; units in a circle are an error.
    The unit table is broadcast after a count of its rows.
    """
    up = F.col("reference_unit")
    own = units.select(
        F.col("unit").alias("_u"), F.coalesce(up, "unit").alias("_root"), F.when(up.isNotNull(), F.col("factor").cast("double")).otherwise(1.0).alias("_f")
    )
    own = table(own, "units")
    onward = own.where("_root <> _u").select(F.col("_u").alias("_root"))
    rounds, n = 0, own.count()
    while not own.join(onward, "_root", "left_semi").isEmpty():
        if 1 << rounds > n:  # so many hops only a circle has
            raise QueryError("units refer to each other in a circle")
        step = own.select(F.col("_u").alias("_root"), F.col("_root").alias("_up"), F.col("_f").alias("_g"))
        far = own.join(step, "_root", "left")
        own = table(far.select("_u", F.coalesce("_up", "_root").alias("_root"), (F.col("_f") * F.coalesce("_g", F.lit(1.0))).alias("_f")), "units")
        rounds += 1
    roots, target = small(own), small(own.where(F.col("_u") == to).select("_root", F.col("_f").alias("_tf")))
    joined = df.join(roots, df[unit] == F.col("_u"), "left").join(target, "_root", "left")
    return joined.select(*[df[c] for c in df.columns], (F.col(value) * F.col("_f") / F.col("_tf")).alias("converted"))


def bounded(value: Column, limit: float | None) -> Column:
    """value <= limit, or true where no limit is set."""
    return F.lit(True) if limit is None else value <= limit
