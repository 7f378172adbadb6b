"""Joins of solutions whose shared variables may be unbound.

Two solutions are compatible if every variable that both bind has one value in both.  Rows are split by which of
the doubtful variables they bind (their mask); each pair of masks is an equi-join on what both bind.  Variables
known to be bound need no mask, so with no doubtful ones this is the plain join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import QueryError

#: Rows that may meet every row of the other side, for want of a variable that both bind.
FREE_ROWS = 1000


def _masks(df: DataFrame, doubtful: Sequence[str]) -> Iterator[tuple[frozenset[str], DataFrame]]:
    """The unbound variables of each mask, and its rows."""
    for n in range(len(doubtful) + 1):
        for unbound in combinations(doubtful, n):
            held = df
            for v in doubtful:
                held = held.where(F.col(v).isNull() if v in unbound else F.col(v).isNotNull())
            yield frozenset(unbound), held


def _renamed(right: DataFrame, shared: Sequence[str]) -> DataFrame:
    return right.select(*[F.col(c).alias(f"_right_{c}") if c in shared else F.col(c) for c in right.columns])


def _condition(both: Sequence[str]) -> Column:
    out = F.lit(True)
    for v in both:
        out = out & (F.col(v) == F.col(f"_right_{v}"))
    return out


def _few(rows: DataFrame, shared: Sequence[str]) -> DataFrame:
    """rows that meet every row of the other side, which takes a proof that they are few."""
    if rows.limit(FREE_ROWS + 1).count() > FREE_ROWS:
        raise QueryError(f"more than {FREE_ROWS} solutions bind none of {list(shared)}")
    return F.broadcast(rows)


def compatible_join(
    left: DataFrame,
    right: DataFrame,
    shared: Sequence[str],
    how: str = "inner",
    left_doubt: Sequence[str] = (),
    right_doubt: Sequence[str] = (),
    disjoint: bool = True,
) -> DataFrame:
    """inner, left, left_semi or left_anti join of compatible rows; doubt names the shared variables a side may leave unbound.

    A variable that one side leaves unbound takes the other's value.  Rows of which nothing says what they
    share (all shared variables unbound on one side or the other) are compatible with every row; there may
    be ``FREE_ROWS`` of them on the right, else it is an error.  With disjoint false they are compatible with none.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no join {how}")
    lefts = list(_masks(left, [v for v in shared if v in left_doubt]))
    rights = [(m, _renamed(df, shared)) for m, df in _masks(right, [v for v in shared if v in right_doubt])]
    extra = [c for c in right.columns if c not in shared]
    merged = [F.coalesce(F.col(c), F.col(f"_right_{c}")).alias(c) if c in shared else F.col(c) for c in left.columns] + [F.col(c) for c in extra]
    parts: list[DataFrame] = []
    for left_unbound, rows in lefts:
        alone = rows
        for right_unbound, others in rights:
            both = [v for v in shared if v not in left_unbound | right_unbound]
            if not both and not disjoint:
                continue
            others = others if both else _few(others, shared)
            if how in ("inner", "left"):
                parts.append(rows.join(others, _condition(both)).select(*merged) if both else rows.crossJoin(others).select(*merged))
            if how == "left_semi":  # each row once: those that no earlier mask has taken
                parts.append(alone.join(others, _condition(both), "left_semi"))
            if how != "inner":
                alone = alone.join(others, _condition(both), "left_anti")
        if how == "left":
            kinds = {f.name: f.dataType for f in right.schema}
            parts.append(alone.select(*left.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in extra]))
        if how == "left_anti":
            parts.append(alone)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
