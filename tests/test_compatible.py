from __future__ import annotations

from itertools import product

import pytest
from pyspark.sql import functions as F

from graphloom.errors import QueryError
from graphloom.operators import compatible
from graphloom.plans.pattern import Solutions, TripleGraph, bgp

VALUES = (1, 2, None)


def frames(spark):
    left = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(product(VALUES, VALUES))], "i int, a int, b int")
    right = spark.createDataFrame([(a, b, f"{a}{b}") for a, b in ((1, 1), (1, None), (None, 2), (2, 2), (None, None), (1, 1))], "a int, b int, c string")
    return left, right


def agree(x, y):
    return x is None or y is None or x == y


def expected(left, right, how, disjoint=True):
    out = []
    for i, a, b in left:
        met = [
            (i, a if a is not None else x, b if b is not None else y, c)
            for x, y, c in right
            if agree(a, x) and agree(b, y) and (disjoint or None not in (a, x) or None not in (b, y))
        ]
        if how == "inner" or how == "left" and met:
            out += met
        elif how == "left":
            out.append((i, a, b, None))
        elif (how == "left_semi") == bool(met):
            out.append((i, a, b))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_compatible_joins_equal_all_pairs(spark, how):
    left, right = frames(spark)
    out = compatible.compatible_join(left, right, ["a", "b"], how, ["a", "b"], ["a", "b"])
    rows = [tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()]
    assert sorted(map(tuple, out.collect()), key=repr) == expected(*rows, how)
    apart = compatible.compatible_join(left, right, ["a", "b"], "left_anti", ["a", "b"], ["a", "b"], disjoint=False)
    assert sorted(map(tuple, apart.collect()), key=repr) == expected(*rows, "left_anti", disjoint=False)


def test_what_meets_everything_must_be_few(spark, monkeypatch):
    monkeypatch.setattr(compatible, "FREE_ROWS", 1)
    left, right = frames(spark)
    with pytest.raises(QueryError, match="bind none"):
        compatible.compatible_join(left, right.union(right), ["a", "b"], "inner", ["a", "b"], ["a", "b"])


def test_bound_variables_join_plainly(spark):
    g = TripleGraph(spark.createDataFrame([("x", "p", "1"), ("x", "q", "2"), ("y", "p", "3")], "s string, p string, o string"))
    out = bgp(g, ("?s", "p", "?a")).optional(bgp(g, ("?s", "q", "?b")))
    assert out.maybe == {"b"} and "Union" not in out.df._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.df.collect()} == {("x", "1", "2"), ("y", "3", None)}


def test_an_optional_variable_is_bound_by_a_later_part(spark):
    """?n comes from the first optional part where there is one, else from the second."""
    rows = [("x", "a", "T"), ("y", "a", "T"), ("z", "a", "T"), ("x", "nick", "xx"), ("x", "name", "x!"), ("y", "name", "y!"), ("x", "name", "xx")]
    g = TripleGraph(spark.createDataFrame(rows, "s string, p string, o string"))
    first = bgp(g, ("?s", "a", "T")).optional(bgp(g, ("?s", "nick", "?n")))
    out = first.optional(bgp(g, ("?s", "name", "?n")))
    assert {tuple(r) for r in out.project("s", "n").df.collect()} == {("x", "xx"), ("y", "y!"), ("z", None)}
    inner = first.join(bgp(g, ("?s", "name", "?n")))
    assert {tuple(r) for r in inner.project("s", "n").df.collect()} == {("x", "xx"), ("y", "y!")} and inner.maybe == frozenset()
    assert {r["s"] for r in first.not_exists(bgp(g, ("?s", "name", "?n"))).df.collect()} == {"z"}
    assert {r["s"] for r in first.exists(bgp(g, ("?s", "name", "?n"))).df.collect()} == {"x", "y"}


def test_minus_needs_a_bound_variable_in_common(spark):
    rows = [("x", "a", "T"), ("y", "a", "T"), ("x", "nick", "n"), ("q", "name", "n")]
    g = TripleGraph(spark.createDataFrame(rows, "s string, p string, o string"))
    some = bgp(g, ("?s", "a", "T")).optional(bgp(g, ("?s", "nick", "?n")))
    named = bgp(g, ("?q", "name", "?n"))
    assert {r["s"] for r in some.minus(named).df.collect()} == {"y"}  # y binds no ?n
    assert {r["s"] for r in some.not_exists(named).df.collect()} == set()  # y is compatible with every name


def test_union_branches_leave_variables_unbound(spark):
    one = Solutions(spark.createDataFrame([(1, "a")], "k int, x string"))
    two = Solutions(spark.createDataFrame([(2, "b")], "k int, y string"))
    both = one.union(two)
    assert both.maybe == {"x", "y"} and both.distinct().filter(F.lit(True)).limit(5).maybe == {"x", "y"}
    more = Solutions(spark.createDataFrame([(1, "z"), (2, "z")], "k int, x string"))
    assert {tuple(r) for r in both.join(more).project("k", "x", "y").df.collect()} == {(2, "z", "b")}
