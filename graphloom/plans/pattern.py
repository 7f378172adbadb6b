"""Graph patterns over DataFrames.

A graph answers triple patterns; ``bgp`` compiles a list of them to joins, and ``Solutions`` adds
the rest of the algebra.  Solutions are bags with one column per variable, unbound is null.
Two graphs are provided: a triples table, and tables mapped column by column.  In a mapped graph
all patterns on one subject variable and one table become a single projection, so a star costs no
join and the scan reads its columns only; subjects and links keep their native type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import QueryError
from graphloom.operators.closure import path_closure
from graphloom.operators.compatible import compatible_join
from graphloom.plans.storage import small

TYPE = "a"


def is_var(term: Any) -> bool:
    return isinstance(term, str) and term.startswith("?")


def var(term: str) -> str:
    return term[1:]


@dataclass(frozen=True)
class Pattern:
    """A triple pattern; each place is a ``?variable`` or a constant."""

    s: Any
    p: Any
    o: Any

    def variables(self) -> set[str]:
        return {var(t) for t in (self.s, self.p, self.o) if is_var(t)}


@dataclass(frozen=True)
class Solutions:
    """A bag of solutions and the algebra on them.

    maybe names the variables that some solutions may leave unbound: those of optional parts, of one branch of a
    union, of expressions.  Where such variables are shared, solutions meet if they are compatible.
    """

    df: DataFrame
    maybe: frozenset[str] = frozenset()

    @property
    def variables(self) -> list[str]:
        return self.df.columns

    def _shared(self, other: Solutions) -> list[str]:
        shared = [v for v in self.variables if v in other.variables]
        if not shared:
            raise QueryError(f"no shared variable between {self.variables} and {other.variables}")
        return shared

    def _meet(self, other: Solutions, how: str, disjoint: bool = True) -> DataFrame:
        on = self._shared(other)
        right = other.df.select(*on) if how in ("left_semi", "left_anti") else other.df
        if not set(on) & (self.maybe | other.maybe):
            return self.df.join(right, on, how)
        return compatible_join(self.df, right, on, how, [v for v in on if v in self.maybe], [v for v in on if v in other.maybe], disjoint)

    def join(self, other: Solutions) -> Solutions:
        both = set(self.variables) & set(other.variables)
        maybe = {v for v in self.maybe | other.maybe if v not in both or v in self.maybe & other.maybe}
        return Solutions(self._meet(other, "inner"), frozenset(maybe))

    def optional(self, other: Solutions) -> Solutions:
        """Left join of compatible solutions; what only the optional part binds may be unbound."""
        return Solutions(self._meet(other, "left"), self.maybe | (set(other.variables) - set(self.variables)))

    def union(self, other: Solutions) -> Solutions:
        one = set(self.variables) ^ set(other.variables)
        return Solutions(self.df.unionByName(other.df, allowMissingColumns=True), self.maybe | other.maybe | one)

    def exists(self, other: Solutions) -> Solutions:
        return Solutions(self._meet(other, "left_semi"), self.maybe)

    def not_exists(self, other: Solutions) -> Solutions:
        return Solutions(self._meet(other, "left_anti"), self.maybe)

    def minus(self, other: Solutions) -> Solutions:
        """As not_exists, but solutions that bind no variable in common take nothing away."""
        on = [v for v in self.variables if v in other.variables]
        return Solutions(self._meet(other, "left_anti", disjoint=False), self.maybe) if on else self

    def filter(self, condition: Column | str) -> Solutions:
        return Solutions(self.df.where(condition), self.maybe)

    def bind(self, name: str, value: Column | str) -> Solutions:
        """name as an expression, or as the value of another variable."""
        if name in self.variables:
            raise QueryError(f"{name} is bound already")
        if isinstance(value, str):
            return Solutions(self.df.withColumn(name, F.col(value)), self.maybe | ({name} if value in self.maybe else set()))
        df = self.df.withColumn(name, value)
        return Solutions(df, self.maybe | ({name} if df.schema[name].nullable else set()))

    def values(self, name: str, values: Sequence[Any]) -> Solutions:
        """Keeps the solutions whose variable has one of the values (a list given in the query)."""
        return Solutions(self.df.where(F.col(name).isin(list(values))), self.maybe - {name})

    def project(self, *columns: str | Column) -> Solutions:
        df = self.df.select(*columns)
        return Solutions(df, frozenset(c for c in df.columns if c in self.maybe or (c not in self.variables and df.schema[c].nullable)))

    def distinct(self) -> Solutions:
        return Solutions(self.df.distinct(), self.maybe)

    def group(self, keys: Sequence[str], **aggregates: Column) -> Solutions:
        df = self.df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
        return Solutions(df, (self.maybe & set(keys)) | {n for n in aggregates if df.schema[n].nullable})

    def order(self, *columns: str | Column) -> Solutions:
        return Solutions(self.df.orderBy(*columns), self.maybe)

    def limit(self, n: int, offset: int = 0) -> Solutions:
        return Solutions((self.df.offset(offset) if offset else self.df).limit(n), self.maybe)

    def ask(self) -> bool:
        return not self.df.isEmpty()

    def construct(self, template: Sequence[tuple[Any, Any, Any]], distinct: bool = True) -> DataFrame:
        """The set (or with distinct off the bag) of triples s, p, o of the template; those with an unbound part are left out.

        ``?name`` is a variable, ``_:name`` a node that is fresh for each solution but the same
        within it and on every run, since it is named by a hash of the solution; columns are expressions.
        """
        own = F.sha2(F.to_json(F.struct(*[F.col(c) for c in self.variables]), {"ignoreNullFields": "false"}), 256)

        def term(t: Any) -> Column:
            if isinstance(t, Column):
                return t.cast("string")
            if is_var(t):
                return F.col(var(t)).cast("string")
            if isinstance(t, str) and t.startswith("_:"):
                return F.concat(F.lit(t), F.substring(own, 1, 32))
            return F.lit(str(t))

        triples = F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template])
        out = self.df.select(F.explode(triples).alias("t")).select("t.s", "t.p", "t.o")
        out = out.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull())
        return out.distinct() if distinct else out

    def rows(self, cls: Callable[..., Any]) -> Iterable[Any]:
        """The solutions as objects, by name; unbound variables are left out.  For small results."""
        for row in self.df.toLocalIterator():
            yield cls(**{k: v for k, v in row.asDict().items() if v is not None})

    def to_json(self) -> DataFrame:
        """One JSON text a solution, in the column ``value``; unbound variables are left out."""
        return self.df.select(F.to_json(F.struct(*self.variables)).alias("value"))

    @staticmethod
    def from_json(lines: DataFrame, schema: str) -> Solutions:
        """The solutions that to_json wrote, with variables and types by schema."""
        return Solutions(lines.select(F.from_json("value", schema).alias("v")).select("v.*"))

    def tuples(self) -> Iterable[tuple[Any, ...]]:
        """The solutions by position; an unbound variable is an error.  For small results."""
        for row in self.df.toLocalIterator():
            if any(v is None for v in row):
                raise QueryError(f"missing tuple element in {row}")
            yield tuple(row)


class TripleGraph:
    """A graph held as a table of s, p, o."""

    def __init__(self, triples: DataFrame) -> None:
        self.triples = triples

    def star(self, patterns: Sequence[Pattern]) -> Solutions:
        """The solutions of patterns with one subject, one scan each."""
        return reduce(Solutions.join, [self.scan(p) for p in patterns])

    def scan(self, pattern: Pattern) -> Solutions:
        df = self.triples.select("s", "p", "o")
        out: dict[str, str] = {}
        for place, term in zip("spo", (pattern.s, pattern.p, pattern.o), strict=True):
            if not is_var(term):
                df = df.where(F.col(place) == F.lit(term))
            elif var(term) in out:
                df = df.where(F.col(place) == F.col(out[var(term)]))
            else:
                out[var(term)] = place
        return Solutions(df.select(*[F.col(c).alias(v) for v, c in out.items()]))

    def edges(self, predicate: Any) -> DataFrame:
        return self.triples.where(F.col("p") == predicate).select("s", "o")


@dataclass(frozen=True)
class Mapped:
    """A table as a class: its name, its frame, the subject's expression, and the names of its predicates.

    links names the predicates whose values are subjects and the space they belong to; space is that of the
    table's own subjects, by default its name.
    """

    name: str
    df: DataFrame
    subject: Column
    predicates: Mapping[str, Column] = field(default_factory=dict)
    links: Mapping[str, str] = field(default_factory=dict)
    space: str | None = None

    @property
    def subjects(self) -> str:
        return self.space or self.name

    def iri(self) -> Column:
        return F.concat(F.lit(self.subjects + "/"), self.subject.cast("string"))

    def object_text(self, predicate: str) -> Column:
        text = self.predicates[predicate].cast("string")
        return F.concat(F.lit(self.links[predicate] + "/"), text) if predicate in self.links else text


class MappedGraph:
    """A graph whose classes are tables and whose predicates are columns."""

    def __init__(self, tables: Iterable[Mapped]) -> None:
        self.tables = {t.name: t for t in tables}
        self.owner = {p: t for t in self.tables.values() for p in t.predicates}

    def _table(self, pattern: Pattern) -> Mapped:
        if is_var(pattern.p):
            raise QueryError("a mapped graph takes a variable predicate in triples() alone")
        if pattern.p == TYPE:
            if pattern.o not in self.tables:
                raise QueryError(f"no class {pattern.o}")
            return self.tables[pattern.o]
        if pattern.p not in self.owner:
            raise QueryError(f"no predicate {pattern.p}")
        return self.owner[pattern.p]

    def star(self, patterns: Sequence[Pattern]) -> Solutions:
        """The solutions of patterns with one subject: one projection for each table."""
        by_table: dict[str, list[Pattern]] = {}
        for p in patterns:
            by_table.setdefault(self._table(p).name, []).append(p)
        return reduce(Solutions.join, [self._project(self.tables[n], own) for n, own in by_table.items()])

    def _project(self, table: Mapped, patterns: Sequence[Pattern]) -> Solutions:
        columns: dict[str, Column] = {}
        conditions: list[Column] = []

        def place(term: Any, value: Column) -> None:
            if not is_var(term):
                conditions.append(value == F.lit(term))
            elif var(term) in columns:
                conditions.append(value == columns[var(term)])
            else:
                columns[var(term)] = value
                conditions.append(value.isNotNull())

        place(patterns[0].s, table.subject)
        for p in patterns:
            if p.p != TYPE:
                place(p.o, table.predicates[p.p])
        df = table.df.where(reduce(lambda a, b: a & b, conditions))
        return Solutions(df.select(*[c.alias(v) for v, c in columns.items()]))

    def scan(self, pattern: Pattern) -> Solutions:
        return self.star([pattern])

    def check_spaces(self, patterns: Sequence[Pattern]) -> None:
        """An error if a variable would have to be a subject of two spaces: their native keys are not comparable."""
        found: dict[str, str] = {}
        for p in patterns:
            t = self._table(p)
            spaces = [(p.s, t.subjects)] + ([(p.o, t.links[p.p])] if p.p in t.links else [])
            for term, space in spaces:
                if is_var(term) and found.setdefault(term, space) != space:
                    raise QueryError(f"{term} cannot be of {found[term]} and of {space}")

    def edges(self, predicate: str) -> DataFrame:
        """s and o as text, named with their spaces, so that paths do not mix keys of different tables."""
        t = self.owner[predicate]
        return t.df.select(t.iri().alias("s"), t.object_text(predicate).alias("o")).where("s is not null and o is not null")

    def triples(self, *names: str, predicates: Sequence[str] | None = None) -> DataFrame:
        """s, p, o as text of the named classes (all, if none is named); one pass over each table.

        With predicates only their columns are read.
        """
        parts = []

        def wanted(p: str) -> bool:
            return predicates is None or p in predicates

        for t in (self.tables[n] for n in (names or self.tables)):
            pairs = [F.struct(F.lit(TYPE).alias("p"), F.lit(t.name).alias("o"))] if wanted(TYPE) else []
            pairs += [F.struct(F.lit(p).alias("p"), t.object_text(p).alias("o")) for p in t.predicates if wanted(p)]
            if not pairs:
                continue
            parts.append(t.df.select(t.iri().alias("s"), F.explode(F.array(*pairs)).alias("t")).select("s", "t.p", "t.o").where("o is not null"))
        if not parts:
            raise QueryError(f"no triples of {predicates}")
        return reduce(DataFrame.unionByName, parts)


Graph = TripleGraph | MappedGraph


def bgp(graph: Graph, *patterns: tuple[Any, Any, Any]) -> Solutions:
    """The solutions of all patterns together.

    Patterns on one subject are answered together; stars are then joined along shared variables, each
    next one connected to those before, so no cross product arises.
    """
    stars: dict[Any, list[Pattern]] = {}
    for p in patterns:
        stars.setdefault(p[0], []).append(Pattern(*p))
    if isinstance(graph, MappedGraph):
        graph.check_spaces([p for own in stars.values() for p in own])
    todo = [graph.star(own) for own in stars.values()]
    out = todo.pop(0)
    while todo:
        k = next((i for i, s in enumerate(todo) if set(s.variables) & set(out.variables)), None)
        if k is None:
            raise QueryError("the patterns are not connected")
        out = out.join(todo.pop(k))
    return out


def values(spark: SparkSession, name: str, items: Sequence[Any], kind: str) -> Solutions:
    """A table written into the query."""
    return Solutions(spark.createDataFrame([(i,) for i in items], f"`{name}` {kind}"))


def construct_all(*parts: tuple[Solutions, Sequence[tuple[Any, Any, Any]]]) -> DataFrame:
    """The set of triples that solutions and their templates give together."""
    return reduce(DataFrame.unionByName, [found.construct(template, distinct=False) for found, template in parts]).distinct()


def semi_join(left: Solutions, right: Solutions) -> Solutions:
    """left's solutions that agree with one of right, which is broadcast if it is small."""
    on = left._shared(right)
    return Solutions(left.df.join(small(right.df.select(*on).distinct()), on, "left_semi"))


def path(graph: Graph, s: str, steps: Sequence[Any], o: str, zero: bool = False) -> Solutions:
    """(p1/p2/...)+ between two variables, or ()* with zero."""
    hops = [graph.edges(p) for p in steps]
    step = reduce(lambda a, b: a.select("s", F.col("o").alias("m")).join(b.select(F.col("s").alias("m"), "o"), "m").select("s", "o"), hops)
    return Solutions(path_closure(step, zero).select(F.col("s").alias(var(s)), F.col("o").alias(var(o))))
