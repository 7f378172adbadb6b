"""Classes derived from several others, and from classes that are derived themselves.

The classes and their derivations form a graph that is followed in topological order.  Every source of a class
gives rows of (keys, inputs), with nulls for the inputs of other sources; all rows are put
together and aggregated by key once, so the sources align in one shuffle with partial sums before it, and none is
joined.  An average is carried as sum and count, so a class above it averages the underlying records.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import QueryError
from graphloom.operators.derive import Attribute, Derivation, Schema, call_of, compile_expression, union_all
from graphloom.plans.storage import table

_SUM, _COUNT = "_sum_{}", "_count_{}"


@dataclass
class DerivationGraph:
    """A schema, the tables of its given classes, and derivations of properties that hold for every class.

    A property's derivation binds properties of the same class (no domain).  It stands in wherever
    a class has no attribute of that name.
    """

    schema: Schema
    tables: Mapping[str, DataFrame]
    properties: Mapping[str, Derivation] = field(default_factory=dict)

    def order(self, name: str) -> list[str]:
        """The derived classes that a class needs, sources first, itself last; a circle is an error."""
        done: list[str] = []
        path: list[str] = []

        def visit(c: str) -> None:
            if c in self.tables or c in done:
                return
            if c in path:
                raise QueryError(f"{' -> '.join([*path[path.index(c) :], c])} derive from each other")
            if c not in self.schema.classes:
                raise QueryError(f"no class {c} and no table of it")
            path.append(c)
            for source in self.schema.depends_on(c):
                visit(source)
            path.pop()
            done.append(c)

        visit(name)
        return done

    def depends_on(self, name: str) -> list[str]:
        """All classes with records that a class rests on, directly or through others."""
        own = self.order(name)
        return sorted({d for c in own for d in self.schema.depends_on(c)})

    def derive(self, name: str) -> DataFrame:
        """The records of a class.

        Keys say which records there are: those of the class that the keys derive from, or of all sources if they name none.
        A source without rows of a key gives null, and a count of 0; a null key is a key.
        """
        order = self.order(name)
        readers = [s for c in order for s in self.schema.depends_on(c)]
        frames: dict[str, DataFrame] = dict(self.tables)
        for c in order:
            frame = self._records(c, frames)
            frames[c] = table(frame, "derived") if readers.count(c) > 1 else frame
        return frames[name].select(*[a.name for a in self.schema.attributes(name)])

    def value_of(self, prop: str, frame: DataFrame, seen: tuple[str, ...] = ()) -> Column:
        """A property on a class's records: its column, or what its derivation makes of other columns."""
        if prop in frame.columns:
            return F.col(f"`{prop}`")
        if prop not in self.properties or prop in seen:
            raise QueryError(f"{prop} is neither an attribute nor derived")
        d = self.properties[prop]
        columns = {b.name: self.value_of(b.attribute, frame, (*seen, prop)) for b in d.bindings}
        value, aggregates = compile_expression(d.expression or d.bindings[0].name, columns)
        if aggregates:
            raise QueryError(f"{prop} of one record cannot aggregate")
        return value

    def _source(self, a: Attribute) -> str | None:
        """The class an attribute derives from, if it names one."""
        domains = {b.domain for b in a.derived.bindings if b.domain}
        if len(domains) > 1:
            raise QueryError(f"{a.name} binds several classes: {sorted(domains)}")
        return next(iter(domains), None)

    def _inputs(self, a: Attribute, frame: DataFrame) -> dict[str, Column]:
        return {b.name: self.value_of(b.attribute, frame) for b in a.derived.bindings}

    def _records(self, name: str, frames: Mapping[str, DataFrame]) -> DataFrame:
        attributes = self.schema.attributes(name)
        for a in attributes:
            if a.derived is None:
                raise QueryError(f"{a.name} of {name} has no derivation")
        keys, rest = [a for a in attributes if a.key], [a for a in attributes if not a.key]
        anchors = {self._source(a) for a in keys} - {None}
        if len(anchors) > 1:
            raise QueryError(f"the keys of {name} derive from several classes: {sorted(anchors)}")
        anchor = next(iter(anchors), None)
        sources = sorted({self._source(a) or anchor for a in rest} | anchors - {None}, key=str)
        if not sources or None in sources:
            raise QueryError(f"{name} names no class to derive from")
        calls = {a.name: call_of(a.derived.expression or a.derived.bindings[0].name) for a in rest}
        if not any(calls.values()):
            if len(sources) > 1:
                raise QueryError(f"{name} takes single records of several classes")
            frame = frames[sources[0]]
            return frame.select(*[compile_expression(a.derived.expression or a.derived.bindings[0].name, self._inputs(a, frame))[0].alias(a.name) for a in attributes])
        if not all(calls.values()):
            raise QueryError(f"{[n for n, c in calls.items() if not c]} of {name} do not aggregate, others do")
        parts = []
        for source in sources:
            frame = frames[source]
            columns = [compile_expression(k.derived.expression or k.derived.bindings[0].name, self._inputs(k, frame))[0].alias(k.name) for k in keys]
            for a in rest:
                if (self._source(a) or anchor) == source:
                    columns += self._measured(a, calls[a.name], frame)
            parts.append(frame.select(*columns, F.lit(source == anchor or anchor is None).alias("_here")))
        grouped = union_all(parts).groupBy(*[k.name for k in keys])
        merged = grouped.agg(F.max("_here").alias("_here"), *[c for a in rest for c in self._merged(a, calls[a.name])]).where("_here")
        averages = [
            F.when(F.col(_COUNT.format(a.name)) > 0, F.col(_SUM.format(a.name)) / F.col(_COUNT.format(a.name))).alias(a.name) for a in rest if calls[a.name][0] == "AVG"
        ]
        return merged.select("*", *averages).drop("_here")

    def _measured(self, a: Attribute, call: tuple[str, str], frame: DataFrame) -> list[Column]:
        """What a record adds to an attribute: sum and count of an average, the value of others."""
        columns = self._inputs(a, frame)
        if call[1] not in columns:
            raise QueryError(f"no binding for {call[1]}")
        value = columns[call[1]]
        if call[0] != "AVG":
            return [value.alias(a.name)]
        of = next(b.attribute for b in a.derived.bindings if b.name == call[1])
        if _SUM.format(of) in frame.columns:  # itself an average: on with its sum and count
            return [F.col(_SUM.format(of)).alias(_SUM.format(a.name)), F.col(_COUNT.format(of)).alias(_COUNT.format(a.name))]
        return [value.cast("double").alias(_SUM.format(a.name)), F.when(value.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias(_COUNT.format(a.name))]

    def _merged(self, a: Attribute, call: tuple[str, str]) -> list[Column]:
        if call[0] == "AVG":
            return [F.sum(_SUM.format(a.name)).alias(_SUM.format(a.name)), F.coalesce(F.sum(_COUNT.format(a.name)), F.lit(0)).alias(_COUNT.format(a.name))]
        return [compile_expression(f"{call[0]}(?v)", {"v": F.col(a.name)})[0].alias(a.name)]
