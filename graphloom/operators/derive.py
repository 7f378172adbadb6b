"""Context classes and attributes derived from others."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.errors import QueryError
from graphloom.functions.scalar import timeslot

PUBLIC, PRIVATE = "Public", "Private"


@dataclass(frozen=True)
class Binding:
    """A source of a derivation: an attribute of a class, under the label or the attribute's own name."""

    attribute: str
    domain: str | None = None
    label: str | None = None

    @property
    def name(self) -> str:
        return self.label or re.split(r"[#/:]", self.attribute)[-1]


@dataclass(frozen=True)
class Derivation:
    """Bindings and an expression over their names; without an expression the one binding is copied."""

    bindings: Sequence[Binding]
    expression: str | None = None


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str = "string"
    key: bool = False
    unit: str | None = None
    derived: Derivation | None = None


@dataclass(frozen=True)
class ContextClass:
    name: str
    attributes: Sequence[Attribute] = field(default_factory=tuple)
    visibility: str = PRIVATE
    parents: Sequence[str] = ()

    @property
    def public(self) -> bool:
        return self.visibility == PUBLIC

    @property
    def keys(self) -> list[str]:
        return [a.name for a in self.attributes if a.key]


class Schema:
    """Context classes by name."""

    def __init__(self, classes: Sequence[ContextClass]) -> None:
        self.classes = {c.name: c for c in classes}

    def attributes(self, name: str) -> list[Attribute]:
        """A class's attributes and those of all classes above it; its own come first and win by name."""
        found: dict[str, Attribute] = {}
        seen: set[str] = set()
        todo = [name]
        while todo:
            c = self.classes[todo.pop(0)]
            if c.name in seen:
                continue
            seen.add(c.name)
            for a in c.attributes:
                found.setdefault(a.name, a)
            todo += c.parents
        return list(found.values())

    def struct(self, name: str) -> T.StructType:
        """The Spark type of a class's records, with key, unit and derivation in the fields' metadata."""
        fields = []
        for a in self.attributes(name):
            about = {"key": a.key, "derived": a.derived is not None} | ({"unit": a.unit} if a.unit else {})
            fields.append(T.StructField(a.name, T.StructType.fromDDL(f"x {a.type}")["x"].dataType, not a.key, about))
        return T.StructType(fields)

    def depends_on(self, name: str) -> list[str]:
        """The classes that a class's derivations read."""
        out = {b.domain for a in self.attributes(name) if a.derived for b in a.derived.bindings if b.domain}
        return sorted(out)


#: Aggregates an expression may call; TIMESLOT takes a unit and a name.
AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
_call = re.compile(r"\s*([A-Z]+)\s*\(\s*(?:'(\w+)'\s*,\s*)?\??(\w+)\s*\)\s*")
_name = re.compile(r"\s*\??([A-Za-z_]\w*)\s*")


def call_of(text: str) -> tuple[str, str] | None:
    """(aggregate, name) of an expression that aggregates, else None."""
    call = _call.fullmatch(text)
    return (call[1], call[3]) if call and call[1] in AGGREGATES and call[2] is None else None


def compile_expression(text: str, columns: Mapping[str, Column]) -> tuple[Column, bool]:
    """(column, whether it aggregates) of ``AVG(?x)``, ``TIMESLOT('HOUR', ?t)`` or ``?x``."""
    call = _call.fullmatch(text)
    if call:
        name, unit, of = call.groups()
        if of not in columns:
            raise QueryError(f"no binding for {of}")
        if name == "TIMESLOT":
            return timeslot(unit or "HOUR", columns[of]), False
        if name in AGGREGATES and unit is None:
            return AGGREGATES[name](columns[of]), True
    plain = _name.fullmatch(text)
    if plain and plain[1] in columns:
        return columns[plain[1]], False
    raise QueryError(f"cannot derive {text!r}")


def derive(schema: Schema, name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The records of a class whose attributes are derived from one other class; ``derivation`` has those of several.

    Key attributes group the source's records when any attribute aggregates.
    """
    attributes = schema.attributes(name)
    domains = schema.depends_on(name)
    if len(domains) != 1:
        raise QueryError(f"{name} must derive from one class, not {domains}")
    source = tables[domains[0]]
    keys: list[Column] = []
    rest: list[Column] = []
    grouped = False
    for a in attributes:
        if a.derived is None:
            raise QueryError(f"{a.name} of {name} has no derivation")
        columns = {b.name: F.col(b.attribute) for b in a.derived.bindings}
        value, aggregates = compile_expression(a.derived.expression or a.derived.bindings[0].name, columns)
        grouped |= aggregates
        (rest if aggregates or not a.key else keys).append(value.alias(a.name))
    order = [a.name for a in attributes]
    out = source.groupBy(*keys).agg(*rest) if grouped else source.select(*keys, *rest)
    return out.select(*order)


def inherited_rows(closure: DataFrame, attributes: DataFrame) -> DataFrame:
    """cls and attribute of each class and everything above it, from closure (s below o) and own attributes (cls, attribute)."""
    above = closure.select(F.col("s").alias("_c"), F.col("o").alias("cls")).join(attributes, "cls").select(F.col("_c").alias("cls"), "attribute")
    return attributes.select("cls", "attribute").unionByName(above).distinct()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
