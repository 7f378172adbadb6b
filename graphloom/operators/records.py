"""Typed records from graphs and back.

A ``RecordSpec`` compiles to one grouped aggregation over the triples of its class: each field is a
conditional minimum or set, so no field costs a join of its own.  Faulty subjects come out in an
error table and do not touch the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import DecodeError
from graphloom.plans.storage import small

#: Unsigned types and their largest value.
UNSIGNED = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}


@dataclass(frozen=True)
class Field:
    """One field: its predicate, type, and how often it may occur.

    many collects a set and passes over members of the wrong type; otherwise the least object is
    taken, a wrong type is an error, and so is absence unless there is a default or it is optional.
    """

    name: str
    predicate: str
    type: str = "string"
    many: bool = False
    optional: bool = False
    default: Any = None
    enum: Mapping[str, str] | None = None
    nested: RecordSpec | None = None
    length: int | None = None

    def cast(self, text: Column) -> Column:
        """text as the field's type; null where it is not."""
        if self.enum is not None:
            out = F.lit(None).cast("string")
            for iri, variant in self.enum.items():
                out = F.when(text == iri, variant).otherwise(out)
            return out
        if self.type in UNSIGNED:
            wide = text.try_cast("decimal(20,0)")
            target = "decimal(20,0)" if self.type == "uint64" else "bigint"
            return F.when(text.rlike(r"^\+?\d+$") & (wide <= F.lit(UNSIGNED[self.type]).cast("decimal(20,0)")), wide.cast(target))
        if self.type == "boolean":
            return F.when(text == "true", True).when(text == "false", False)
        if self.type == "timestamp":
            return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))
        if self.type == "address":
            return F.when(text.rlike(r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[[0-9A-Fa-f:]+\]):\d{1,5}$"), text)
        return text if self.type == "string" else text.try_cast(self.type)


@dataclass(frozen=True)
class RecordSpec:
    """A class of records: its name, the name of the subject's column, and its fields."""

    cls: str
    fields: Sequence[Field] = field(default_factory=tuple)
    subject: str = "subject"


def decode(triples: DataFrame, spec: RecordSpec, type_predicate: str = "a") -> tuple[DataFrame, DataFrame]:
    """(records, errors): one row per subject of the class, or per fault with subject, field and error."""
    members = triples.where((F.col("p") == type_predicate) & (F.col("o") == spec.cls)).select("s").distinct()
    wanted = [f.predicate for f in spec.fields]
    own = triples.where(F.col("p").isin([*wanted, type_predicate])).join(members, "s", "left_semi")
    plain = [f for f in spec.fields if f.nested is None]
    aggregates: list[Column] = []
    for f in spec.fields:
        of = F.when(F.col("p") == f.predicate, F.col("o"))
        if f.many:
            aggregates.append(F.array_sort(F.collect_set(F.when(F.col("p") == f.predicate, f.cast(F.col("o"))))).alias(f.name))
        else:
            aggregates.append(F.min(of).alias(f"_raw_{f.name}"))
    rows = own.groupBy(F.col("s").alias(spec.subject)).agg(*(aggregates or [F.count(F.lit(1)).alias("_n")]))
    faults: list[Column] = []
    values: list[Column] = [F.col(spec.subject)]
    for f in plain:
        if f.many:
            values.append(F.col(f.name))
            if f.length is not None:
                faults.append(F.when(F.size(f.name) != f.length, F.struct(F.lit(f.name).alias("field"), F.lit("wrong length").alias("error"))))
            continue
        raw = F.col(f"_raw_{f.name}")
        value = f.cast(raw)
        faults.append(F.when(raw.isNotNull() & value.isNull(), F.struct(F.lit(f.name).alias("field"), F.lit(f"not a {f.type}" if f.enum is None else "not a variant").alias("error"))))
        if f.default is not None:
            value = F.coalesce(value, F.lit(f.default))
        elif not f.optional:
            faults.append(F.when(raw.isNull(), F.struct(F.lit(f.name).alias("field"), F.lit("no matching object").alias("error"))))
        values.append(value.alias(f.name))
    for f in spec.fields:
        if f.nested is not None:
            inner, bad = decode(triples, f.nested, type_predicate)
            rest = [c for c in inner.columns if c != f.nested.subject]
            packed = inner.select(F.col(f.nested.subject).alias(f"_link_{f.name}"), F.struct(F.col(f.nested.subject), *rest).alias(f.name))
            rows = rows.join(packed, F.col(f"_raw_{f.name}") == F.col(f"_link_{f.name}"), "left")
            values.append(F.col(f.name))
            if not f.optional:
                faults.append(F.when(F.col(f.name).isNull(), F.struct(F.lit(f.name).alias("field"), F.lit("no matching object").alias("error"))))
    found = F.filter(F.array(*faults), lambda x: x.isNotNull()) if faults else F.array().cast("array<struct<field:string,error:string>>")
    judged = rows.select(*values, found.alias("_faults"))
    errors = judged.where(F.size("_faults") > 0).select(spec.subject, F.explode("_faults").alias("_e")).select(spec.subject, "_e.field", "_e.error")
    return judged.where(F.size("_faults") == 0).drop("_faults"), errors


def decode_all(triples: DataFrame, spec: RecordSpec) -> DataFrame:
    """The records; any fault is an error."""
    records, errors = decode(triples, spec)
    first = errors.orderBy(spec.subject, "field").first()
    if first is not None:
        raise DecodeError(f"{first[0]}: {first['field']}: {first['error']}")
    return records


def first_record(triples: DataFrame, spec: RecordSpec) -> DataFrame:
    """The record with the least subject that can be decoded."""
    records, _ = decode(triples, spec)
    return records.orderBy(spec.subject).limit(1)


def _said(predicate: str, objects: Column) -> Column:
    return F.transform(objects, lambda o: F.struct(F.lit(predicate).alias("p"), o.alias("o")))


def encode(records: DataFrame, spec: RecordSpec, type_predicate: str = "a") -> DataFrame:
    """The set of triples of the records: types, single values, and each member of a set."""
    pairs = [F.array(F.struct(F.lit(type_predicate).alias("p"), F.lit(spec.cls).alias("o")))]
    for f in spec.fields:
        if f.nested is not None:
            value = F.array(F.col(f"{f.name}.{f.nested.subject}").cast("string"))
        elif f.many:
            value = F.col(f.name).cast("array<string>")
        elif f.enum is not None:
            back = F.lit(None).cast("string")
            for iri, variant in f.enum.items():
                back = F.when(F.col(f.name) == variant, iri).otherwise(back)
            value = F.array(back)
        else:
            value = F.array(F.col(f.name).cast("string"))
        value = F.coalesce(value, F.array().cast("array<string>"))
        pairs.append(_said(f.predicate, value))
    out = records.select(F.col(spec.subject).cast("string").alias("s"), F.explode(F.flatten(F.array(*pairs))).alias("t"))
    return out.select("s", "t.p", "t.o").where("s is not null and o is not null").distinct()


def subject_hash(cls: str, *parts: Column) -> Column:
    """A subject's name from the class and what tells its records apart: the same record always has the same."""
    text = F.concat_ws("\x1f", F.lit(cls), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.concat(F.lit("_:"), F.substring(F.sha2(text, 256), 1, 32))


def decode_lists(cells: DataFrame, first: str = "first", rest: str = "rest", nil: str = "nil") -> DataFrame:
    """head and items of linked lists given as triples, whatever their length; lists may share their ends.

    Each round doubles the distance that a cell sees ahead, so there are about log2 of the longest
    list rounds.  A cell without a rest is dropped and ends its list; cells in a circle are an error.
    """
    from graphloom.plans.storage import table

    value = cells.where(F.col("p") == first).groupBy("s").agg(F.min("o").alias("item"))
    link = cells.where(F.col("p") == rest).groupBy("s").agg(F.min("o").alias("next"))
    cell = table(value.join(link, "s"), "list-cells")
    n = cell.count()
    jump = cell.where(F.col("next") != nil).join(cell.select(F.col("s").alias("next")), "next", "left_semi").select("s", "next")
    jumps: list[DataFrame] = []  # of 1, 2, 4, ... cells
    while True:
        jump = table(jump, "list-jumps")
        last = jump.agg(F.min("next")).first()[0]
        if last is None:
            break
        if 1 << len(jumps) >= n:  # so many cells ahead only a circle has one
            raise DecodeError(f"{last}: {rest}: the list runs in a circle")
        jumps.append(jump)
        jump = jump.join(jump.select(F.col("s").alias("next"), F.col("next").alias("_far")), "next").select("s", F.col("_far").alias("next"))
    heads = cell.join(link.select(F.col("next").alias("s")), "s", "left_anti")
    out = table(heads.select(F.col("s").alias("head"), F.lit(0).cast("long").alias("pos"), F.col("s").alias("at")), "list-places")
    for k, jump in enumerate(jumps):
        ahead = out.join(jump.select(F.col("s").alias("at"), "next"), "at").select("head", (F.col("pos") + (1 << k)).alias("pos"), F.col("next").alias("at"))
        out = out.unionByName(table(ahead, "list-places"))
    pairs = F.array_sort(F.collect_list(F.struct("pos", "item")))
    return out.join(cell.select(F.col("s").alias("at"), "item"), "at").groupBy("head").agg(F.transform(pairs, lambda p: p["item"]).alias("items"))


def decode_containers(triples: DataFrame, kinds: Sequence[str] = ("Seq", "Alt", "Bag"), kind: str | None = None, type_predicate: str = "a") -> DataFrame:
    """s, kind and items of containers with members _1, _2, ...; members after the first gap are left out."""
    wanted = [kind] if kind else list(kinds)
    typed = triples.where((F.col("p") == type_predicate) & F.col("o").isin(wanted)).groupBy("s").agg(F.min("o").alias("kind"))
    number = F.regexp_extract("p", r"^_([1-9]\d*)$", 1).try_cast("int")
    members = triples.select("s", number.alias("n"), "o").where("n is not null").groupBy("s", "n").agg(F.min("o").alias("o"))
    w = Window.partitionBy("s").orderBy("n")
    kept = members.join(typed, "s").withColumn("_r", F.row_number().over(w)).where("_r = n")
    items = kept.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "o"))), lambda x: x["o"]).alias("items"))
    return typed.join(items, "s", "left").select("s", "kind", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def lookup(triples: DataFrame, subjects: DataFrame, predicate: str, many: bool = False) -> DataFrame:
    """s and value (the least object, or the sorted set of all) of some subjects."""
    own = triples.where(F.col("p") == predicate).join(small(subjects.select("s").distinct()), "s", "left_semi")
    return own.groupBy("s").agg((F.array_sort(F.collect_set("o")) if many else F.min("o")).alias("value"))
