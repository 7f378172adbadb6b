"""Triples as Turtle text: a writer of columns and a reader of files.

The reader takes whole files, one to a row, and cuts them into statements with a small scanner
inside an Arrow batch; everything else is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import DecodeError
from graphloom.functions.terms import PrefixMap, parse_name

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SCHEMA = "s string, p string, o string, o_kind string, o_type string, o_lang string, path string, error string"

_tokens = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<text>\"\"\".*?\"\"\"|'''.*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\d*\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))"""
    r"""|(?P<blank>_:[\w.-]*[\w-])|(?P<mark>[.;,\[\]()])|(?P<name>(?:[^\s<>"'();,\[\]#\\]|\\.)+)""",
    re.DOTALL,
)
_escapes = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    quote = 3 if text[:3] in ('"""', "'''") else 1
    body = text[quote:-quote]
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _escapes.get(m[1], m[1]), body, flags=re.DOTALL)


class _Scanner:
    """Statements of one text, as (s, p, o, kind, type, lang)."""

    def __init__(self, text: str, label: str) -> None:
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _tokens.match(text, at)
            if m is None:
                raise DecodeError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            kind, value, at = m.lastgroup or "", m[0], m.end()
            if kind == "name" and value.endswith(".") and not value.endswith("\\."):
                value, at = value[:-1], at - 1
            if kind != "space":
                self.items.append((kind, value))
        self.at, self.label, self.fresh = 0, label, 0
        self.prefixes: dict[str, str] = {}
        self.base: str | None = None
        self.out: list[tuple[str, str, str, str, str | None, str | None]] = []

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        item = self.peek()
        if item[0] == "end" or (mark is not None and item[1] != mark):
            raise DecodeError(f"expected {mark or 'a term'}, found {item[1] or 'the end'}")
        self.at += 1
        return item

    def run(self) -> list[tuple[str, str, str, str, str | None, str | None]]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            word = value.lstrip("@").lower()
            if word in ("prefix", "base") and kind in ("lang", "name"):
                self.take()
                if word == "prefix":
                    prefix = self.take()[1].removesuffix(":")
                    self.prefixes[prefix] = self.iri(self.take()[1])
                else:
                    self.base = self.iri(self.take()[1])
                if value.startswith("@"):
                    self.take(".")
                continue
            bracket = value == "["
            subject = self.term()[0]
            if not (bracket and self.peek()[1] == "."):
                self.properties(subject)
            self.take(".")
        return self.out

    def iri(self, text: str) -> str:
        return PrefixMap(self.prefixes, self.base).resolve_iri(text[1:-1])

    def new_blank(self) -> str:
        self.fresh += 1
        return f"_:{self.label}b{self.fresh}"

    def properties(self, subject: str) -> None:
        while True:
            p = RDF + "type" if self.peek() == ("name", "a") and self.take() else self.term()[0]
            while True:
                o, kind, dtype, lang = self.term()
                self.out.append((subject, p, o, kind, dtype, lang))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end":
                return

    def term(self) -> tuple[str, str, str | None, str | None]:
        kind, value = self.take()
        if kind == "iri":
            return self.iri(value), "iri", None, None
        if kind == "blank":
            return f"_:{self.label}{value[2:]}", "blank", None, None
        if kind == "number":
            t = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return value, "literal", XSD + t, None
        if kind == "text":
            following = self.peek()
            if following[0] == "lang":
                return _unescape(value), "literal", RDF + "langString", self.take()[1][1:].lower()
            if following[0] == "type":
                self.take()
                return _unescape(value), "literal", self.term()[0], None
            return _unescape(value), "literal", XSD + "string", None
        if kind == "name":
            if value in ("true", "false"):
                return value, "literal", XSD + "boolean", None
            found = PrefixMap(self.prefixes, self.base).resolve(parse_name(value))
            if found is None:
                raise DecodeError(f"unknown prefix in {value}")
            return found, "iri", None, None
        if value == "[":
            node = self.new_blank()
            if self.peek()[1] != "]":
                self.properties(node)
            self.take("]")
            return node, "blank", None, None
        if value == "(":
            cells: list[tuple[str, str, str | None, str | None]] = []
            while self.peek()[1] != ")":
                cells.append(self.term())
            self.take(")")
            nodes = [self.new_blank() for _ in cells]
            for node, item, rest in zip(nodes, cells, [*nodes[1:], RDF + "nil"], strict=False):
                self.out.append((node, RDF + "first", *item))
                self.out.append((node, RDF + "rest", rest, "iri" if rest == RDF + "nil" else "blank", None, None))
            return (nodes[0], "blank", None, None) if nodes else (RDF + "nil", "iri", None, None)
        raise DecodeError(f"unexpected {value!r}")


def scan_text(text: str, label: str = "") -> list[tuple[str, str, str, str, str | None, str | None]]:
    """The triples of one text; blank nodes are named under the label."""
    return _Scanner(text, label).run()


def read_turtle(spark: SparkSession, path: str, mode: str = "FAILFAST", pattern: str = "*.ttl") -> DataFrame:
    """s, p, o, o_kind, o_type, o_lang and path of the distinct triples of all files below path.

    FAILFAST raises at the first file with a fault; PERMISSIVE keeps the other files and gives the fault
    in a row with ``error``.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, where, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(*t, where, None) for t in scan_text(text or "", label)]
                except Exception as fault:
                    if mode == "FAILFAST":
                        raise DecodeError(f"{where}: {fault}") from fault
                    rows.append((None, None, None, None, None, None, where, str(fault)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["s", "p", "o", "o_kind", "o_type", "o_lang", "path", "error"])

    where = F.col("_metadata.file_path")
    out = files.select("value", where.alias("path"), F.concat(F.substring(F.md5(where), 1, 8), F.lit("_")).alias("label")).mapInArrow(scan, SCHEMA).distinct()
    return out.drop("error") if mode == "FAILFAST" else out


def _term(value: Column, kind: Column, dtype: Column, lang: Column, prefixes: PrefixMap | None) -> Column:
    text = value
    for bad, good in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(bad), F.lit(good))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))

    def short(iri: Column) -> Column:
        whole = F.concat(F.lit("<"), iri, F.lit(">"))
        if prefixes is None:
            return whole
        name = prefixes.compact_column(iri)
        return F.when(name.rlike(r"^[A-Za-z][\w-]*:[A-Za-z0-9_]+$"), name).otherwise(whole)

    typed = F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang)).when(
        dtype.isNotNull() & (dtype != XSD + "string"), F.concat(quoted, F.lit("^^"), short(dtype))
    )
    return F.when(kind == "literal", F.coalesce(typed, quoted)).when(kind == "blank", value).otherwise(short(value))


def format_triples(triples: DataFrame, prefixes: PrefixMap | None = None) -> DataFrame:
    """One line of Turtle for each triple; without o_kind an object is a node if it looks like an IRI or a blank."""
    have = set(triples.columns)
    none = F.lit(None).cast("string")
    guess = F.when(F.col("o").startswith("_:"), "blank").when(F.col("o").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"]*$"), "iri").otherwise("literal")
    kind = F.coalesce(F.col("o_kind"), guess) if "o_kind" in have else guess
    node = F.when(F.col("s").startswith("_:"), "blank").otherwise("iri")
    line = F.concat_ws(
        " ",
        _term(F.col("s"), node, none, none, prefixes),
        _term(F.col("p"), F.lit("iri"), none, none, prefixes),
        _term(F.col("o"), kind, F.col("o_type") if "o_type" in have else none, F.col("o_lang") if "o_lang" in have else none, prefixes),
        F.lit("."),
    )
    return triples.select(line.alias("value"))


def write_turtle(triples: DataFrame, path: str, prefixes: PrefixMap | None = None) -> None:
    """Files of Turtle under path; each file declares the prefixes, so it can be read alone."""
    lines = format_triples(triples, prefixes)
    if prefixes is not None:
        # the header is written to each file as its first lines: one row per partition, sorted before the rest
        part = lines.select(F.spark_partition_id().alias("part"), F.lit(1).alias("rank"), "value")
        head = lines.select(F.spark_partition_id().alias("part")).distinct().select("part", F.lit(0).alias("rank"), F.lit(prefixes.header()).alias("value"))
        lines = part.unionByName(head).repartition("part").sortWithinPartitions("part", "rank").select("value")
    lines.write.text(path)
