"""Prefixed names and IRIs: parsing, formatting, resolution and compaction.

Parsing works on single names on the driver; everything that touches columns is a Spark expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.errors import NameError_

# Fixed values of the grammar of local names.
_local_char = r"(?:[^\W]|[:·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])"
_local = re.compile(rf"(?:{_local_char}(?:(?:{_local_char}|\.)*{_local_char})?)?")
_prefix = re.compile(r"(?:[^\W\d_](?:[\w.·-]*[\w·-])?)?")
_iri_bad = re.compile(r"[\x00-\x20<>\"{}|^`\\]")


@dataclass(frozen=True)
class Name:
    """A prefixed name, or a whole IRI where prefix is None."""

    prefix: str | None
    local: str

    @property
    def is_iri(self) -> bool:
        return self.prefix is None


def parse_name(text: str) -> Name:
    """``<iri>``, ``prefix:local``, ``:local`` or ``prefix:``; escapes in the local part are resolved."""
    if text.startswith("<"):
        if not text.endswith(">"):
            raise NameError_(f"an IRI has no end: {text!r}")
        if _iri_bad.search(text[1:-1]):
            raise NameError_(f"an IRI holds a character it may not: {text!r}")
        return Name(None, text[1:-1])
    head, colon, tail = text.partition(":")
    if not colon:
        raise NameError_(f"a name has no colon: {text!r}")
    if not _prefix.fullmatch(head):
        raise NameError_(f"not a prefix: {head!r}")
    if not _local.fullmatch(tail):
        raise NameError_(f"not a local name: {tail!r}")
    return Name(head, re.sub(r"\\(.)", r"\1", tail))


def format_name(name: Name) -> str:
    """The text of a name; marks in the local part are escaped where the grammar asks for it."""
    if name.is_iri:
        return f"<{name.local}>"
    local = re.sub(r"[~!$&'()*+,;=/?#@%]", lambda m: "\\" + m[0], name.local)
    local = re.sub(r"^[.-]|\.$", lambda m: "\\" + m[0], local)
    return f"{name.prefix}:{local}"


class PrefixMap(Mapping[str, str]):
    """Prefixes and the IRIs they stand for; the longest IRI wins where several fit."""

    def __init__(self, prefixes: Mapping[str, str], base: str | None = None) -> None:
        self._prefixes = dict(prefixes)
        self.base = base

    def __getitem__(self, prefix: str) -> str:
        return self._prefixes[prefix]

    def __iter__(self) -> Iterator[str]:
        return iter(self._prefixes)

    def __len__(self) -> int:
        return len(self._prefixes)

    def _longest_first(self) -> list[tuple[str, str]]:
        return sorted(self._prefixes.items(), key=lambda x: (-len(x[1]), x[0]))

    def resolve(self, name: Name | str) -> str | None:
        """The IRI of a name; None for an unknown prefix."""
        name = parse_name(name) if isinstance(name, str) else name
        if name.is_iri:
            return self.resolve_iri(name.local)
        if name.prefix not in self._prefixes:
            return None
        namespace = self._prefixes[name.prefix]
        return namespace + name.local

    def resolve_iri(self, iri: str) -> str:
        """iri against the base; one that ends in # is extended, others follow RFC 3986."""
        if self.base is None or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
            return iri
        return self.base + iri.lstrip("#") if self.base.endswith("#") else urljoin(self.base, iri)

    def compact(self, iri: str) -> Name | None:
        """The prefixed name of an IRI, if a prefix fits and the rest is a local name."""
        for prefix, namespace in self._longest_first():
            if iri.startswith(namespace) and _prefix.fullmatch(prefix):
                name = Name(prefix, iri[len(namespace) :])
                if _local.fullmatch(format_name(name).split(":", 1)[1]):  # escaped where the grammar lets it be
                    return name
        return None

    def shorten(self, iri: str) -> str:
        """The prefixed name of an IRI, or the IRI in angle brackets."""
        name = self.compact(iri)
        return format_name(name) if name else f"<{iri}>"

    def header(self) -> str:
        """Prefix declarations, one to a line, in order of prefix."""
        lines = [f"@base <{self.base}> ."] if self.base else []
        return "\n".join(lines + [f"@prefix {p}: <{n}> ." for p, n in sorted(self._prefixes.items())])

    def compact_column(self, iri: Column) -> Column:
        """compact on a column, as text; null where no prefix fits."""
        out = F.lit(None).cast("string")
        for prefix, namespace in reversed(self._longest_first()):
            fits = iri.startswith(F.lit(namespace))
            out = F.when(fits, F.concat(F.lit(prefix + ":"), F.substr(iri, F.lit(len(namespace) + 1)))).otherwise(out)
        return out

    def shorten_column(self, iri: Column) -> Column:
        return F.coalesce(self.compact_column(iri), F.concat(F.lit("<"), iri, F.lit(">")))

    def resolve_column(self, name: Column) -> Column:
        """The IRI of prefixed names or bracketed IRIs in a column; null for an unknown prefix."""
        prefix, local = F.substring_index(name, ":", 1), F.substr(name, F.instr(name, ":") + 1)
        plain = F.regexp_replace(local, r"\\(.)", "$1")
        out = F.lit(None).cast("string")
        for p, namespace in self._prefixes.items():
            out = F.when(prefix == p, F.concat(F.lit(namespace), plain)).otherwise(out)
        return F.when(name.startswith("<"), F.substr(name, F.lit(2), F.length(name) - 2)).otherwise(out)


def fragment(iri: Column) -> Column:
    """What follows the last #, null without one."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1))


def local_name(iri: Column) -> Column:
    """What follows the last # or /."""
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def compact_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def file_stem(path: Column) -> Column:
    """The file's name without folders and its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
