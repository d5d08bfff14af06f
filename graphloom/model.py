"""What a mapping compiles to: sources, term maps, rules."""

from __future__ import annotations

from dataclasses import dataclass, field, replace  # noqa: F401

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"


class MappingError(ValueError):
    """A mapping that says something impossible."""


class IRI(str):
    __slots__ = ()


class BNode(str):
    __slots__ = ()


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str | None = None
    lang: str | None = None

    def __str__(self) -> str:
        return self.value


Node = IRI | BNode | Literal


@dataclass(frozen=True)
class Source:
    """A logical source. ``kind``: csv, tsv, parquet, json, xml, table, query, memory, ..."""

    kind: str
    location: str = ""
    iterator: str = ""
    query: str = ""
    section: str = ""
    http: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Call:
    """A function call: parameter IRI (its last part) -> arguments in order."""

    function: str
    inputs: tuple[tuple[str, TermMap], ...] = ()


@dataclass(frozen=True)
class TermMap:
    """kind: constant (value: a node), template, reference, function (call), quoted (a rule), parent (a rule)."""

    kind: str
    value: object = None
    term: str = "iri"  # iri, bnode, literal, star
    datatype: TermMap | None = None
    lang: TermMap | None = None
    joins: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Rule:
    name: str
    source: Source
    subject: TermMap
    predicate: TermMap
    object: TermMap
    graph: TermMap | None = None
    asserted: bool = True
    base: str = ""
