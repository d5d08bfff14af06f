"""A reader of Turtle and N-Triples documents, for mapping files (small, read on the driver)."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from ..model import RDF, XSD, BNode, IRI, Literal, MappingError, Node

TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\s]*>)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<dt>\^\^)
    |(?P<num>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<bnode>_:[\w·-](?:[\w·.-]*[\w·-])?)
    |(?P<name>(?:[^\W\d_](?:[\w.·-]*[\w·-])?)?:(?:(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<punct>[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        return chr(int(c[1:], 16)) if c[0] in "uU" and len(c) > 1 else _ESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.DOTALL) if "\\" in s else s


class Reader:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise MappingError(f"can't read the mapping at {text[at : at + 40]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.base, self.prefixes, self.n = 0, "", {}, 0
        self.triples: list[tuple[Node, Node, Node]] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def expect(self, text: str) -> None:
        t = self.next()
        if t[1] != text:
            raise MappingError(f"expected {text!r}, found {t[1]!r}")

    def fresh(self) -> BNode:
        self.n += 1
        return BNode(f"b{self.n}")

    def resolve(self, iri: str) -> IRI:
        iri = unescape(iri)
        return IRI(urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else iri)

    def run(self) -> list[tuple[Node, Node, Node]]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            word = text.lstrip("@").lower()
            if kind in ("at", "word") and word in ("prefix", "base"):
                self.next()
                if word == "prefix":
                    name = self.next()[1]
                    self.prefixes[name[:-1]] = self.resolve(self.next()[1][1:-1])
                else:
                    self.base = self.resolve(self.next()[1][1:-1])
                if kind == "at":
                    self.expect(".")
                continue
            subject = self.node()
            if not (text == "[" and self.peek()[1] == "."):
                self.properties(subject)
            self.expect(".")
        return self.triples

    def properties(self, subject: Node) -> None:
        while True:
            while self.peek()[1] == ";":
                self.next()
            if self.peek()[1] in (".", "]", ""):
                return
            predicate = IRI(RDF + "type") if self.peek() == ("word", "a") else None
            if predicate:
                self.next()
            else:
                predicate = self.node()
            while True:
                self.triples.append((subject, predicate, self.node()))
                if self.peek()[1] != ",":
                    break
                self.next()
            if self.peek()[1] != ";":
                return

    def node(self) -> Node:
        kind, text = self.next()
        if kind == "iri":
            return self.resolve(text[1:-1])
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise MappingError(f"unknown prefix {prefix!r}")
            return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "bnode":
            return BNode(text[2:])
        if kind in ("str", "long"):
            value = unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "at":
                return Literal(value, None, self.next()[1][1:].lower())
            if self.peek()[0] == "dt":
                self.next()
                dt = str(self.node())
                return Literal(value, None if dt == XSD + "string" else dt)
            return Literal(value)
        if kind == "num":
            dt = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return Literal(text, XSD + dt)
        if kind == "word" and text in ("true", "false"):
            return Literal(text, XSD + "boolean")
        if text == "[":
            me = self.fresh()
            self.properties(me)
            self.expect("]")
            return me
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.next()
            head: Node = IRI(RDF + "nil")
            for item in reversed(items):
                cell = self.fresh()
                self.triples += [(cell, IRI(RDF + "first"), item), (cell, IRI(RDF + "rest"), head)]
                head = cell
            return head
        raise MappingError(f"unexpected {text!r}")


def parse(text: str, base: str = "") -> tuple[list[tuple[Node, Node, Node]], str]:
    """The triples and the document's base."""
    r = Reader(text)
    r.base = base
    return r.run(), r.base
