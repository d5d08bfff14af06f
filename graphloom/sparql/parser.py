"""SPARQL 1.1 queries as algebra trees (nested tuples)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urljoin

from ..frontend.turtle import unescape
from ..model import RDF, XSD, IRI, Literal


class QueryError(ValueError):
    """A query that can't be read or isn't supported."""


class Var(str):
    __slots__ = ()


TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<var>[?$]\w+)
    |(?P<str>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<num>\d+\.?\d*[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?|\d+\.\d+|\d+)
    |(?P<bnode>_:\w[\w.-]*)
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:[\w:%-](?:[\w:.%-]*[\w:%-])?|\\[^\w\s])*)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+*/^|?-])""",
    re.VERBOSE | re.DOTALL,
)
AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT")


@dataclass
class Query:
    form: str = "SELECT"
    project: list = field(default_factory=list)  # of (Var, expression or None); empty: all
    distinct: bool = False
    where: tuple = ("unit",)
    group: list = field(default_factory=list)  # of (expression, Var or None)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # of (expression, descending)
    limit: int | None = None
    offset: int = 0
    template: list = field(default_factory=list)
    describe: list = field(default_factory=list)


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"can't read the query at {text[at : at + 30]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.n = 0, {}, "", 0

    # -- tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def word(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind == "word" and text.upper() in words

    def take(self, *words: str) -> bool:
        if self.word(*words):
            self.at += 1
            return True
        return False

    def op(self, text: str) -> bool:
        if self.peek() == ("op", text):
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if self.next()[1].upper() != text:
            raise QueryError(f"expected {text!r}, found {self.peek(-1)[1]!r}")

    def fresh(self) -> Var:
        self.n += 1
        return Var(f"_{self.n}")

    # -- queries

    def parse(self) -> Query:
        while self.word("PREFIX", "BASE"):
            if self.take("PREFIX"):
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.iri()
            else:
                self.take("BASE")
                self.base = self.next()[1][1:-1]
        q = Query()
        if self.word("SELECT"):
            q = self.select()
        elif self.take("ASK"):
            q.form = "ASK"
            self.take("WHERE")
            q.where = self.group()
        elif self.take("CONSTRUCT"):
            q.form = "CONSTRUCT"
            if self.take("WHERE"):
                mark = self.at
                q.where = self.group()
                self.at = mark
                q.template = self.template()
            else:
                q.template = self.template()
                self.take("WHERE")
                q.where = self.group()
            self.modifiers(q)
        elif self.take("DESCRIBE"):
            q.form = "DESCRIBE"
            while self.peek()[0] in ("var", "iri", "name"):
                q.describe.append(self.term())
            if self.take("WHERE") or self.peek() == ("op", "{"):
                q.where = self.group()
            self.modifiers(q)
        else:
            raise QueryError(f"unknown query form {self.peek()[1]!r}")
        if self.take("VALUES"):
            q.where = ("join", q.where, self.values())
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return q

    def select(self) -> Query:
        self.expect("SELECT")
        q = Query()
        q.distinct = self.take("DISTINCT", "REDUCED")
        while True:
            if self.op("*"):
                break
            if self.peek()[0] == "var":
                q.project.append((self.var(), None))
            elif self.op("("):
                e = self.expression()
                self.expect("AS")
                q.project.append((self.var(), e))
                self.expect(")")
            else:
                break
        if self.take("FROM"):
            raise QueryError("dataset clauses (FROM, FROM NAMED) are not supported")
        self.take("WHERE")
        q.where = self.group()
        self.modifiers(q)
        return q

    def modifiers(self, q: Query) -> None:
        if self.take("GROUP"):
            self.expect("BY")
            while not self.word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES") and self.peek()[1] not in ("", "}"):
                if self.op("("):
                    e = self.expression()
                    v = self.var() if self.take("AS") else None
                    self.expect(")")
                    q.group.append((e, v))
                else:
                    q.group.append((self.primary(), None))
        if self.take("HAVING"):
            while self.peek()[1] == "(" or self.peek()[0] == "word" and not self.word("ORDER", "LIMIT", "OFFSET", "VALUES"):
                q.having.append(self.primary())
        if self.take("ORDER"):
            self.expect("BY")
            while not self.word("LIMIT", "OFFSET", "VALUES") and self.peek()[1] not in ("", "}"):
                down = self.word("DESC")
                if self.take("ASC", "DESC"):
                    self.expect("(")
                    e = self.expression()
                    self.expect(")")
                else:
                    e = self.primary()
                q.order.append((e, down))
        while self.word("LIMIT", "OFFSET"):
            if self.take("LIMIT"):
                q.limit = int(self.next()[1])
            else:
                self.take("OFFSET")
                q.offset = int(self.next()[1])

    def template(self) -> list:
        self.expect("{")
        out: list = []
        while not self.op("}"):
            self.triples(out)
            self.op(".")
        return out

    # -- patterns

    def group(self) -> tuple:
        self.expect("{")
        if self.word("SELECT"):
            sub = self.select()
            if self.take("VALUES"):
                sub.where = ("join", sub.where, self.values())
            self.expect("}")
            return ("select", sub)
        out: tuple = ("unit",)
        filters, triples = [], []

        def flush() -> None:
            nonlocal out
            if triples:
                plain = [t for t in triples if not isinstance(t[1], tuple)]
                if plain:
                    out = ("join", out, ("bgp", plain)) if out != ("unit",) else ("bgp", plain)
                for t in triples:
                    if isinstance(t[1], tuple):
                        out = ("join", out, ("path", *t)) if out != ("unit",) else ("path", *t)
                triples.clear()

        while not self.op("}"):
            if self.peek()[0] == "end":
                raise QueryError("a group is not closed")
            if self.take("FILTER"):
                filters.append(self.primary())
            elif self.take("OPTIONAL"):
                flush()
                right = self.group()
                condition = None
                if right[0] == "filter":
                    condition, right = right[1], right[2]
                out = ("left", out, right, condition)
            elif self.take("MINUS"):
                flush()
                out = ("minus", out, self.group())
            elif self.take("BIND"):
                flush()
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                out = ("extend", out, self.var(), e)
                self.expect(")")
            elif self.take("VALUES"):
                flush()
                out = ("join", out, self.values())
            elif self.take("GRAPH"):
                flush()
                g = self.term()
                out = ("join", out, ("graph", g, self.group()))
            elif self.peek() == ("op", "{"):
                flush()
                x = self.group()
                while self.take("UNION"):
                    x = ("union", x, self.group())
                out = ("join", out, x)
            else:
                self.triples(triples)
            self.op(".")
        flush()
        for f in filters:
            out = ("filter", f, out)
        return out

    def values(self) -> tuple:
        if self.op("("):
            names = []
            while not self.op(")"):
                names.append(self.var())
        else:
            names = [self.var()]
            self.expect("{")
            rows = []
            while not self.op("}"):
                rows.append([None if self.take("UNDEF") else self.term()])
            return ("values", names, rows)
        self.expect("{")
        rows = []
        while not self.op("}"):
            self.expect("(")
            row = []
            while not self.op(")"):
                row.append(None if self.take("UNDEF") else self.term())
            rows.append(row)
        return ("values", names, rows)

    def triples(self, out: list) -> None:
        s = self.node(out)
        if self.peek()[1] not in (".", "}"):
            self.properties(s, out)

    def properties(self, s, out: list) -> None:
        while True:
            while self.op(";"):
                pass
            if self.peek()[1] in (".", "}", "]") or self.peek()[0] == "end":
                return
            p = self.path()
            while True:
                o = self.node(out)
                out.append((o, p[1], s) if isinstance(p, tuple) and p[0] == "inverse" and not isinstance(p[1], tuple) else (s, p, o))
                if not self.op(","):
                    break
            if self.peek()[1] != ";":
                return

    def node(self, out: list):
        if self.op("["):
            v = self.fresh()
            if not self.op("]"):
                self.properties(v, out)
                self.expect("]")
            return v
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.node(out))
            head = IRI(RDF + "nil")
            for x in reversed(items):
                v = self.fresh()
                out += [(v, IRI(RDF + "first"), x), (v, IRI(RDF + "rest"), head)]
                head = v
            return head
        return self.term()

    def path(self):
        parts = [self.sequence()]
        while self.op("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alternative", *parts)

    def sequence(self):
        parts = [self.step()]
        while self.op("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else ("sequence", *parts)

    def step(self):
        if self.op("^"):
            return ("inverse", self.step())
        if self.op("!"):
            return ("not", self.negated())
        if self.op("("):
            p = self.path()
            self.expect(")")
        elif self.peek()[0] == "var":
            return self.var()
        elif self.take("a"):
            p = IRI(RDF + "type")
        elif self.peek() == ("word", "a"):
            self.next()
            p = IRI(RDF + "type")
        else:
            p = self.iri()
        for mark, name in (("*", "star"), ("+", "plus"), ("?", "maybe")):
            if self.op(mark):
                return (name, p)
        return p

    def negated(self) -> list:
        if self.op("("):
            out = []
            while not self.op(")"):
                out.append(self.step())
                self.op("|")
            return out
        return [self.step()]

    # -- terms

    def var(self) -> Var:
        kind, text = self.next()
        if kind != "var":
            raise QueryError(f"expected a variable, found {text!r}")
        return Var(text[1:])

    def iri(self) -> IRI:
        kind, text = self.next()
        if kind == "iri":
            iri = unescape(text[1:-1])
            return IRI(urljoin(self.base, iri) if self.base else iri)
        if kind == "name":
            prefix, _, name = text.partition(":")
            if prefix not in self.prefixes:
                raise QueryError(f"unknown prefix {prefix!r}")
            return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", name))
        if kind == "word" and text == "a":
            return IRI(RDF + "type")
        raise QueryError(f"expected an IRI, found {text!r}")

    def term(self):
        kind, text = self.peek()
        if kind == "var":
            return self.var()
        if kind in ("iri", "name"):
            return self.iri()
        if kind == "bnode":
            self.next()
            return Var("_b_" + text[2:])
        sign = ""
        if kind == "op" and text in "+-":
            self.next()
            sign = text if text == "-" else ""
            kind, text = self.peek()
        self.next()
        if kind == "num":
            return Literal(sign + text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text.lower() in ("true", "false"):
            return Literal(text.lower(), XSD + "boolean")
        if kind == "str":
            value = unescape(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1])
            if self.peek()[0] == "lang":
                return Literal(value, None, self.next()[1][1:].lower())
            if self.op("^^"):
                d = str(self.iri())
                return Literal(value, None if d == XSD + "string" else d)
            return Literal(value)
        raise QueryError(f"expected a term, found {text!r}")

    # -- expressions

    def expression(self):
        e = self.conjunction()
        while self.op("||"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.relation()
        while self.op("&&"):
            e = ("and", e, self.relation())
        return e

    def relation(self):
        e = self.sum()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.op(op):
                return (op, e, self.sum())
        if self.take("IN"):
            return ("in", e, self.arguments())
        if self.word("NOT") and self.peek(1)[1].upper() == "IN":
            self.at += 2
            return ("!", ("in", e, self.arguments()))
        return e

    def arguments(self) -> list:
        self.expect("(")
        out = []
        while not self.op(")"):
            out.append(self.expression())
            self.op(",")
        return out

    def sum(self):
        e = self.product()
        while self.peek()[1] in ("+", "-") and self.peek()[0] == "op":
            op = self.next()[1]
            e = (op, e, self.product())
        return e

    def product(self):
        e = self.unary()
        while self.peek()[1] in ("*", "/") and self.peek()[0] == "op":
            op = self.next()[1]
            e = (op, e, self.unary())
        return e

    def unary(self):
        if self.op("!"):
            return ("!", self.unary())
        if self.op("-"):
            return ("neg", self.unary())
        if self.op("+"):
            return self.unary()
        return self.primary()

    def primary(self):
        kind, text = self.peek()
        if self.op("("):
            e = self.expression()
            self.expect(")")
            return e
        if kind == "word" and text.upper() in ("EXISTS", "NOT"):
            negated = self.take("NOT")
            self.expect("EXISTS")
            return ("notexists" if negated else "exists", self.group())
        if kind == "word" and text.lower() not in ("true", "false"):
            name = self.next()[1].upper()
            if name in AGGREGATES:
                self.expect("(")
                distinct = self.take("DISTINCT")
                e = None if self.op("*") else self.expression()
                sep = " "
                if self.op(";"):
                    self.expect("SEPARATOR")
                    self.expect("=")
                    sep = str(self.term())
                self.expect(")")
                return ("agg", name, distinct, e, sep)
            return ("call", name, self.arguments())
        if kind in ("iri", "name"):
            iri = self.iri()
            return ("cast", str(iri), self.arguments()[0]) if self.peek() == ("op", "(") else ("term", iri)
        t = self.term()
        return ("var", t) if isinstance(t, Var) else ("term", t)


def variables(e) -> set[str]:
    """Variables that an expression reads, those in EXISTS patterns apart."""
    if isinstance(e, tuple):
        if e and e[0] == "var":
            return {str(e[1])}
        if e and e[0] in ("exists", "notexists"):
            return set()
        return set().union(*(variables(x) for x in e)) if e else set()
    return set().union(*(variables(x) for x in e)) if isinstance(e, list) and e else set()


