"""SPARQL expressions as Columns over term structs (t, v, d, l); errors are nulls.

Numbers have two columns: a double, and for integers and decimals an exact
value too, which is null for other types and beyond 23 whole or 14 fraction
digits. Results are exact where both operands are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import XSD, BNode, Literal
from ..terms import double_text, percent_encode
from .parser import QueryError

NUMERIC = tuple(XSD + n for n in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong"))
WHOLE = tuple(XSD + n for n in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong"))


EXACT = "decimal(37,14)"
INSTANT = (XSD + "dateTime", XSD + "dateTimeStamp")


def exactly(v: Column) -> Column:
    """A lexical form as a decimal, null where that would round."""
    return F.when(~v.rlike(r"\.\d{14}\d*[1-9]"), v.try_cast(EXACT))


def rounded_to(x: Column, kind: str) -> Column:
    """x in a narrower type, null where that would change it."""
    narrow = x.try_cast(kind)
    return F.when(narrow == x, narrow)


def product(x: Column, y: Column) -> Column:
    parts = [F.try_multiply(rounded_to(x, k), rounded_to(y, k)).try_cast(EXACT) for k in ("decimal(18,7)", "decimal(18,0)")]
    return F.coalesce(*parts)


def _null() -> Column:
    return F.lit(None).cast("string")


def make(t: str, v: Column, d: Column | None = None, lang: Column | None = None) -> Column:
    made = F.struct(F.lit(t).alias("t"), v.alias("v"), (_null() if d is None else d).alias("d"), (_null() if lang is None else lang).alias("l"))
    return F.when(v.isNotNull(), made)


def constant(n) -> Column:
    if isinstance(n, Literal):
        return make("L", F.lit(n.value), F.lit(n.datatype) if n.datatype else None, F.lit(n.lang) if n.lang else None)
    return make("B" if isinstance(n, BNode) else "I", F.lit(str(n)))


@dataclass
class V:
    """kind: term, bool, num (with ``rank``: 0 whole, 1 decimal, 2 double), str (plain literal), iri."""

    kind: str
    col: Column
    rank: Column | None = None
    fine: Column | None = None

    def term(self) -> Column:
        c = self.col
        if self.kind == "term":
            return c
        if self.kind == "bool":
            return make("L", c.cast("string"), F.lit(XSD + "boolean"))
        if self.kind == "num":
            e = self.exact()
            whole = F.coalesce(e.cast("decimal(38,0)").cast("string"), c.try_cast("long").cast("string"))
            decimal = F.regexp_replace(e.cast("string"), r"(\.\d+?)0+$", "$1")
            text = F.coalesce(F.when(self.rank == 0, whole).when(self.rank == 1, decimal), double_text(c))
            d = F.when(self.rank == 0, XSD + "integer").when(self.rank == 1, XSD + "decimal").otherwise(XSD + "double")
            return make("L", text, d)
        return make("I" if self.kind == "iri" else "L", c)

    def text(self) -> Column:
        """The lexical form."""
        return self.col["v"] if self.kind == "term" else self.col if self.kind in ("str", "iri") else self.term()["v"]

    def num(self) -> Column:
        if self.kind == "num":
            return self.col
        if self.kind == "term":
            return F.when((self.col["t"] == "L") & self.col["d"].isin(*NUMERIC), self.col["v"].try_cast("double"))
        return F.lit(None).cast("double")

    def exact(self) -> Column:
        """The value as a decimal, null where it is none or its double is all there is."""
        if self.kind == "num":
            return F.lit(None).cast(EXACT) if self.fine is None else self.fine
        if self.kind == "term":
            return F.when((self.col["t"] == "L") & self.col["d"].isin(*WHOLE, XSD + "decimal"), exactly(self.col["v"]))
        return F.lit(None).cast(EXACT)

    def instant(self) -> Column:
        """A dateTime as a point in time; without a zone it is in the session's."""
        if self.kind != "term":
            return F.lit(None).cast("timestamp")
        return F.when((self.col["t"] == "L") & self.col["d"].isin(*INSTANT), self.col["v"].try_cast("timestamp"))

    def ranked(self) -> Column:
        if self.kind == "num":
            return self.rank
        d = self.term()["d"]
        return F.when(d.isin(*WHOLE), 0).when(d == XSD + "decimal", 1).otherwise(2)

    def ebv(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind == "num":
            return self.col != 0
        if self.kind == "str":
            return F.length(self.col) > 0
        c = self.term()
        v, d = c["v"], c["d"]
        return F.when(c["t"] != "L", F.lit(None).cast("boolean")).when(d == XSD + "boolean", v.isin("true", "1")).when(d.isin(*NUMERIC), F.coalesce(v.try_cast("double") != 0, F.lit(False))).when(d.isNull(), F.length(v) > 0)


def compare(op: str, a: V, b: V) -> Column:
    x, y = a.num(), b.num()
    numbers = x.isNotNull() & y.isNotNull()
    p, q = a.exact(), b.exact()
    exact = p.isNotNull() & q.isNotNull()
    since, until = a.instant(), b.instant()
    instants = since.isNotNull() & until.isNotNull()
    s, t = a.term(), b.term()
    if op in ("=", "!="):
        known = (s["t"] == "L") & (t["t"] == "L")
        boolean = known & (s["d"] == XSD + "boolean") & (t["d"] == XSD + "boolean")
        truth = lambda q: q["v"].isin("true", "1")
        same = F.when(exact, p == q).when(numbers, x == y).when(instants, since == until).when(boolean, truth(s) == truth(t)).otherwise(F.when(s.isNotNull() & t.isNotNull(), s.eqNullSafe(t)))
        return same if op == "=" else ~same
    f = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
    alike = (s["t"] == "L") & (t["t"] == "L") & s["d"].eqNullSafe(t["d"])
    return F.when(exact, f(p, q)).when(numbers, f(x, y)).when(instants, f(since, until)).when(alike & ~F.coalesce(s["d"].isin(*NUMERIC), F.lit(False)), f(s["v"], t["v"]))


def operands(e) -> set[str]:
    """The variables that are sides of an arithmetic operator."""
    if not isinstance(e, tuple | list):
        return set()
    own = {str(x[1]) for x in e[1:] if isinstance(x, tuple) and x[:1] == ("var",)} if isinstance(e, tuple) and e[:1] and e[0] in ("+", "-", "*", "/", "neg") else set()
    return own.union(*(operands(x) for x in e))


class Expressions:
    """Compiles expressions; ``column`` gives a variable's struct (None if it is never bound)."""

    def __init__(self, column, numbers: dict[str, V] | None = None) -> None:
        self.column, self.numbers = column, numbers or {}

    def operand(self, e) -> V:
        """A side of an arithmetic operator; a variable's number may stand in columns already."""
        return self.numbers.get(str(e[1])) if e[0] == "var" and str(e[1]) in self.numbers else self.of(e)

    def of(self, e) -> V:
        kind = e[0]
        if kind == "var":
            return V("term", self.column(str(e[1])))
        if kind == "term":
            return V("term", constant(e[1]))
        if kind in ("and", "or"):
            a, b = self.of(e[1]).ebv(), self.of(e[2]).ebv()
            return V("bool", a & b if kind == "and" else a | b)
        if kind == "!":
            return V("bool", ~self.of(e[1]).ebv())
        if kind in ("=", "!=", "<", ">", "<=", ">="):
            return V("bool", compare(kind, self.of(e[1]), self.of(e[2])))
        if kind == "in":
            a, out = self.of(e[1]), F.lit(False)
            for x in e[2]:
                out = out | compare("=", a, self.of(x))
            return V("bool", out)
        if kind in ("+", "-", "*", "/"):
            a, b = self.operand(e[1]), self.operand(e[2])
            x, y = a.num(), b.num()
            rank = F.greatest(a.ranked(), b.ranked())
            if kind == "/":
                return V("num", F.try_divide(x, y), F.greatest(rank, F.lit(1)))
            p, q = a.exact(), b.exact()
            fine = {"+": F.try_add, "-": F.try_subtract, "*": product}[kind](p, q)
            return V("num", {"+": x + y, "-": x - y, "*": x * y}[kind], rank, fine.try_cast(EXACT))
        if kind == "neg":
            a = self.operand(e[1])
            return V("num", -a.num(), a.ranked(), -a.exact())
        if kind == "cast":
            return self.cast(e[1], self.of(e[2]))
        if kind == "call":
            return self.call(e[1], e[2])
        raise QueryError(f"{kind} is not supported here")

    def cast(self, to: str, a: V) -> V:
        name, v = to.removeprefix(XSD), a.text()
        if name == "integer":
            x, truth = v.try_cast("double"), F.when(v == "true", 1).when(v == "false", 0)
            towards = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
            e = exactly(v)
            fine = F.when(e < 0, F.ceil(e)).otherwise(F.floor(e)).try_cast(EXACT)
            return V("num", F.coalesce(truth, towards).cast("double"), F.lit(0), F.coalesce(truth.cast(EXACT), fine))
        if name in ("decimal", "double", "float"):
            return V("num", v.try_cast("double"), F.lit(1 if name == "decimal" else 2), exactly(v) if name == "decimal" else None)
        if name == "boolean":
            return V("bool", F.when(F.lower(v).isin("true", "1"), True).when(F.lower(v).isin("false", "0"), False))
        if name == "string":
            return V("str", v)
        return V("term", make("L", v, F.lit(to)))

    def call(self, name: str, args: list) -> V:
        if name == "BOUND":
            return V("bool", self.column(str(args[0][1])).isNotNull())
        if name == "COALESCE":
            return V("term", F.coalesce(*(self.of(x).term() for x in args)))
        if name == "IF":
            a, b, c = (self.of(x) for x in args)
            return V("term", F.when(a.ebv(), b.term()).when(~a.ebv(), c.term()))
        v = [self.of(x) for x in args]
        s = [x.text() for x in v]
        t = v[0].term() if v else None
        like = lambda x: V("term", make("L", x, t["d"], t["l"]))  # noqa: E731  a string with its argument's language
        two = {"CONTAINS": lambda: s[0].contains(s[1]), "STRSTARTS": lambda: s[0].startswith(s[1]), "STRENDS": lambda: s[0].endswith(s[1])}
        if name in two:
            return V("bool", two[name]())
        if name in ("REGEX", "REPLACE"):
            at = 2 if name == "REGEX" else 3
            given = str(args[at][1]) if len(args) > at else ""
            java = "".join({"i": "i", "s": "s", "m": "m", "x": "x"}.get(c, "") for c in given)
            pattern = F.concat(F.lit(f"(?{java})"), s[1]) if java else s[1]
            return V("bool", F.rlike(s[0], pattern)) if name == "REGEX" else like(F.regexp_replace(s[0], pattern, s[2]))
        simple = {
            "STR": lambda: V("str", s[0]),
            "LANG": lambda: V("str", F.when(t["t"] == "L", F.coalesce(t["l"], F.lit("")))),
            "LANGMATCHES": lambda: V("bool", F.when(s[1] == "*", s[0] != "").otherwise((F.lower(s[0]) == F.lower(s[1])) | F.lower(s[0]).startswith(F.concat(F.lower(s[1]), F.lit("-"))))),
            "DATATYPE": lambda: V("iri", F.when(t["t"] == "L", F.when(t["l"].isNotNull(), "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise(F.coalesce(t["d"], F.lit(XSD + "string"))))),
            "ISIRI": lambda: V("bool", t["t"] == "I"),
            "ISURI": lambda: V("bool", t["t"] == "I"),
            "ISBLANK": lambda: V("bool", t["t"] == "B"),
            "ISLITERAL": lambda: V("bool", t["t"] == "L"),
            "ISNUMERIC": lambda: V("bool", F.when(t.isNotNull(), v[0].num().isNotNull())),
            "IRI": lambda: V("iri", s[0]),
            "URI": lambda: V("iri", s[0]),
            "BNODE": lambda: V("term", make("B", s[0] if s else F.expr("uuid()"))),
            "STRDT": lambda: V("term", make("L", s[0], F.nullif(s[1], F.lit(XSD + "string")))),
            "STRLANG": lambda: V("term", make("L", s[0], None, F.lower(s[1]))),
            "UUID": lambda: V("iri", F.concat(F.lit("urn:uuid:"), F.expr("uuid()"))),
            "STRUUID": lambda: V("str", F.expr("uuid()")),
            "STRLEN": lambda: V("num", F.length(s[0]).cast("double"), F.lit(0)),
            "SUBSTR": lambda: like(F.substring(s[0], v[1].num().cast("int"), v[2].num().cast("int") if len(v) > 2 else F.length(s[0]))),
            "UCASE": lambda: like(F.upper(s[0])),
            "LCASE": lambda: like(F.lower(s[0])),
            "STRBEFORE": lambda: V("term", F.when(F.position(s[1], s[0]) > 0, make("L", F.substring(s[0], F.lit(1), F.position(s[1], s[0]) - 1), t["d"], t["l"])).otherwise(make("L", F.lit("")))),
            "STRAFTER": lambda: V("term", F.when(F.position(s[1], s[0]) > 0, make("L", F.substring(s[0], F.position(s[1], s[0]) + F.length(s[1]), F.length(s[0])), t["d"], t["l"])).otherwise(make("L", F.lit("")))),
            "ENCODE_FOR_URI": lambda: V("str", percent_encode(s[0])),
            "CONCAT": lambda: V("str", F.concat(*s) if s else F.lit("")),
            "ABS": lambda: V("num", F.abs(v[0].num()), v[0].ranked(), F.abs(v[0].exact())),
            "ROUND": lambda: V("num", F.floor(v[0].num() + 0.5).cast("double"), v[0].ranked(), F.floor(F.try_add(v[0].exact(), F.lit("0.5").cast(EXACT))).try_cast(EXACT)),
            "CEIL": lambda: V("num", F.ceil(v[0].num()).cast("double"), v[0].ranked(), F.ceil(v[0].exact()).try_cast(EXACT)),
            "FLOOR": lambda: V("num", F.floor(v[0].num()).cast("double"), v[0].ranked(), F.floor(v[0].exact()).try_cast(EXACT)),
            "RAND": lambda: V("num", F.rand(), F.lit(2)),
            "NOW": lambda: V("term", make("L", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.lit(XSD + "dateTime"))),
            "MD5": lambda: V("str", F.md5(s[0].cast("binary"))),
            "SHA1": lambda: V("str", F.sha1(s[0].cast("binary"))),
            "SHA256": lambda: V("str", F.sha2(s[0].cast("binary"), 256)),
            "SHA384": lambda: V("str", F.sha2(s[0].cast("binary"), 384)),
            "SHA512": lambda: V("str", F.sha2(s[0].cast("binary"), 512)),
            "SAMETERM": lambda: V("bool", F.when(t.isNotNull() & v[1].term().isNotNull(), t.eqNullSafe(v[1].term()))),
            "TZ": lambda: V("str", F.regexp_extract(s[0], r"(Z|[+-]\d\d:\d\d)$", 1)),
            "TIMEZONE": lambda: V("term", self._zone(s[0])),
        }
        parts = {"YEAR": (r"^(-?\d{4,})-", 0), "MONTH": (r"^-?\d{4,}-(\d\d)", 0), "DAY": (r"^-?\d{4,}-\d\d-(\d\d)", 0), "HOURS": (r"T(\d\d):", 0), "MINUTES": (r"T\d\d:(\d\d)", 0), "SECONDS": (r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1)}
        if name in parts:
            pattern, rank = parts[name]
            return V("num", F.nullif(F.regexp_extract(s[0], pattern, 1), F.lit("")).try_cast("double"), F.lit(rank))
        if name not in simple:
            raise QueryError(f"unknown function {name}")
        return simple[name]()

    @staticmethod
    def _zone(s: Column) -> Column:
        z = F.regexp_extract(s, r"(Z|[+-]\d\d:\d\d)$", 1)
        hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
        text = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
        return F.when(z == "Z", make("L", F.lit("PT0S"), F.lit(XSD + "dayTimeDuration"))).when(z != "", make("L", text, F.lit(XSD + "dayTimeDuration")))

