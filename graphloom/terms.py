"""Lexical forms and RDF terms as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frontend.mapping import SCHEME, template_parts
from .model import XSD, BNode, Call, IRI, Literal, TermMap

TERM = "struct<t:string,v:string,d:string,l:string>"


def double_text(x: Column) -> Column:
    """Shortest form of a double: plain between 1e-4 and 1e16, else with a two-digit exponent."""
    s = x.cast("string")
    plain = F.regexp_replace(x.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(x)
    mantissa = F.regexp_replace(F.regexp_extract(s, r"^(.*?)E", 1), r"\.0$", "")
    power = F.regexp_extract(s, r"E(-?\d+)$", 1)
    digits = F.regexp_replace(power, "-", "")
    exponent = F.concat(F.when(power.startswith("-"), "e-").otherwise("e+"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))
    return F.when(~s.contains("E"), s).when((size >= 1e-4) & (size < 1e16), plain).otherwise(F.concat(mantissa, exponent))


def text_of(x: Column, kind: T.DataType) -> Column:
    """The lexical form of a typed column; nulls stay null."""
    if isinstance(kind, T.StringType):
        return x
    if isinstance(kind, T.DoubleType):
        return double_text(x)
    if isinstance(kind, T.FloatType):
        return double_text(x.cast("string").cast("double"))
    if isinstance(kind, T.BinaryType):
        return F.hex(x)
    if isinstance(kind, T.DecimalType):
        s = x.cast("string")
        return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s) if kind.scale else s
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(x)
    return x.cast("string")


def xsd_of(kind: T.DataType) -> str | None:
    """The datatype that a typed source column has by nature."""
    for types, name in (
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"),
        ((T.DecimalType,), "decimal"),
        ((T.FloatType, T.DoubleType), "double"),
        ((T.BooleanType,), "boolean"),
        ((T.DateType,), "date"),
        ((T.TimestampType, T.TimestampNTZType), "dateTime"),
        ((T.BinaryType,), "hexBinary"),
    ):
        if isinstance(kind, types):
            return XSD + name
    return None


def percent_encode(x: Column, safe: str = "") -> Column:
    """All but unreserved characters, and those in ``safe``, as UTF-8 %XX."""
    out = F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for c in safe:
        for b in {"".join(f"%{byte:02X}" for byte in c.encode())}:
            out = F.replace(out, F.lit(b), F.lit(c))
    return out


def escape(x: Column, more: str = "") -> Column:
    for c, e in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ('"', '\\"')):
        x = F.replace(x, F.lit(c), F.lit(e))
    for c in more:
        if c not in '\n\r"\\':
            x = F.replace(x, F.lit(c), F.lit({"\t": "\\t", "\b": "\\b", "\f": "\\f"}.get(c, f"\\u{ord(c):04X}")))
    return x


def escape_text(s: str) -> str:
    return s.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace('"', '\\"')


def natural(value: Column, datatype: str | None) -> Column:
    """Canonical forms that a datatype asks for."""
    if datatype == XSD + "boolean":
        return F.lower(value)
    if datatype == XSD + "dateTime":
        return F.regexp_replace(value, r"^(\S+) (\S)", "$1T$2")
    if datatype == XSD + "integer":
        return F.regexp_replace(value, r"\.0+$", "")
    return value


def references(t: TermMap | None) -> list[str]:
    """The source columns that a term map reads, joins apart."""
    if t is None:
        return []
    out: list[str] = []
    if t.kind == "reference":
        out.append(str(t.value))
    elif t.kind == "template":
        out += [x for is_ref, x in template_parts(str(t.value)) if is_ref]
    elif t.kind == "function":
        out += [r for _, i in t.value.inputs for r in references(i)]
    return list(dict.fromkeys(out + references(t.datatype) + references(t.lang)))


@dataclass
class Options:
    na_values: tuple[str, ...] = ("", "nan")
    escaping: str = '"\n\r'
    printable_only: bool = False
    safe: str = ""
    infer_datatypes: bool = False
    compat: bool = False
    call: Callable[[Call, Callable[[str], Column]], Column] | None = None


@dataclass
class Cols:
    """A term as columns. kind: iri, bnode, literal, star; value is null where the row has no such term."""

    kind: str
    value: Column
    datatype: Column | None = None
    lang: Column | None = None

    def text(self, o: Options) -> Column:
        """The N-Triples form."""
        if self.kind == "iri":
            return F.concat(F.lit("<"), self.value, F.lit(">"))
        if self.kind == "bnode":
            return F.concat(F.lit("_:"), self.value)
        if self.kind == "star":
            return self.value
        body = F.concat(F.lit('"'), escape(self.value, o.escaping), F.lit('"'))
        if self.lang is not None:
            return F.concat(body, F.lit("@"), self.lang)
        if self.datatype is not None:
            return F.concat(body, F.when(self.datatype == XSD + "string", F.lit("")).otherwise(F.concat(F.lit("^^<"), self.datatype, F.lit(">"))))
        return body

    def struct(self) -> Column:
        null = F.lit(None).cast("string")
        d = null if self.datatype is None else F.when(self.datatype != XSD + "string", self.datatype)
        made = F.struct(F.lit({"iri": "I", "bnode": "B", "star": "S"}.get(self.kind, "L")).alias("t"), self.value.alias("v"), d.alias("d"), (null if self.lang is None else self.lang).alias("l"))
        return F.when(self.value.isNotNull(), made)


class TermCompiler:
    """Term maps over a source's columns. ``column`` gives the text of a reference, null where it is NA."""

    def __init__(self, column: Callable[[str], Column], options: Options, base: str = "", types: dict[str, T.DataType] | None = None) -> None:
        self.column, self.o, self.base, self.types = column, options, base, types or {}

    def absolute(self, value: Column, start: str) -> Column:
        if not self.base or re.match(SCHEME, start):
            return value
        return F.when(value.rlike("^" + SCHEME), value).otherwise(F.concat(F.lit(self.base), value))

    def clean(self, x: Column) -> Column:
        return F.regexp_replace(x, r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", "") if self.o.printable_only else x

    def plain(self, t: TermMap) -> Column:
        """A term map's value without percent-encoding, as function arguments and language tags need it."""
        if t.kind == "constant":
            return F.lit(str(t.value))
        if t.kind == "reference":
            return self.column(str(t.value))
        if t.kind == "template":
            return F.concat(*(self.column(x) if r else F.lit(x) for r, x in template_parts(str(t.value))))
        return self.o.call(t.value, self.column)

    def term(self, t: TermMap) -> Cols:
        if t.kind == "constant":
            v = t.value
            if isinstance(v, Literal):
                return Cols("literal", F.lit(v.value), F.lit(v.datatype) if v.datatype else None, F.lit(v.lang) if v.lang else None)
            return Cols("bnode" if isinstance(v, BNode) else "iri", F.lit(str(v)))
        start = ""
        if t.kind == "template":
            parts = template_parts(str(t.value))
            start = parts[0][1] if parts and not parts[0][0] else ""
            each = [(percent_encode(self.clean(self.column(x)), self.o.safe) if t.term in ("iri", "bnode") else self.clean(self.column(x))) if r else F.lit(x) for r, x in parts]
            value = F.concat(*each) if each else F.lit("")
        else:
            value = self.clean(self.plain(t))
        if t.term == "iri":
            if t.kind != "template":  # characters that no IRI has: not an IRI, so no term
                value = F.when(~value.rlike(r'[\x00-\x20<>"{}|^`\\]'), value)
            return Cols("iri", self.absolute(value, start))
        if t.term == "bnode":
            return Cols("bnode", value if t.kind == "template" else percent_encode(value, self.o.safe))
        datatype = None
        if t.datatype is not None:
            datatype = F.lit(str(t.datatype.value)) if t.datatype.kind == "constant" else self.term(t.datatype).value
            if t.datatype.kind == "constant":
                value = natural(value, str(t.datatype.value))
        elif self.o.infer_datatypes and t.kind == "reference" and t.lang is None and (found := xsd_of(self.types.get(str(t.value), T.StringType()))):
            datatype, value = F.lit(found), natural(value, found)
        lang = None if t.lang is None else F.lower(self.plain(t.lang)) if t.lang.kind != "constant" else F.lit(str(t.lang.value).lower())
        return Cols("literal", value, datatype, lang)


def possible(values: tuple[str, ...], kind: T.DataType) -> list[str]:
    """Those NA values that a column of this type can have as its text."""
    if isinstance(kind, T.IntegralType | T.BooleanType | T.DateType | T.TimestampType):
        return [v for v in values if re.match(r"[-+\dtf]", v)]
    if isinstance(kind, T.DoubleType | T.FloatType):
        return [v for v in values if v] + (["NaN"] if "nan" in values else [])
    return list(values)


def na(column: Column, values: tuple[str, ...], kind: T.DataType | None = None) -> Column:
    values = possible(values, kind) if kind is not None else values
    return F.when(~column.isin(*values), column) if values else column


def present(raw: Column, values: tuple[str, ...], kind: T.DataType) -> Column:
    """A source column holds a value: in a form that reaches the scan where it can."""
    able = possible(values, kind)
    text = raw if isinstance(kind, T.StringType) else text_of(raw, kind)
    return raw.isNotNull() & ~text.isin(*able) if able else raw.isNotNull()


def node_text(n: IRI | BNode | Literal) -> str:
    """The N-Triples form of a constant."""
    if isinstance(n, Literal):
        return f'"{escape_text(n.value)}"' + (f"@{n.lang}" if n.lang else f"^^<{n.datatype}>" if n.datatype and n.datatype != XSD + "string" else "")
    return f"_:{n}" if isinstance(n, BNode) else f"<{n}>"
