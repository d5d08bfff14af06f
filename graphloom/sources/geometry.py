"""Well-known binary as well-known text."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: WKB's type numbers.
NAMES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


def number(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def to_wkt(data: bytes) -> str:
    text, _ = _read(data, 0)
    return text


def _read(data: bytes, at: int, bare: bool = False) -> tuple[str, int]:
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    z = bool(code & 0x80000000) or 1000 < code % 10000 < 2000
    kind, dims = (code & 0xFFFF) % 1000, 3 if z else 2

    def point(at: int) -> tuple[str, int]:
        return " ".join(number(v) for v in struct.unpack_from(order + "d" * dims, data, at)), at + 8 * dims

    def many(at: int, one) -> tuple[str, int]:
        (n,) = struct.unpack_from(order + "I", data, at)
        at, out = at + 4, []
        for _ in range(n):
            s, at = one(at)
            out.append(s)
        return "(" + ", ".join(out) + ")", at

    if kind == 1:
        s, at = point(at)
        s = f"({s})"
    elif kind == 2:
        s, at = many(at, point)
    elif kind == 3:
        s, at = many(at, lambda a: many(a, point))
    else:
        s, at = many(at, lambda a: _read(data, a, kind != 7))
    return (s if bare else f"{NAMES[kind]}{' Z' if z else ''} {s}"), at


@F.pandas_udf(T.StringType())
def wkt(x: pd.Series) -> pd.Series:
    return x.map(lambda b: None if b is None else to_wkt(bytes(b)))
