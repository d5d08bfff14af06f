"""Calls compile to Column expressions: no row is ever handed to Python, but for declared UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Call, TermMap
from ..terms import double_text


class FunctionError(ValueError):
    """An unknown function or missing argument."""


@dataclass
class Value:
    """A result. kind: text, int, double, bool, list (of texts), ints (list of numbers), time."""

    col: Column
    kind: str = "text"
    const: str | None = None  # the text, where it is the same for all rows

    def text(self) -> Column:
        if self.kind == "double":
            return double_text(self.col)
        if self.kind == "list":
            return F.concat(F.lit("["), F.array_join(F.transform(self.col, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
        if self.kind == "ints":
            return F.concat(F.lit("["), F.array_join(self.col.cast("array<string>"), ", "), F.lit("]"))
        return self.col if self.kind == "text" else self.col.cast("string")


class Args:
    def __init__(self, given: dict[str, list[Value]], name: str, compat: bool) -> None:
        self.given, self.name, self.compat = given, name, compat

    def value(self, *names: str) -> Value:
        for n in names:
            if self.given.get(n):
                return self.given[n][0]
        raise FunctionError(f"{self.name} needs {names[0]}")

    def has(self, name: str) -> bool:
        return bool(self.given.get(name))

    def text(self, *names: str) -> Column:
        return self.value(*names).text()

    def constant(self, name: str) -> str:
        """The text of a constant argument: patterns are part of the plan."""
        v = self.value(name).const
        if v is None:
            raise FunctionError(f"{self.name} needs a constant {name}")
        return v

    def opt(self, name: str) -> Column | None:
        return self.given[name][0].text() if self.has(name) else None

    def number(self, *names: str) -> Column:
        v = self.value(*names)
        return v.col.cast("double") if v.kind in ("int", "double") else v.text().try_cast("double")

    def whole(self, *names: str) -> Column:
        v = self.value(*names)
        return v.col.cast("long") if v.kind == "int" else F.coalesce(v.text().try_cast("long"), v.text().try_cast("double").try_cast("long"))

    def is_whole(self, name: str) -> Column:
        v = self.value(name)
        return F.lit(True) if v.kind == "int" else F.lit(False) if v.kind == "double" else v.text().rlike(r"^[+-]?\d+$")

    def list(self, name: str) -> Column:
        """A list argument: a list value, repeated inputs, or text that is written as a list."""
        values = self.given.get(name) or []
        if not values:
            raise FunctionError(f"{self.name} needs {name}")
        if len(values) > 1:
            return F.array(*(v.text() for v in values))
        v = values[0]
        if v.kind == "list":
            return v.col
        if v.kind == "ints":
            return v.col.cast("array<string>")
        return F.when(F.trim(v.text()).rlike(r"^\[.*\]$"), F.from_json(F.translate(v.text(), "'", '"'), "array<string>"))

    def is_list(self, name: str) -> bool:
        values = self.given.get(name) or []
        return len(values) > 1 or bool(values) and values[0].kind in ("list", "ints")


BUILT_IN: dict[str, Callable[[Args], Value]] = {}
UDFS: dict[str, tuple[Callable, dict[str, str]]] = {}


def key_of(iri: str) -> str:
    """The last path segment, fragment included: the file and name, whoever hosts them."""
    return iri.strip().rstrip("/").rsplit("/", 1)[-1]


def fn(*keys: str):
    def put(build: Callable[[Args], Value]) -> Callable[[Args], Value]:
        for k in keys:
            BUILT_IN[k] = build
        return build

    return put


def udf(fun_id: str, **parameters: str):
    """Declare a Python function: its IRI, and the parameter IRI of each argument. It runs over Arrow batches."""

    def put(f: Callable) -> Callable:
        UDFS[fun_id] = (f, parameters)
        return f

    return put


def load_udfs(path: str) -> None:
    """Run a file of @udf declarations; ``udf`` is defined there. The file must be trusted, as any code is."""
    with open(path, encoding="utf-8") as f:
        exec(compile(f.read(), path, "exec"), {"udf": udf})  # noqa: S102


class Functions:
    """Compiles calls. ``explode`` tells that the outermost result is a list, whose elements become rows."""

    def __init__(self, compat: bool = False) -> None:
        self.compat = compat

    def value(self, call: Call, column: Callable[[str], Column]) -> Value:
        given: dict[str, list[Value]] = {}
        for name, t in call.inputs:
            given.setdefault(name, []).append(self.argument(t, column))
        build = BUILT_IN.get(key_of(call.function))
        if call.function in UDFS:
            return self.declared(call.function, given)
        if build is None:
            raise FunctionError(f"unknown function {call.function}")
        return build(Args(given, key_of(call.function), self.compat))

    def argument(self, t: TermMap, column: Callable[[str], Column]) -> Value:
        if t.kind == "function":
            return self.value(t.value, column)
        from ..frontend.mapping import template_parts

        if t.kind == "constant":
            return Value(F.lit(str(t.value)), "text", str(t.value))
        if t.kind == "reference":
            return Value(column(str(t.value)))
        return Value(F.concat(*(column(x) if r else F.lit(x) for r, x in template_parts(str(t.value)))))

    def declared(self, iri: str, given: dict[str, list[Value]]) -> Value:
        f, parameters = UDFS[iri]
        last = {re.split(r"[#/]", p)[-1]: a for a, p in parameters.items()}
        names, columns = [], []
        for p, values in given.items():
            if p not in last:
                raise FunctionError(f"{iri} has no parameter {p}")
            names.append((last[p], len(values) > 1))
            columns.append(F.array(*(v.text() for v in values)) if len(values) > 1 else values[0].col if values[0].kind == "list" else values[0].text())

        def run(*cols):
            import pandas as pd

            out = []
            for row in zip(*cols, strict=True):
                if any(x is None for x in row):  # a missing reference makes no term
                    out.append(None)
                    continue
                try:
                    r = f(**{n: (list(x) if many else x) for (n, many), x in zip(names, row, strict=True)})
                except Exception as e:  # noqa: BLE001
                    raise FunctionError(f"{iri}: {e}") from e
                out.append(None if r is None else [str(x) for x in r] if isinstance(r, list | tuple) else [str(r)])
            return pd.Series(out)

        made = F.pandas_udf(run, T.ArrayType(T.StringType()))(*columns or [F.lit("")])
        return Value(made, "list")

    def explode(self, call: Call) -> bool:
        return call.function in UDFS or self.value(call, lambda r: F.lit("")).kind in ("list", "ints")
