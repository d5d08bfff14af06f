"""JSON and XML documents as rows.

An iterator picks records; references are read inside each record, and a
reference with several values gives a row for each, so that references
multiply within a record but never across records. Documents are parsed in
Arrow batches, one row a document; only the referenced values come back.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

_STEP = re.compile(r"""\.\.(?P<deep>[\w-]+|\*)|\.(?P<name>[^.\[\]()]+)|\[\s*(?P<any>\*)\s*\]|\[\s*(?P<index>-?\d+)\s*\]|\[\s*(?P<from>-?\d*)\s*:\s*(?P<to>-?\d*)\s*\]|\[\s*(['"])(?P<key>.*?)\7\s*\]|\[\?\((?P<filter>.*?)\)\]|\.\((?P<pick>[^)]*)\)""")


def path_steps(path: str) -> list[tuple[str, Any]]:
    """Steps of a JSONPath: name, any, index, slice, deep, filter."""
    p = path.strip()
    p = p[1:] if p.startswith("$") else "." + p
    steps, at = [], 0
    while at < len(p):
        m = _STEP.match(p, at)
        if not m:
            raise ValueError(f"can't read the path {path!r} at {p[at:]!r}")
        at = m.end()
        if m["deep"]:
            steps.append(("deep", m["deep"]))
        elif m["any"] or m["name"] == "*":
            steps.append(("any", None))
        elif m["name"] is not None:
            steps.append(("name", m["name"]))
        elif m["index"] is not None:
            steps.append(("index", int(m["index"])))
        elif m["key"] is not None:
            steps.append(("name", m["key"]))
        elif m["filter"] is not None:
            steps.append(("filter", _condition(m["filter"])))
        elif m["pick"] is None:
            steps.append(("slice", (int(m["from"]) if m["from"] else None, int(m["to"]) if m["to"] else None)))
    return steps


def _condition(text: str) -> tuple[list, str, Any]:
    m = re.fullmatch(r"""\s*@((?:\.[\w-]+|\[['"].*?['"]\])*)\s*(?:(==|=|!=|<=|>=|<|>)\s*('.*?'|".*?"|[^\s]+))?\s*""", text)
    if not m:
        raise ValueError(f"can't read the condition {text!r}")
    value = None if m[3] is None else m[3][1:-1] if m[3][0] in "'\"" else json.loads(m[3])
    return path_steps("$" + m[1]), m[2] or "", value


def _holds(x: Any, test: tuple[list, str, Any]) -> bool:
    steps, op, value = test
    found = list(walk(x, steps))
    if not op:
        return bool(found)
    for f in found:
        try:
            if {"==": f == value, "=": f == value, "!=": f != value}.get(op) or op in ("<", "<=", ">", ">=") and {"<": f < value, "<=": f <= value, ">": f > value, ">=": f >= value}[op]:
                return True
        except TypeError:
            continue
    return False


def walk(x: Any, steps: list[tuple[str, Any]]) -> Iterator[Any]:
    if not steps:
        yield x
        return
    (kind, arg), rest = steps[0], steps[1:]
    if kind == "name" and isinstance(x, dict):
        if arg in x:
            yield from walk(x[arg], rest)
    elif kind in ("any", "filter"):
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            if kind == "any" or _holds(y, arg):
                yield from walk(y, rest)
    elif kind == "index" and isinstance(x, list):
        if -len(x) <= arg < len(x):
            yield from walk(x[arg], rest)
    elif kind == "slice" and isinstance(x, list):
        for y in x[slice(*arg)]:
            yield from walk(y, rest)
    elif kind == "deep":
        if isinstance(x, dict):
            for k, y in x.items():
                if arg in ("*", k):
                    yield from walk(y, rest)
                yield from walk(y, steps)
        elif isinstance(x, list):
            for y in x:
                yield from walk(y, steps)


def _texts(x: Any) -> list[str]:
    """Leaf texts of a value; lists give one each; objects have none."""
    if isinstance(x, list):
        return [t for y in x for t in _texts(y)]
    if x is None or isinstance(x, dict):
        return []
    if isinstance(x, bool):
        return ["true" if x else "false"]
    if isinstance(x, float):
        return [str(x)]
    return [str(x)]


def reference_values(record: Any, ref: str, steps: list) -> list[str]:
    if isinstance(record, dict) and ref in record:
        return _texts(record[ref])
    out: list[str] = []
    todo = [(record, list(steps))]
    while todo:  # dotted names step into each element of a list
        x, left = todo.pop(0)
        if left and isinstance(x, list) and left[0][0] == "name":
            todo = [(y, left) for y in x] + todo
        elif left and left[0][0] == "any" and isinstance(x, list):
            continue  # inside a reference, .* is for members of an object
        elif left:
            todo = [(y, left[1:]) for y in walk(x, left[:1])] + todo
        else:
            out += _texts(x)
    return out


def _emit(docs: DataFrame, refs: list[str], records) -> DataFrame:
    """Rows of the product of each record's values by reference; a reference without values is null."""
    names = refs or ["_one"]
    schema = pa.schema([(r, pa.string()) for r in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for values in records(text):
                    rows += itertools.product(*(v or [None] for v in values)) if refs else [("1",)]
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)

    return docs.mapInArrow(run, ", ".join(f"`{n}` string" for n in names))


def json_rows(docs: DataFrame, iterator: str, refs: list[str]) -> DataFrame:
    steps = path_steps(iterator)
    read = [(r, path_steps("$." + r if not r.startswith("$") else r)) for r in refs]

    def records(text: str) -> Iterator[list[list[str]]]:
        for record in walk(json.loads(text), steps):
            if isinstance(record, list) and not any(k == "any" for k, _ in steps[-1:]):
                for y in record:
                    yield [reference_values(y, r, s) for r, s in read]
            else:
                yield [reference_values(record, r, s) for r, s in read]

    return _emit(docs, refs, records)


def xml_rows(docs: DataFrame, iterator: str, refs: list[str]) -> DataFrame:
    """Iterators and references are paths of element names, * and .., with [n] and [@a='v'] tests and a final @attribute or text()."""

    def records(text: str) -> Iterator[list[list[str]]]:
        import io
        import xml.etree.ElementTree as ET

        spaces: dict[str, str] = {}
        root = None
        for event, x in ET.iterparse(io.BytesIO(text.encode()), events=("start-ns", "start", "end")):
            if event == "start-ns":
                spaces.setdefault(x[0], x[1])
            elif event == "start" and root is None:
                root = x
        parents = {c: p for p in root.iter() for c in p}
        named = {k: v for k, v in spaces.items() if k}

        def find(node: ET.Element, path: str) -> list[ET.Element]:
            path = path.strip("/") if not path.startswith("//") else "." + path
            while path.startswith(".."):
                node, path = parents.get(node, node), path[2:].lstrip("/")
            return [node] if path in ("", ".") else node.findall(path, named)

        if iterator.startswith("//"):
            found = root.findall("." + iterator, named)
            name = iterator[2:]
            found = ([root] if root.tag == name else []) + found
        elif not iterator.startswith("/"):
            found = find(root, iterator)
        else:
            head, _, rest = iterator.strip("/").partition("/")
            tag = re.sub(r"\[.*", "", head)
            prefix, _, own = tag.rpartition(":")
            full = "{" + named[prefix] + "}" + own if prefix in named and prefix else tag
            found = [] if head and tag != "*" and full not in (root.tag, root.tag.rpartition("}")[2]) else find(root, rest)
        for node in found:
            row = []
            for r in refs:
                path, at, attribute = r.partition("@")
                values: list[str] = []
                for n in find(node, re.sub(r"/?text\(\)$", "", path)):
                    if at:
                        prefix, _, own = attribute.rpartition(":")
                        v = n.get("{" + named[prefix] + "}" + own if prefix in named else attribute)
                    else:
                        v = n.text if len(n) == 0 else (n.text or "").strip() or None
                    if v is not None:
                        values.append(v)
                row.append(values)
            yield row

    return _emit(docs, refs, records)
