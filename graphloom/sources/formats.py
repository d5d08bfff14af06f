"""Python data sources for formats that Spark does not read: one partition a file, read on an executor."""

from __future__ import annotations

import glob
import os
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTRA = {"feather": "graphloom_file", "stata": "graphloom_file", "sas": "graphloom_file", "spss": "graphloom_file", "excel": "graphloom_file", "ods": "graphloom_file", "shapefile": "graphloom_file"}


def _name(column: str) -> str:
    n = 0
    for c in column:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_xlsx(path: str) -> list[list[str | None]]:
    """The first sheet's cells as texts."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter("{%s}t" % ns["m"])) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        first = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))[0]
        rows = []
        for row in ET.fromstring(z.read(first)).iter("{%s}row" % ns["m"]):
            cells: list[str | None] = []
            for c in row.findall("m:c", ns):
                i = _name(re.match(r"[A-Z]+", c.get("r", "A"))[0]) if c.get("r") else len(cells)
                cells += [None] * (i + 1 - len(cells))
                v, inline = c.find("m:v", ns), c.find("m:is", ns)
                if inline is not None:
                    cells[i] = "".join(t.text or "" for t in inline.iter("{%s}t" % ns["m"]))
                elif v is not None and v.text is not None:
                    kind = c.get("t")
                    cells[i] = shared[int(v.text)] if kind == "s" else ("true" if v.text == "1" else "false") if kind == "b" else v.text
            rows.append(cells)
    return rows


def sheet_ods(path: str) -> list[list[str | None]]:
    t, x = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            root = ET.fromstring(z.read("content.xml"))
    else:
        root = ET.parse(path).getroot()
    rows = []
    for row in next(root.iter(t + "table")).iter(t + "table-row"):
        cells: list[str | None] = []
        for c in row:
            value = "\n".join("".join(p.itertext()) for p in c.iter(x + "p")) or None
            again = int(c.get(t + "number-columns-repeated", "1"))
            if value is None and again > 1000:
                break
            cells += [value] * again
        if any(v is not None for v in cells):
            rows.append(cells)
    return rows


def shapes(path: str) -> tuple[list[str], list[list[str | None]]]:
    """Attributes of the .dbf and geometry of the .shp beside it, as WKT."""
    with open(os.path.splitext(path)[0] + ".dbf", "rb") as f:
        dbf = f.read()
    n, head, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    rows: list[list[str | None]] = []
    for i in range(n):
        at, row = head + i * size + 1, []
        for _, width in fields:
            row.append(dbf[at : at + width].decode("utf-8", "replace").strip() or None)
            at += width
        rows.append(row)
    with open(path, "rb") as f:
        shp = f.read()
    at, geometry = 100, []
    num = lambda v: str(int(v)) if v == int(v) else repr(v)
    while at + 8 <= len(shp):
        (words,) = struct.unpack_from(">I", shp, at + 4)
        (kind,) = struct.unpack_from("<I", shp, at + 8)
        body = at + 12
        if kind in (1, 11, 21):
            geometry.append("POINT (%s)" % " ".join(map(num, struct.unpack_from("<2d", shp, body))))
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack_from("<2I", shp, body + 32)
            starts = [*struct.unpack_from(f"<{parts}I", shp, body + 40), points]
            xy = struct.unpack_from(f"<{2 * points}d", shp, body + 40 + 4 * parts)
            rings = ["(" + ", ".join(f"{num(xy[2 * j])} {num(xy[2 * j + 1])}" for j in range(a, b)) + ")" for a, b in zip(starts, starts[1:], strict=False)]
            line = kind in (3, 13, 23)
            geometry.append((f"LINESTRING {rings[0]}" if parts == 1 else f"MULTILINESTRING ({', '.join(rings)})") if line else f"POLYGON ({', '.join(rings)})")
        elif kind in (8, 18, 28):
            (points,) = struct.unpack_from("<I", shp, body + 32)
            xy = struct.unpack_from(f"<{2 * points}d", shp, body + 36)
            geometry.append("MULTIPOINT (" + ", ".join(f"({num(xy[2 * j])} {num(xy[2 * j + 1])})" for j in range(points)) + ")")
        else:
            geometry.append(None)
        at += 8 + 2 * words
    return [f for f, _ in fields] + ["geometry"], [r + [g] for r, g in zip(rows, geometry, strict=True)]


def table(path: str, kind: str) -> tuple[list[str], Iterator[tuple]]:
    """Column names, and rows of texts."""
    if kind in ("excel", "ods"):
        rows = sheet_xlsx(path) if kind == "excel" else sheet_ods(path)
        head = [str(x) for x in rows[0]] if rows else []
        return head, (tuple((r + [None] * len(head))[: len(head)]) for r in rows[1:])
    if kind == "shapefile":
        head, rows = shapes(path)
        return head, (tuple(r) for r in rows)
    import pandas as pd

    if kind == "feather":
        from pyarrow import feather

        frame = feather.read_feather(path, use_threads=False)
    elif kind == "stata":
        frame = pd.read_stata(path, convert_dates=False, convert_categoricals=False, convert_missing=False, preserve_dtypes=False)
    elif kind == "sas":
        frame = pd.read_sas(path, encoding="utf-8")
    else:
        frame = pd.read_spss(path, convert_categoricals=False)
    text = lambda v: None if v is None or v != v else str(v)
    return list(map(str, frame.columns)), (tuple(map(text, r)) for r in frame.itertuples(index=False))


class _Files(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options["kind"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from table(partition.value, self.kind)[1]


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graphloom_file"

    def schema(self) -> str:
        first = sorted(glob.glob(self.options["path"]))[0]
        return ", ".join(f"`{n}` string" for n in table(first, self.options["kind"])[0])

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options)


class _Sqlite(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.query = options["path"], options["query"]

    def read(self, partition) -> Iterator[tuple]:
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            for row in c.execute(self.query):
                yield tuple(None if v is None else v.hex().upper() if isinstance(v, bytes) else str(v) for v in row)


class SqliteSource(DataSource):
    """A query of an SQLite file; values come as texts."""

    @classmethod
    def name(cls) -> str:
        return "graphloom_sqlite"

    def schema(self) -> str:
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            names = [d[0] for d in c.execute(f"SELECT * FROM ({self.options['query']}) LIMIT 0").description]
        return ", ".join(f"`{n}` string" for n in names)

    def reader(self, schema) -> DataSourceReader:
        return _Sqlite(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSource)
    spark.dataSource.register(SqliteSource)
