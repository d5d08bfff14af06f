"""Logical sources as DataFrames.

Spark's own readers come first; formats that it lacks are read by Python
data sources (see :mod:`graphloom.sources.formats`), one partition a file.
All reads are lazy, and a caller's select prunes columns down to the scan.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Source


#: names of a section's options, and of the JDBC reader's: with the first four a table is read by many tasks
JDBC_OPTIONS = {
    "db_partition_column": "partitionColumn", "db_lower_bound": "lowerBound", "db_upper_bound": "upperBound", "db_num_partitions": "numPartitions",
    "db_fetch_size": "fetchsize", "db_driver": "driver", "db_user": "user", "db_password": "password",
}


class SourceError(ValueError):
    """A source that can't be read as asked."""


@dataclass
class Sources:
    """Where rules read. ``memory``: named frames, pandas frames, row lists, dicts; ``tables``: views or JDBC by section."""

    spark: SparkSession
    memory: dict[str, object] = field(default_factory=dict)
    sections: dict[str, dict[str, str]] = field(default_factory=dict)
    root: str = ""
    cache: dict = field(default_factory=dict)

    def path(self, location: str) -> str:
        if re.match(r"^[a-z0-9]+://", location) or location.startswith("/") or not self.root:
            return location
        return f"{self.root.rstrip('/')}/{location}"

    def read(self, source: Source, refs: list[str]) -> DataFrame:
        """The source with at least the columns ``refs``, named as the mapping names them."""
        key = (source, tuple(sorted(refs)) if source.kind in ("json", "xml", "http", "memory") else None)
        if key not in self.cache:
            self.cache[key] = self._read(source, refs)
        df = self.cache[key]
        lower: dict[str, list[str]] = {}
        for c in df.columns:
            lower.setdefault(c.lower(), []).append(c)
        out = []
        for r in refs:
            if r in df.columns:
                out.append(F.col(f"`{r}`"))
            elif source.kind in ("table", "query", "memory") and len(lower.get(r.lower(), [])) == 1:
                out.append(F.col(f"`{lower[r.lower()][0]}`").alias(r))  # databases fold names
            else:
                raise SourceError(f"{source.location or source.query!r} has no column {r!r}")
        return df.select(*out) if out else df.select(F.lit(1).alias("_one")).limit(1)

    def _read(self, source: Source, refs: list[str]) -> DataFrame:
        reader: Callable = getattr(self, f"read_{source.kind}", None)
        if reader is not None:
            return reader(source, refs)
        from .formats import EXTRA, register

        if source.kind in EXTRA:
            register(self.spark)
            return self.spark.read.format(EXTRA[source.kind]).option("path", self.path(source.location)).option("kind", source.kind).load()
        raise SourceError(f"no reader for {source.kind} sources")

    # -- Spark's readers

    def read_csv(self, source: Source, refs: list[str], sep: str | None = None) -> DataFrame:
        path = self.path(source.location)
        first = [r[0] for r in self.spark.read.text(path).limit(1).collect()]
        header = first[0] if first else ""
        if sep is None:
            # a comma unless the header shows the references under another delimiter
            marks = (",", ";", "\t", "|")
            sep = next((d for d in marks if (set(refs) <= {x.strip().strip('"') for x in header.split(d)} if refs else d in header)), ",")
        names = next(iter(__import__("csv").reader([header.lstrip("﻿")], delimiter=sep)), [])
        from pyspark.sql import types as T

        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        read = self.spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", self.records_span_lines(path)).option("enforceSchema", True)
        return read.csv(path) if names else self.spark.createDataFrame([], "_none string")

    def records_span_lines(self, path: str) -> bool:
        """A quoted field holds a line break: some line then has an odd number of quotes. Only such files can't be split."""
        value = F.col("value")
        odd = (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 1
        return bool(self.spark.read.text(path).where(value.contains('"') & odd).take(1))

    def read_tsv(self, source: Source, refs: list[str]) -> DataFrame:
        return self.read_csv(source, refs, "\t")

    def read_parquet(self, source: Source, refs: list[str]) -> DataFrame:
        return self.spark.read.parquet(self.path(source.location))

    def read_geoparquet(self, source: Source, refs: list[str]) -> DataFrame:
        """Binary geometry columns (WKB) as WKT."""
        from .geometry import wkt

        df = self.spark.read.parquet(self.path(source.location))
        return df.select(*(wkt(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "binary" else F.col(f"`{f.name}`") for f in df.schema))

    def read_orc(self, source: Source, refs: list[str]) -> DataFrame:
        return self.spark.read.orc(self.path(source.location))

    def read_query(self, source: Source, refs: list[str]) -> DataFrame:
        """SQL over files and registered views: quoted file names become views, double quotes are identifiers."""

        # literals and quoted names are set aside, so that no rule below reads or changes what is in them
        kept: list[str] = []

        def aside(m: re.Match) -> str:
            kept.append(m[0])
            return f"\x00{len(kept) - 1}\x00"

        def given(n: str) -> str:
            return kept[int(n)][1:-1]

        def back(m: re.Match) -> str:
            text = given(m[1])
            return "`" + text.replace('""', '"').replace("`", "``") + "`" if kept[int(m[1])][0] == '"' else "'" + text.replace("''", "\\'") + "'"

        def view(m: re.Match) -> str:
            path = given(m[2])
            if not re.search(r"\.(?:csv|tsv|parquet|json|orc)$", path, re.IGNORECASE):
                return m[0]
            ext = path.rsplit(".", 1)[-1].lower()
            kind = {"csv": "csv", "tsv": "tsv", "parquet": "parquet", "json": "json", "orc": "orc"}[ext]
            name = "file_" + re.sub(r"\W", "_", path)
            df = self.spark.read.json(self.path(path)) if kind == "json" else self._read(Source(kind, path), [])
            df.createOrReplaceTempView(name)
            return f"{m[1]}`{name}`"

        def reader(m: re.Match) -> str:
            options = {k: given(n) for k, n in re.findall(r"(\w+)\s*=\s*\x00(\d+)\x00", m[2])}
            name = "file_" + re.sub(r"\W", "_", given(m[1]))
            self.read_csv(Source("csv", given(m[1])), [], options.get("delim") or options.get("sep") or ",").createOrReplaceTempView(name)
            return f"`{name}`"

        text = re.sub(r"""'(?:[^']|'')*'|"(?:[^"]|"")*\"""", aside, source.query)
        text = re.sub(r"\bread_csv(?:_auto)?\(\s*\x00(\d+)\x00([^)]*)\)", reader, text, flags=re.IGNORECASE)
        # forms of the usual file-query dialect that Spark spells otherwise
        text = re.sub(r"\bjson_extract_string\s*\(", "get_json_object(", text, flags=re.IGNORECASE)
        text = re.sub(r"\bunnest\s*\(", "explode(", text, flags=re.IGNORECASE)
        listed = r"""transform(split(regexp_replace(\1, '^\\\\s*[\\\\[]|[\\\\]]\\\\s*$', ''), '\\\\s*,\\\\s*'), x -> regexp_replace(x, '^[\\\\x22\\\\x27]|[\\\\x22\\\\x27]$', ''))"""
        text = re.sub(r"((?:\w+\([^()]*\))|\w+)::(?:VARCHAR|TEXT)\[\]", listed, text, flags=re.IGNORECASE)
        before = ""
        while before != text:  # one file of a list of files at a time
            before, text = text, re.sub(r"(\b(?:from|join)\s+|\bfrom\b[^()]*?,\s*)\x00(\d+)\x00", view, text, flags=re.IGNORECASE)
        return self.spark.sql(re.sub(r"\x00(\d+)\x00", back, text))

    def read_table(self, source: Source, refs: list[str]) -> DataFrame:
        options = self.sections.get(source.section, {})
        url = options.get("db_url", "")
        if url.startswith("sqlite"):
            from .formats import register

            register(self.spark)
            query = source.query or f'SELECT * FROM "{source.location}"'
            return self.spark.read.format("graphloom_sqlite").option("path", re.sub(r"^sqlite:/*(?=/)|^sqlite:///?", "", url)).option("query", query).load()
        if url:
            jdbc = url if url.startswith("jdbc:") else "jdbc:" + re.sub(r"^(\w+)\+\w+:", r"\1:", os.path.expandvars(url))
            read = self.spark.read.format("jdbc").option("url", jdbc).options(**{new: options[old] for old, new in JDBC_OPTIONS.items() if old in options})
            if source.query and "db_partition_column" in options:  # Spark splits a table by its column, not a query
                return read.option("dbtable", f"({source.query}) graphloom_view").load()
            return (read.option("query", source.query) if source.query else read.option("dbtable", source.location)).load()
        return self.read_query(source, refs) if source.query else self.spark.table(source.location)

    # -- trees

    def read_json(self, source: Source, refs: list[str]) -> DataFrame:
        from .trees import json_rows

        docs = self.spark.read.text(self.path(source.location), wholetext=True)
        return json_rows(docs, source.iterator or "$", refs)

    def read_xml(self, source: Source, refs: list[str]) -> DataFrame:
        from .trees import xml_rows

        docs = self.spark.read.text(self.path(source.location), wholetext=True)
        return xml_rows(docs, source.iterator or "/", refs)

    def read_http(self, source: Source, refs: list[str]) -> DataFrame:
        from .http import fetch
        from .trees import json_rows

        return json_rows(self.spark.createDataFrame([(fetch(source, self.sections.get(source.section, {})),)], "value string"), source.iterator or "$", refs)

    # -- in memory

    def read_memory(self, source: Source, refs: list[str]) -> DataFrame:
        if source.location not in self.memory:
            raise SourceError(f"no in-memory source {source.location!r}")
        x = self.memory[source.location]
        if isinstance(x, DataFrame):
            return x
        if isinstance(x, list | tuple) and (not x or not isinstance(x[0], dict)):
            return self.spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in x], ", ".join(f"`{r}` string" for r in refs))
        if isinstance(x, dict | list | str):
            import json

            from .trees import json_rows

            return json_rows(self.spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),)], "value string"), source.iterator or "$", refs)
        return self.spark.createDataFrame(x)

    def read_cypher(self, source: Source, refs: list[str]) -> DataFrame:
        from .graphs import cypher

        return cypher(self.spark, source, self.sections.get(source.section, {}))
