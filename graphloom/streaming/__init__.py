"""Mapping a stream: term construction is stateless, so the same rules run on a streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import KnowledgeGraph
from ..model import MappingError


def quads_of_stream(kg: KnowledgeGraph, watermark: tuple[str, str] | None = None) -> DataFrame:
    """s, p, o, g of rules whose sources are streaming in-memory frames.

    Rules with joins need a static parent. With a watermark (a time column of
    the source, and a delay) duplicates within it are dropped; without, all
    quads are passed on, once for each row that makes them.
    """
    if watermark is None:
        return kg.engine.of(kg.rules)
    column, delay = watermark
    parts = None
    for r in kg.rules:
        if any(t.kind in ("parent", "quoted") and t.joins for t in (r.subject, r.object)):
            raise MappingError("a watermark is for rules without joins")
        refs = kg.engine.columns_of(r)
        df, types = kg.engine.rows(r.source, refs)
        if column not in refs:
            df = kg.engine.sources.read(r.source, [*refs, column]).withWatermark(column, delay)
            df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in refs})
        part = df.select(kg.engine.quad(r, {}, types).alias("q"), F.col(f"`{column}`").alias("at")).select("q.*", "at").where("s is not null and p is not null and o is not null")
        parts = part if parts is None else parts.unionByName(part)
    return parts.dropDuplicatesWithinWatermark(["s", "p", "o", "g"]).drop("at")
