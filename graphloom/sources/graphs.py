"""Property graphs by Cypher, where a driver for them is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import Source


def cypher(spark: SparkSession, source: Source, section: dict[str, str]) -> DataFrame:
    url = section.get("db_url", "")
    if url.startswith(("bolt", "neo4j")):
        from neo4j import GraphDatabase

        with GraphDatabase.driver(url, auth=(section.get("user", ""), section.get("password", ""))) as d:
            records, _, keys = d.execute_query(source.query)
            return spark.createDataFrame([tuple(None if r[k] is None else str(r[k]) for k in keys) for r in records], ", ".join(f"`{k}` string" for k in keys))
    import kuzu

    result = kuzu.Connection(kuzu.Database(url.removeprefix("kuzu://"))).execute(source.query)
    return spark.createDataFrame(result.get_as_df())
