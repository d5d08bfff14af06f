"""python -m graphloom config.ini"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .api import KnowledgeGraph


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom", description="Make a knowledge graph from mapped sources.")
    p.add_argument("config", help="INI file")
    p.add_argument("--query", help="a SPARQL query file to answer instead of writing the graph")
    p.add_argument("--single-file", action="store_true")
    p.add_argument("-v", "--version", action="version", version="graphloom 0.1")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    kg = KnowledgeGraph.from_config(spark, a.config)
    if a.query:
        with open(a.query, encoding="utf-8") as f:
            answer = kg.sparql(f.read())
        print("\t".join(answer.columns))
        for row in answer.toLocalIterator():  # a partition at a time
            print("\t".join("" if x is None else str(x) for x in row))
    elif kg.config.kafka_server:
        from .sinks import to_kafka

        to_kafka(kg.quads(), kg.config.kafka_server, kg.config.kafka_topic)
    else:
        print(kg.write(single_file=a.single_file))
    return 0
