"""Where graphs go: N-Triples or N-Quads text, a directory by mapping partition, Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import MappingError


def statements(quads: DataFrame, with_graph: bool = True) -> DataFrame:
    """One statement a row, with its final dot."""
    return quads.select(_line(with_graph).alias("value"))


def write(kg, path: str = "", single_file: bool = False) -> str:
    """Write as the configuration says. Text folders hold a file a task; ``single_file`` gathers them into one."""
    c = kg.config
    if c.output_format == "JELLY":
        raise MappingError("the JELLY format needs a writer that is not installed")
    named = c.output_format == "N-QUADS"
    if c.output_dir and not path:
        grouped = kg.engine.grouped(kg.rules)
        lines = grouped.select(_line(named).alias("value"), "mapping_partition")
        lines.write.mode("overwrite").partitionBy("mapping_partition").text(c.output_dir)
        return c.output_dir
    out = path or c.output_file
    lines = statements(kg.quads(), named)
    if not named:
        lines = lines.dropDuplicates() if any(r.graph is not None for r in kg.rules) else lines
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(out)
    return out


def _line(named: bool):
    graph = F.when(F.col("g").isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), F.col("g"))) if named else F.lit("")
    return F.concat("s", F.lit(" "), "p", F.lit(" "), "o", graph, F.lit(" ."))


def to_kafka(quads: DataFrame, servers: str, topic: str) -> None:
    """A record a statement; needs Spark's Kafka connector on the class path."""
    statements(quads).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
