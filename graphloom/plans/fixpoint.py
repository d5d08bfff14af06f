"""Transitive closure by rounds; checkpoints in the shared folder cut the lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    elif folder and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (a, b) with a path of one edge or more, by doubling: each round joins the paths found so far."""
    paths = checkpointed(edges.select("a", "b").distinct())
    n = paths.count()
    while True:
        x, y = paths.select("a", F.col("b").alias("m")), paths.select(F.col("a").alias("m"), "b")
        paths = checkpointed(paths.union(x.join(y, "m").select("a", "b")).distinct())
        if (now := paths.count()) == n:
            return paths
        n = now


def reached(edges: DataFrame, start: Column) -> DataFrame:
    """The pairs (start, b) with a path of one edge or more: each round follows the edges of the nodes found last."""
    edges = checkpointed(edges.select("a", "b").distinct())
    found = checkpointed(edges.where(F.col("a") == start).select("b").distinct())
    last, n = found, found.count()
    while n:
        step = last.select(F.col("b").alias("a")).join(edges, "a").select("b").distinct()
        last = checkpointed(step.join(found, "b", "left_anti"))
        n = last.count()
        found = checkpointed(found.union(last)) if n else found
    return found.select(start.alias("a"), "b")
