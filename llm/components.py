"""Connected components over a table of edges, by minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the least node of its component.

    Each round every label becomes the least one among itself and the
    neighbours' labels, then jumps to its label's label; tables in the shared
    folder cut the lineage. Rounds end when nothing changes: labels only fall,
    and about log(diameter) rounds do for stars and short chains.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = both.join(labels.select("node", "label"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("heard"))
        new = labels.select("node", "label").join(heard, F.col("node") == F.col("a")).select("node", F.least("label", "heard").alias("label"), F.col("label").alias("was"))
        jump = new.select(F.col("node").alias("j"), F.col("label").alias("jumped"))
        old, labels = labels, written(new.join(jump, new["label"] == jump["j"], "left").select("node", F.least("label", F.coalesce("jumped", "label")).alias("label"), "was"))
        free(old)
        if labels.where("label <> was").isEmpty():
            free(both)
            out = labels.select("node", "label")
            out.written_at = labels.written_at  # for whoever frees it
            return out
