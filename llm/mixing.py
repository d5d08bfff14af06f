"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they are
in). The patterns' words flow to the sources' quotas: a pattern's first pass
over its words is cheapest and each further pass dearer (convex cost), so
repeats are spread as thinly as quotas allow. The flow graph has one node
per pattern and source and is solved on the driver; only that summary, never
documents, is gathered. Each pattern's flow then picks documents in a seeded
order: whole passes for all, and one more for the first ones of that order,
found from sums over hash buckets so that no source meets in one task:
only the bucket in which the last pass ends is put in order.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import base, documents, n_words, written

WEIGHTS = (5, 2, 1)
BUCKETS = 1024
FIXED_SEED = 17


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """share x all words, by weight in code-point order with null last; a source stops at most x its size, the excess is reshared."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: list(map(ord, s))) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    out: dict[str | None, float] = {}
    free = list(names)
    while free:
        left, sum_w = total - sum(out.values()), sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / sum_w > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / sum_w for s in free}
        out |= {s: float(most * sizes[s]) for s in full}
        free = [s for s in free if s not in out]
    return out


def flow(patterns: dict[tuple, int], quotas: dict[str | None, float], passes: int = 2) -> dict[tuple, int]:
    """Words taken of each pattern: a min-cost flow by successive shortest paths with potentials.

    Edges: start -> pattern (one of the pattern's size for each pass, pass i
    costs i), pattern -> each of its sources (free), source -> end (quota).
    """
    start, end = ("start",), ("end",)
    cap: dict[tuple, list] = defaultdict(list)  # node -> [to, room, cost, index of the reverse edge]

    def edge(a, b, room, cost):
        cap[a].append([b, room, cost, len(cap[b])])
        cap[b].append([a, 0, -cost, len(cap[a]) - 1])

    for p, size in patterns.items():
        for i in range(passes):
            edge(start, ("p", p), size, i)
        for s in p:
            edge(("p", p), ("s", s), passes * size, 0)
    for s, q in quotas.items():
        edge(("s", s), end, round(q), 0)
    number = {n: i for i, n in enumerate(list(cap))}
    at: dict[tuple, int] = defaultdict(int)
    while True:
        dist, via, heap = {start: 0}, {}, [(0, 0, start)]
        while heap:
            d, _, n = heapq.heappop(heap)
            if d > dist[n]:
                continue
            for i, (b, room, cost, _) in enumerate(cap[n]):
                if room > 0 and (x := d + cost + at[n] - at[b]) < dist.get(b, 1 << 60):
                    dist[b], via[b] = x, (n, i)
                    heapq.heappush(heap, (x, number[b], b))
        if end not in dist:
            break
        for n in number:
            at[n] += dist.get(n, dist[end])
        path, n = [], end
        while n != start:
            n, i = via[n]
            path.append(cap[n][i])
        moved = min(e[1] for e in path)
        for e in path:
            e[1] -= moved
            cap[e[0]][e[3]][1] += moved
    return {p: sum(patterns[p] - e[1] for e in cap[start] if e[0] == ("p", p)) for p in patterns}


def mix(docs: DataFrame, members: Column, size: Column, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, passes: int = 2, seed: int = FIXED_SEED) -> DataFrame:
    """docs plus ``mix_size``, ``mix_members``, ``mix_source_size``, ``mix_target`` and ``mix_copies`` (0 to ``passes``).

    ``members``: array of source names, null one allowed as an element; a
    source's size counts all its documents, a document in two sources in both.
    Empty or null arrays count as the null source. Documents without words are
    taken in as many passes as all of their pattern. Copies follow a seeded
    hash of doc_id, text and the column ``rid`` where docs has one, so reruns
    over the same table agree; without it equal rows are taken alike.
    ``docs`` may have any columns but those named here.
    """
    spark = docs.sparkSession
    m = F.array_sort(F.array_distinct(members))
    m = F.when(F.size(m) > 0, m).otherwise(F.array(F.lit(None).cast("string")))
    own = [F.col("rid")] if "rid" in docs.columns else []  # equal rows have places of their own in the order
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), *own)
    keyed = docs.select("*", m.alias("mix_members"), key.alias("mix_key")).withColumn("mix_bucket", F.shiftrightunsigned("mix_key", 54).cast("int"))
    words = F.coalesce(size, F.lit(0)).cast("long")
    sums = written(keyed.groupBy("mix_members", "mix_bucket").agg(F.sum(words).alias("w")))  # BUCKETS rows for each pattern at most
    patterns = {tuple(r[0]): r[1] for r in sums.groupBy("mix_members").agg(F.sum("w").alias("w")).collect()}
    source: dict[str | None, int] = defaultdict(int)
    for p, w in patterns.items():
        for s in p:
            source[s] += w
    quota = targets(dict(source), weights, share, float(passes))
    taken = flow(patterns, quota, passes)
    plan = [
        (list(p), taken[p] // w if w else 0, taken[p] % w if w else 0, sum(source[s] for s in p), float(sum(quota[s] for s in p)))
        for p, w in patterns.items()
    ]
    name = F.to_json(F.struct("mix_members"))
    plan_df = spark.createDataFrame(plan, "mix_members array<string>, mix_full long, mix_rest long, mix_source_size long, mix_target double")
    plan_df = plan_df.select(name.alias("mix_j"), "mix_full", "mix_rest", "mix_source_size", "mix_target")
    # the bucket in which a pattern's last pass ends, and the key of the last document that it takes there
    upto = F.sum("w").over(Window.partitionBy("mix_j").orderBy("mix_bucket"))
    ends = sums.select(name.alias("mix_j"), "mix_bucket", "w").withColumn("upto", upto).join(plan_df.select("mix_j", "mix_rest"), "mix_j")
    ends = ends.where((F.col("mix_rest") > 0) & (F.col("upto") > F.col("mix_rest")) & (F.col("upto") - F.col("w") <= F.col("mix_rest")))
    ends = ends.groupBy("mix_j").agg(F.min("mix_bucket").alias("mix_border"), F.min(F.col("mix_rest") - F.col("upto") + F.col("w")).alias("mix_room"))
    near = keyed.select("*", name.alias("mix_j")).join(F.broadcast(ends), "mix_j")  # a row for each pattern
    near = near.where(F.col("mix_bucket") == F.col("mix_border")).select("mix_j", "mix_key", "mix_room", words.alias("w"))
    near = near.groupBy("mix_j", "mix_key", "mix_room").agg(F.sum("w").alias("w"))
    run = F.sum("w").over(Window.partitionBy("mix_j").orderBy("mix_key"))
    last = near.withColumn("run", run).where(F.col("run") - F.col("w") / 2 <= F.col("mix_room")).groupBy("mix_j").agg(F.max("mix_key").alias("mix_last"))
    plan_df = written(plan_df.join(ends, "mix_j", "left").join(last, "mix_j", "left").drop("mix_room", "mix_rest"))
    once = (F.col("mix_bucket") < F.col("mix_border")) | ((F.col("mix_bucket") == F.col("mix_border")) & (F.col("mix_key") <= F.col("mix_last")))
    out = keyed.select("*", name.alias("mix_j"), words.alias("mix_size")).join(F.broadcast(plan_df), "mix_j")
    out = out.withColumn("mix_copies", F.col("mix_full") + F.coalesce(once, F.lit(False)).cast("long"))
    return out.drop("mix_j", "mix_key", "mix_bucket", "mix_full", "mix_border", "mix_last")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base(documents(spark, sf_dir), "source")
    mixed = mix(docs, F.array(F.col("source").cast("string")), n_words(F.col("text")))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
        F.col("source"),
    )
