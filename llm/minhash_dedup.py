"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Shingles are five words, weighted by their counts. Each shingle is a Poisson
process of arrivals with its weight as rate; each arrival picks a register,
and a register keeps the shingle that arrives first. A shingle stops as soon
as its next arrival is later than every register's, so a document costs about
one arrival a shingle plus m log m. Two documents agree in a register with
their probability Jaccard similarity; bands of registers give candidates,
which are verified exactly on the texts.

Equal word sequences are one class from the start. A bucket's texts are first
compared with one of them (a star, not all pairs) and linked ones joined into
classes; further rounds do so with another leader, for buckets that still
hold several classes. Only texts of one bucket that are in different classes
even then are all compared, so no link between different texts is lost and no
group of copies is expanded into pairs. Pairs are also held against parity
sketches of their shingles before any text is read: two sketches differ in at
most as many bits as the sets differ in shingles, and that number is bounded
for any pair that is similar enough (:func:`most_apart`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import base, bitmap_of, documents, free, pieces, written
from .components import components
from .hashing import WordHashes, scramble, windows, words_of

BANDS, ROWS = 20, 4
ROUNDS, LEADERS = 2, 8  # of further stars, and other leaders of a bucket in each
EARLIER = 4  # bands
LANES = 32  # longs of a parity sketch
HELD = 2_000_000  # shingles that a verifying task keeps
FIXED_SEED = np.uint64(0xA24BAED4963EE407)


def shingles(h: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts; a text of fewer words is one shingle."""
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.unique(windows(h, min(size, len(h))), return_counts=True)


def signature(keys: np.ndarray, weights: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """The m registers: 32 bits of the shingle that arrives first at each."""
    best, who = np.full(m, np.inf), np.zeros(m, np.uint64)
    time, drawn = np.zeros(len(keys)), 0
    active = np.arange(len(keys))
    while len(active):
        block = max(1, 2 * m // len(active))  # several arrivals at once where few shingles are left
        k = keys[active][:, None]
        step = (np.arange(drawn, drawn + block, dtype=np.uint64) + np.uint64(1)) * FIXED_SEED
        u = scramble(k ^ step[None, :])
        gaps = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[active][:, None]
        at = time[active][:, None] + np.cumsum(gaps, axis=1)
        register = (scramble(u + FIXED_SEED) % np.uint64(m)).astype(np.int64)
        t, r, e = at.ravel(), register.ravel(), np.repeat(active, block)
        ok = np.flatnonzero(t < best[r])
        ok = ok[np.argsort(-t[ok], kind="stable")]  # the earliest is written last
        best[r[ok]], who[r[ok]] = t[ok], keys[e[ok]]
        time[active] = at[:, -1]
        drawn += block
        active = active[time[active] < best.max()]
    return (who >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketch(keys: np.ndarray) -> np.ndarray:
    """For each of 64 x LANES hash values, the parity of the number of shingles that have it."""
    odd = np.bincount((scramble(keys ^ FIXED_SEED) % np.uint64(64 * LANES)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard: over common d, the sum of 1 / sum over e of max(x_e / x_d, y_e / y_d)."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    sum_x, sum_y = np.append(np.cumsum(x[::-1])[::-1], 0.0), np.insert(np.cumsum(y), 0, 0.0)
    cut = np.searchsorted(ratio, ratio, side="right")  # beyond it x_e / x_d is the larger
    return float((1.0 / ((sum_x[cut] + only_x) / x + (sum_y[cut] + only_y) / y)).sum())


def most_apart(x: Column, y: Column, again: Column, t: float) -> Column:
    """Shingles that only one of two texts may have at similarity t: x and y shingles with repeats, ``again`` of them repeats in their text.

    Let o be the occurrences of such shingles, A and B the others' in each text, R the repeats. A common
    shingle's term in the similarity is at most its count in one text over that text's total plus the
    other text's part of o (the text chosen by the larger count), so it is at most (min(A, B) + R) /
    (min(A, B) + o), and min(A, B) is at most (x + y - o) / 2. Without repeats this is the bound of plain
    Jaccard. For texts with many repeats there is another one. The terms are at most max(x_d, y_d) / S,
    S being the sum of max(x_e, y_e) over all shingles, so the similarity is at most 1 - o / S. It is at
    most 1 less the total variation distance, too, which bounds the sum D of |x_e - y_e| by
    2 (1 - t) min(x, y) + |x - y|, and S is (x + y + D) / 2.
    """
    return F.least(((1 - t) * (x + y) + 2 * again) / (1 + t), (1 - t) * (F.greatest(x, y) + (1 - t) * F.least(x, y)))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs' doc_id, text and rid plus ``class_rid`` (the rid of the class's first row), ``class_id`` (its doc_id) and ``class_size``.

    First is by doc_id, null last, then row. Texts without words (null, empty)
    are a class each. Equal rows are one class. Very long texts are compared
    whole. ``docs`` comes from :func:`llm.common.base`; of its other columns,
    those with the three names above are replaced.
    """
    docs = docs.drop("class_rid", "class_id", "class_size")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            content, sigs, total, again, parity = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                content.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")) if words else None)
                keys, weights = shingles(hashes.of(words), size)
                sigs.append(signature(keys, weights, bands * rows) if words else None)
                total.append(int(weights.sum()))
                again.append(int(weights.sum()) - len(keys))
                parity.append(sketch(keys) if words else None)
            columns = [batch.column("rid"), batch.column("doc_id"), pa.array(content, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(total, pa.int32()), pa.array(again, pa.int32()), pa.array(parity, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "content", "sig", "total", "again", "parity"])

    signed = docs.select("rid", "doc_id", "text").mapInArrow(sign, "rid long, doc_id long, content binary, sig array<int>, total int, again int, parity array<bigint>")
    signed = written(signed.where("content is not null"))

    def sketches(p: str) -> DataFrame:
        """Columns that Spark knows to have no nulls: the condition on two sketches is then short enough to be compiled."""
        whole = lambda x: F.coalesce(x, F.lit(0))
        return signed.select(F.col("rid").alias(p), whole(F.col("total")).alias(f"n{p}"), whole(F.col("again")).alias(f"again{p}"), *(whole(F.get("parity", F.lit(i))).alias(f"{p}{i}") for i in range(LANES)))

    def plausible() -> Column:
        """Of a pair (a, b) with both sketches: the similarity may reach the threshold."""
        apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(LANES)))
        return apart <= most_apart(F.col("na"), F.col("nb"), F.col("againa") + F.col("againb"), threshold) + 1e-6

    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))
    first = signed.groupBy("content").agg(F.min(place).alias("first"))
    member = written(signed.select("rid", "content").join(first, "content").select("rid", F.col("first.rid").alias("rep")))
    reps = signed.join(member.where("rid = rep").select("rid"), "rid").select("rid", "sig")
    buckets = F.array([F.xxhash64(F.lit(i), F.slice("sig", i * rows + 1, rows)) for i in range(bands)])
    banded = reps.select("rid", F.posexplode(buckets).alias("band", "h"))
    sizes = banded.groupBy("h").agg(F.min("rid").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    banded = written(banded.join(sizes, "h").select("h", "band", "rid", "least"))  # only buckets with two texts or more

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, room = WordHashes(), {}, 0

        def shingled(rid: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            """From a memory of HELD shingles at most, beside those of a single text."""
            nonlocal room
            if rid not in held:
                held[rid] = shingles(hashes.of(words_of(text)), size)
                room += len(held[rid][0]) + 64
                while room > HELD and len(held) > 2:
                    room -= len(held.pop(next(iter(held)))[0]) + 64
            return held[rid]

        for batch in pieces(pieces(batches, column="ta"), column="tb"):
            keep = []
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                first = shingled(a, ta)
                keep.append(similarity(first, shingled(b, tb)) >= threshold - 1e-12)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def links(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("rid"))
        texts = docs.select("rid", "text").where(bitmap_of(wanted, "rid"))
        with_b = pairs.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")
        both = with_b.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")
        return both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")

    def star(pairs: DataFrame) -> DataFrame:
        near = pairs.distinct().join(sketches("b"), "b").join(sketches("a"), "a").where(plausible())
        near = written(near.select("a", "b"))
        out = written(links(near))
        free(near)
        return out

    spent: list[DataFrame] = []

    def labelled_by(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The bucket rows with their classes, and the buckets that hold several."""
        label = components(edges)
        spent[:] = [label]
        rows_ = banded.join(label.withColumnRenamed("node", "rid"), "rid", "left").select("h", "band", "rid", "least", F.coalesce("label", "rid").alias("label"))
        return rows_, rows_.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")

    def may_link(x: Column) -> Column:
        """A leader x of another class than the row's, with a plausible sketch."""
        apart = F.aggregate(F.zip_with(x["parity"], F.col("parity"), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, n: s + n)
        return (x["label"] != F.col("label")) & (apart <= most_apart(x["total"], F.col("total"), x["again"] + F.col("again"), threshold) + 1e-6)

    edges = star(banded.where("rid <> least").select(F.col("least").alias("a"), F.col("rid").alias("b")))
    labelled, mixed = labelled_by(edges)
    for again in range(ROUNDS):
        # leaders bring their sketches to their bucket's rows, so that only pairs that may be similar become rows
        part = written(labelled.join(mixed, "h").select("h", "rid", "label").join(signed.select("rid", "total", "again", "parity"), "rid"))
        leads = [F.min(F.struct(F.xxhash64("rid", F.lit(again * LEADERS + i)).alias("x"), "rid", "label", "total", "again", "parity")) for i in range(LEADERS)]
        lead = part.groupBy("h").agg(F.array(*leads).alias("leads"))
        one = part.join(lead, "h").select("rid", F.explode(F.filter("leads", may_link)).alias("lead"))
        near = written(one.select(F.col("lead.rid").alias("a"), F.col("rid").alias("b")).distinct())
        new = written(links(near))
        edges, old = written(edges.union(new)), edges
        free(part, near, new, old, *spent)
        labelled, mixed = labelled_by(edges)
    rest = stored = written(labelled.join(mixed, "h"))
    free(banded, *spent)
    # with the buckets of the few bands before: a pair that shares one of those too is met there
    rest = rest.join(signed.select("rid", buckets.alias("all")), "rid")
    rest = rest.select("h", "rid", "label", "least", *(F.get("all", F.col("band") - k).alias(f"h{k}") for k in range(1, EARLIER + 1)))
    x = rest.select("h", F.col("rid").alias("a"), F.col("label").alias("la"), "least", *(F.coalesce(f"h{k}", F.lit(0)).alias(f"ha{k}") for k in range(1, EARLIER + 1))).join(sketches("a"), "a")
    y = rest.select(F.col("h").alias("h2"), F.col("rid").alias("b"), F.col("label").alias("lb"), *(F.coalesce(f"h{k}", F.lit(1)).alias(f"hb{k}") for k in range(1, EARLIER + 1))).join(sketches("b"), "b")
    # the first stars' pairs are known; others across classes of a bucket are compared
    known = reduce(lambda p, q: p | q, (F.col(f"ha{k}") == F.col(f"hb{k}") for k in range(1, EARLIER + 1)))
    other = (x["h"] == y["h2"]) & (F.col("la") < F.col("lb")) & (F.col("a") != F.col("least")) & (F.col("b") != F.col("least")) & plausible() & ~known
    more = written(x.join(y, other).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    free(stored, signed)
    last = written(links(more))
    label = components(edges.union(last))
    free(more, last, edges)
    # classes of more than one row are written: the two joins are then by shuffles that hold nothing else, so Spark can split a huge class
    found = member.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rid", "rep", F.coalesce("label", "rep").alias("c"))
    several = found.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
    rep_class = written(found.join(several, "c").select("rid", "c"))
    ids = docs.select("rid", "doc_id").join(rep_class, "rid").groupBy("c").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("class_size"))
    ids = written(ids.select("c", F.col("first.rid").alias("class_rid"), F.col("first.doc_id").alias("class_id"), "class_size"))
    classed = written(rep_class.join(ids, "c").drop("c"))
    free(member, label, rep_class, ids)
    out = docs.join(classed, "rid", "left")
    alone = F.col("class_rid").isNull()
    return out.withColumns({"class_id": F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")), "class_size": F.coalesce("class_size", F.lit(1).cast("long")), "class_rid": F.coalesce("class_rid", "rid")})


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class, the class's size, and whether it is the one that stays."""
    out = near_duplicates(base(documents(spark, sf_dir)))
    return out.select("doc_id", "class_id", "class_size", (F.col("rid") == F.col("class_rid")).alias("kept"))
