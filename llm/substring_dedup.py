"""Substring dedup by difference-cover anchors.

A repeat is a window of ``length`` words that starts earlier too. Short
anchor windows are hashed only where position modulo a period lies in a
difference cover: for any two positions some shift below the period puts
both on the cover, so two equal long windows share an anchor that starts
inside both. Anchors that occur twice or more mark where repeats can be;
there, each anchor is extended: the full windows around it are hashed, and
all but the first of equal ones are repeats.

An anchor or window that occurs again inside one task's block of documents
is settled there; one row stands for it outside, so that a passage shared by
very many documents sends one row a block, not one a document.

Windows are told apart by 64-bit hashes of 64-bit word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import base, documents, free, pieces, written
from .hashing import WordHashes, windows, words_of

#: Perfect difference sets: every residue but 0 is the difference of exactly one pair.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9)}
BLOCK = 16 << 20


def cover_positions(n: int, period: int) -> np.ndarray:
    """Positions below n that lie on the cover."""
    on = np.zeros(period, bool)
    on[list(COVERS[period])] = True
    return np.flatnonzero(np.resize(on, max(n, 0))) if n > 0 else np.empty(0, np.int64)


def _firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the keys: is it the first of its value; does its value occur again."""
    _, index, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    first = np.zeros(len(keys), bool)
    first[index] = True
    return first, counts[inverse] > 1


def substring_dedup(docs: DataFrame, length: int = 20, period: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by a space) of each row.

    A word goes if a window of ``length`` words over it starts earlier too:
    in a row with a smaller doc_id (null last; equal ones by row) or earlier in
    its own row. Null and empty texts have no words; rows with fewer words than
    ``length`` lose none. Equal rows each get a row. Other columns are ignored.
    ``docs`` must be a table or checkpoint.
    """
    size = length - period + 1
    if size < 1:
        raise ValueError("the period must not exceed the length")
    rows = base(docs)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, BLOCK):
            keys, rids = [], []
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if len(words) >= length:
                    h = windows(hashes.of(words), size)
                    keys.append(h[cover_positions(len(h), period)])
                    rids.append(np.full(len(keys[-1]), rid, np.int64))
            if keys:
                key, rid = np.concatenate(keys).view(np.int64), np.concatenate(rids)
                first, again = _firsts(key)
                own = np.where(first, 0, np.arange(len(key)) + 1).astype(np.int32)
                for at in range(0, len(key), 1 << 16):
                    s = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(rid[s]), pa.array(own[s]), pa.array(again[s])], ["h", "rid", "own", "known"])

    found = rows.select("rid", "text").mapInArrow(anchors, "h long, rid long, own int, known boolean")
    # own: 0 for the one row that stands for a block, so a key meets one row a block at most; the others are known to repeat
    n = F.count(F.lit(1)).over(Window.partitionBy("h", F.when(F.col("own") == 0, F.lit(0)).otherwise(F.col("rid") + F.col("own"))))
    repeated = found.withColumn("n", n).where(F.col("known") | (F.col("n") > 1))
    # each step's shuffle files go before the next one shuffles the texts
    repeated = written(repeated.groupBy("rid").agg(F.collect_set("h").alias("hs")))
    marked = rows.join(repeated, "rid").select("rid", "doc_id", "text", "hs")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, BLOCK):
            parts = []
            docs = zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), batch.column("text").to_pylist(), batch.column("hs"), strict=True)
            for doc_id, rid, text, hs in docs:
                h = hashes.of(words_of(text))
                a = windows(h, size)
                at = cover_positions(len(a), period)
                hit = at[np.isin(a[at].view(np.int64), hs.values.to_numpy(zero_copy_only=False))]
                full = windows(h, length)
                # a window starting at p holds an anchor at q if p <= q <= p + length - size
                mark = np.zeros(len(h) + 2, np.int32)
                np.add.at(mark, np.maximum(hit - (length - size), 0), 1)
                np.add.at(mark, hit + 1, -1)
                p = np.flatnonzero(np.cumsum(mark)[: len(full)] > 0)
                if len(p):
                    parts.append((doc_id, rid, p.astype(np.int32), full[p].view(np.int64)))
            if not parts:
                continue
            parts.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            counts = [len(x[2]) for x in parts]
            doc = pa.array([x[0] for x in parts], pa.int64()).take(pa.array(np.repeat(np.arange(len(parts)), counts)))
            rid = np.repeat(np.array([x[1] for x in parts], np.int64), counts)
            pos, key = np.concatenate([x[2] for x in parts]), np.concatenate([x[3] for x in parts])
            first, _ = _firsts(key)
            later = ~first
            # runs of windows known to be later ones go as one row each, under a key of their own
            i = np.flatnonzero(later)
            if len(i):
                cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(pos[i]) != 1) | (np.diff(rid[i]) != 0)) + 1
                start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(i)]))
                s = i[start]
                own = key[s] ^ (rid[s] * 31 + pos[s] + 1)
                yield pa.RecordBatch.from_arrays([pa.array(own), doc.take(pa.array(s)), pa.array(rid[s]), pa.array(pos[s]), pa.array((end - start).astype(np.int32)), pa.array(np.ones(len(s), bool))], ["h", "doc_id", "rid", "pos", "run", "known"])
            i = np.flatnonzero(first)
            for at in range(0, len(i), 1 << 16):
                s = i[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(key[s]), doc.take(pa.array(s)), pa.array(rid[s]), pa.array(pos[s]), pa.array(np.ones(len(s), np.int32)), pa.array(np.zeros(len(s), bool))], ["h", "doc_id", "rid", "pos", "run", "known"])

    full = marked.mapInArrow(candidates, "h long, doc_id long, rid long, pos int, run int, known boolean")
    order = Window.partitionBy("h", "known").orderBy(F.col("doc_id").asc_nulls_last(), "rid", "pos")
    later = full.withColumn("n", F.row_number().over(order)).where(F.col("known") | (F.col("n") > 1))
    later = written(later.groupBy("rid").agg(F.collect_list("pos").alias("pos"), F.collect_list("run").alias("run")))
    free(repeated)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            total, gone, kept = [], [], []
            for text, pos, run in zip(batch.column("text").to_pylist(), batch.column("pos"), batch.column("run"), strict=True):
                words = words_of(text)
                total.append(len(words))
                if pos.is_valid:
                    p, r = pos.values.to_numpy(zero_copy_only=False), run.values.to_numpy(zero_copy_only=False)
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, p, 1)
                    np.add.at(mark, p + r + length - 1, -1)
                    keep = np.cumsum(mark[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                gone.append(total[-1] - len(words))
                kept.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(later, "rid", "left").select("doc_id", "text", "pos", "run")
    return joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
