"""Quality rules with suffix-array repetition.

A document's words become numbers; their suffix array is built by prefix
doubling, and the longest common prefixes of neighbours in it come from the
ranks kept at each doubling. A suffix's longest repeat is the larger of the
two prefixes that it shares with its neighbours: the longest LCP interval
around it. The spans of all repeats of at least ``least`` words are united;
the share of words they cover and the longest repeat are limited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WORD, base, documents, pieces

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_words_pct: int = 50
    least: int = 6  # words a repeat must have to count
    max_covered: float = 0.3  # of all words; stricter than the base rule, which counts repeats of three words
    max_longest: float = 0.15  # of all words


def longest_repeats(codes: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest sequence starting there that starts elsewhere too (overlaps allowed)."""
    n = len(codes)
    if n < 2:
        return np.zeros(n, np.int64)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    while True:
        top = rank.max()
        if top == n - 1:
            order = np.empty(n, np.int64)
            order[rank] = np.arange(n)
            break
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        rank, k = new, k * 2
        levels.append(rank)
    # equal ranks at level j: the next 2**j words agree, or both suffixes end inside them, which cannot happen twice
    i, j, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r, step = levels[level], 1 << level
        ok = (i + step <= n) & (j + step <= n)
        ok[ok] = r[i[ok]] == r[j[ok]]
        lcp[ok] += step
        i[ok] += step
        j[ok] += step
    best = np.zeros(n, np.int64)
    best[order[:-1]] = lcp
    best[order[1:]] = np.maximum(best[order[1:]], lcp)
    return best


def covered(best: np.ndarray, least: int) -> int:
    """Positions inside the union of the repeats of at least ``least`` words."""
    at = np.flatnonzero(best >= least)
    if not len(at):
        return 0
    mark = np.zeros(len(best) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + best[at], -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def repeat_words(codes: np.ndarray, window: int = 3) -> int:
    n = len(codes) - window + 1
    if n < 2:
        return 0
    size = int(codes.max()) + 1
    pair = np.unique(codes[:-2] * size + codes[1:-1], return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(pair * size + codes[2:], return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    mark = np.zeros(len(codes), bool)
    for i in range(window):
        mark[i : i + n] |= hit
    return int(mark.sum())


def measure(text: str, rules: Rules) -> tuple:
    words = WORD.findall(text)
    n = len(words)
    ids: dict[str, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    again = repeat_words(codes)
    failed = n < rules.min_words or 100 * again > rules.max_repeat_words_pct * n
    best = longest_repeats(codes)
    longest, cover = (int(best.max()) if n else 0), covered(best, rules.least)
    bad = cover > rules.max_covered * n or longest >= max(rules.least, rules.max_longest * n)
    return n, sum(map(len, words)), symbols, dup, again, failed, not failed and not bad, cover, longest


SCHEMA = pa.schema([(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_covered", pa.int64()), ("longest_repeat", pa.int64())])
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long"


def quality(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """docs' columns and the measures and verdict of each row's ``text``; a null text has no words and fails.

    A column of docs with a measure's name is replaced. Equal rows each get a row.
    """
    rules = rules or Rules()
    docs = docs.drop(*[f.name for f in SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [measure(t or "", rules) for t in batch.column("text").to_pylist()]
            cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *SCHEMA.names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{ddl}, {DDL}")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(base(documents(spark, sf_dir)).drop("rid")).drop("text")
