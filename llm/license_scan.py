"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from directories.

A text's lines, and the sentences of longer lines, are units. A unit's words,
weighted by inverse document frequency over all documents, are compared with
each template's by cosine, over shared words only. The best unit of a
text gives its licence if it is near enough; a text that is mostly such units
is a licence file. So is a text that as a whole is near enough to a whole
licence (with logarithmic term counts, as function words would outweigh the
others in long texts), whose licence it then has. A text without a licence of its own inherits that of the
nearest ancestor directory that holds a licence file, found by joining its
directory's ancestors to the directories' licences.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from importlib.resources import files as resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import base, documents, pieces, written

#: Public notices of common licences, by SPDX name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "proprietary": ["All rights reserved."],
}
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
SENTENCE = re.compile(r"(?<=[.;:!?])[ \t]+")
WHOLE = 0.85  # cosine to a whole licence; other versions and relatives of a licence stay below where they are apart
LONG = 40  # terms; longer lines are cut into sentences too


def whole_licences() -> dict[str, str]:
    """The texts in the folder ``licences``, by SPDX name; read on the driver."""
    found = (x for x in (resources(__package__) / "licences").iterdir() if x.name.endswith(".txt"))
    return {x.name.removesuffix(".txt"): x.read_text("utf-8") for x in found}


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Scorer:
    """Best template of a unit. Words in no template weigh as much as the rarest word that is in one.

    A cosine is at most the norm of the template's weights on the shared words.
    Each template's commonest words are left out of ``cues`` as long as their
    weights' norm stays below ``least``: a unit without cues cannot reach it.
    """

    def __init__(self, df: dict[str, int], n_docs: int, templates: dict[str, list[str]], least: float = 0.6, whole: bool = False) -> None:
        self.whole = whole
        vocabulary = {t for texts in templates.values() for x in texts for t in terms(x)}
        self.idf = {t: math.log((n_docs + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
        self.other = max(self.idf.values(), default=1.0)
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.names: list[str] = []
        self.cues: set[str] = set()
        for name, texts in templates.items():
            for x in texts:
                tf = self.counted(terms(x))
                norm = math.sqrt(sum((c * self.idf[t]) ** 2 for t, c in tf.items()))
                spare = least * least - 1e-9
                for t, c in sorted(tf.items(), key=lambda x: (self.idf[x[0]], x[0])):
                    w = c * self.idf[t] / norm
                    self.postings[t].append((len(self.names), w))
                    if w * w < spare:
                        spare -= w * w
                    else:
                        self.cues.add(t)
                self.names.append(name)

    def counted(self, unit: list[str]) -> dict[str, float]:
        tf = Counter(unit)
        return {t: 1 + math.log(c) for t, c in tf.items()} if self.whole else tf

    def best(self, unit: list[str]) -> tuple[float, str]:
        tf = self.counted(unit)
        norm = math.sqrt(sum((c * self.idf.get(t, self.other)) ** 2 for t, c in tf.items()))
        dot: dict[int, float] = defaultdict(float)
        for t, c in tf.items():
            for i, w in self.postings.get(t, ()):
                dot[i] += c * self.idf[t] * w
        score, i = max(((s / norm, -i) for i, s in dot.items()), default=(0.0, 0))
        return score, self.names[-i]


def _units(text: str) -> Iterator[str]:
    for line in text.split("\n"):
        yield line
        if line.count(" ") > LONG:
            yield from SENTENCE.split(line)


def own_licences(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.6, wholes: dict[str, str] | None = None) -> DataFrame:
    """rid, licence (null: none), score and is_file of each row of ``files`` (rid, text)."""
    templates = templates or TEMPLATES
    full = {name: [x] for name, x in sorted((whole_licences() if wholes is None else wholes).items())}
    vocabulary = sorted({t for some in (templates, full) for texts in some.values() for x in texts for t in terms(x)})
    texts = files.select("rid", "text")

    def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, n, df = frozenset(vocabulary), 0, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                df.update(wanted.intersection(terms(text)))
        yield pa.RecordBatch.from_pydict({"term": ["", *df], "n": [n, *df.values()]}, pa.schema([("term", pa.string()), ("n", pa.int64())]))

    counts = {r[0]: r[1] for r in texts.mapInArrow(document_frequency, "term string, n long").groupBy("term").agg(F.sum("n")).collect()}  # the templates' words
    scorer = Scorer(counts, counts.get("", 0), templates, least)
    whole_scorer = Scorer(counts, counts.get("", 0), full, WHOLE, whole=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                best, inside, low = (0.0, None), 0, text.lower()
                found = TERM.findall(low)
                if not scorer.cues.isdisjoint(found):
                    for unit in _units(low):
                        t = terms(unit)
                        if scorer.cues.isdisjoint(t):
                            continue
                        score, name = scorer.best(t)
                        if score >= least:
                            inside += len(t)
                            best = max(best, (score, name))
                licence = best[1] if best[0] >= least else None
                is_file = licence is not None and 2 * inside >= len(found)
                if not whole_scorer.cues.isdisjoint(found):
                    of_whole = whole_scorer.best(found)
                    if of_whole[0] >= WHOLE:
                        best, licence, is_file = of_whole, of_whole[1], True
                rows.append((rid, licence, round(best[0], 6), is_file))
            types = (pa.int64(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["rid", "licence", "score", "is_file"])

    return texts.mapInArrow(scan, "rid long, licence string, score double, is_file boolean")


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.6) -> DataFrame:
    """rid, licence, origin (file, header, inherited, none), from_dir and score of each row of ``files`` (rid, path, text).

    A null path has no directory and inherits nothing; equal paths are
    separate files. A directory's licence is its licence files' commonest, ties
    by name. Null and empty texts have no licence of their own.
    """
    files = files.select("rid", "path", F.coalesce("text", F.lit("")).alias("text"))
    own = own_licences(files, templates, least)
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    found = written(files.select("rid", parent.alias("dir")).join(own, "rid"))
    votes = found.where("is_file and dir is not null").groupBy("dir", "licence").agg(F.count(F.lit(1)).alias("n"))
    held = votes.groupBy("dir").agg(F.min(F.struct(-F.col("n"), F.col("licence").alias("licence"))).getField("licence").alias("dir_licence"))
    # ancestors of each distinct directory, nearest first
    dirs = found.where("licence is null and dir is not null").select("dir").distinct()
    step = F.split("dir", "/")
    chain = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(step)))).alias("depth"))
    chain = chain.select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("up"))
    near = chain.join(held.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "dir_licence")).alias("near"))
    out = found.join(near, "dir", "left")
    inherited = F.col("licence").isNull() & F.col("near").isNotNull()
    origin = F.when(F.col("is_file"), "file").when(F.col("licence").isNotNull(), "header").when(inherited, "inherited").otherwise("none")
    return out.select("rid", F.when(inherited, F.col("near.dir_licence")).otherwise(F.col("licence")).alias("licence"), origin.alias("origin"), F.when(inherited, F.col("near.up")).alias("from_dir"), "score")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of a tree: source, language and id make up the path."""
    docs = base(documents(spark, sf_dir), "source", "lang")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    files = docs.select("rid", path.alias("path"), "text")
    ids = docs.select("rid", "doc_id", path.alias("path"))
    return ids.join(scan(files), "rid").drop("rid")
