"""Personal data: base patterns and bootstrapped contextual extraction.

Base spans of four kinds are the seed entities. Their contexts induce
lexical patterns: the two folded words before (or the one after) an
identifier-like run. Spark scores the graph of patterns and instances in
rounds. A pattern's worth for a kind is the scores of its distinct known
instances of that kind over all of its instances' weights: their scores where
they are known, whatever their kind, and a small doubt where they are not. A
pattern with enough known instances and worth votes for its others; an
instance that the votes make sure of is known from the next round on, and so
supports patterns that no seed was found with. The spans of the instances of
the last round's good patterns are added. Base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, base, documents, pieces, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Lookbehinds and possessive runs only save retries that cannot match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKED = re.compile(r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+(?: [(]?[0-9][0-9().-]*+(?![^ \t-\r.,;:!?]))*+")  # a word with a digit or @, and groups of digits after it
_EDGE = re.compile(r"^[^\w+@]+|[^\w]+$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before an @ (from the last match on) and a dotted domain after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)  # a run of local characters cannot hold an @
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end (code points, end exclusive), by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _fold(word: str) -> str:
    return re.sub(r"[^\w@:=]+", "", word).lower()


def _before(text: str, at: int) -> list[str]:
    """The last two words before a position, folded, whole however long they are; punctuation alone is no word."""
    width = 80
    while True:
        start = max(0, at - width)
        words = [x for x in map(_fold, WORD.findall(text[start:at])) if x]
        if not start or len(words) > 2:  # the first one may be cut
            return words[-2:]
        width *= 4


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, str | None, int, int, str]]:
    """(instance, kind of the base span or None, start, end, pattern) of identifier-like runs and base spans, each with the words before and the one after.

    Identifier-like: a word with a digit or an @, and groups of digits that
    follow it after single blanks; five characters or more, at least two digits or an @.
    """
    found = [(a, b, k) for k, a, b in spans]
    taken = sorted((a, b) for a, b, _ in found)
    i = 0
    for m in _MARKED.finditer(text):
        raw = m[0]
        lead = _EDGE.match(raw) if not raw[0].isalnum() else None
        a = m.start() + (lead.end() if lead and lead.start() == 0 else 0)
        b = m.start() + len(re.sub(r"[^\w]+$", "", raw))
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if b - a < 5 or i < len(taken) and taken[i][0] < b or sum(c.isdigit() for c in raw) < 2 and "@" not in raw:
            continue
        found.append((a, b, None))
    out = []
    for a, b, kind in found:
        before = _before(text, a)
        after = WORD.search(text, b)
        context = []
        if before:
            context.append("<" + " ".join(before))
        if after:
            context.append(">" + _fold(after[0]))
        out += [(text[a:b].lower(), kind, a, b, c) for c in context if len(c) > 1]
    return out


def worthy(edges: DataFrame, known: DataFrame, support: int, trust: float, doubt: float) -> DataFrame:
    """pattern, pattern_kind and worth of the patterns that known instances (instance, kind, score) support enough."""
    seen = edges.select("pattern", "instance").join(known.select("instance", F.col("kind").alias("of"), "score"), "instance", "left")
    sums = [F.sum(F.when(F.col("of") == k, F.col("score")).otherwise(0.0)).alias(f"sum_{k}") for k in KINDS]
    counts = [F.count(F.when(F.col("of") == k, 1)).alias(f"n_{k}") for k in KINDS]
    all_weights = F.sum(F.coalesce("score", F.lit(doubt))).alias("all_")
    by_pattern = seen.groupBy("pattern").agg(*sums, *counts, all_weights)
    best = F.greatest(*(F.struct((F.col(f"sum_{k}") / F.col("all_")).alias("worth"), F.col(f"n_{k}").alias("n"), F.lit(k).alias("kind")) for k in KINDS))
    best = by_pattern.select("pattern", best.alias("best")).select("pattern", F.col("best.kind").alias("pattern_kind"), F.col("best.worth").alias("worth"), F.col("best.n").alias("n"))
    return best.where((F.col("n") >= support) & (F.col("worth") >= trust)).select("pattern", "pattern_kind", "worth")


def extract(docs: DataFrame, rounds: int = 4, support: int = 5, trust: float = 0.9, doubt: float = 0.1) -> DataFrame:
    """rid, doc_id, n_email, n_ip, n_card, n_phone, base (base spans) and found (base and added spans), as kind:start:end joined by commas.

    ``support``: distinct known instances a pattern needs; ``trust``: the worth
    that it and the votes for an instance need; ``doubt``: what an unknown
    instance weighs. Null and empty texts have no spans; very long ones are
    read whole. Equal rows each get a row and count once as instances. ``docs``
    comes from :func:`llm.common.base`; its other columns are left out.
    """
    texts = docs.select("rid", "doc_id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(rid, *m) for m in mentions(text, base_spans(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))], ["rid", "instance", "kind", "a", "b", "pattern"])

    seen = written(texts.mapInArrow(scan, "rid long, instance string, kind string, a int, b int, pattern string"))
    edges = written(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    seeds = edges.where("kind is not null").groupBy("instance").agg(F.max("kind").alias("kind"), F.lit(1.0).alias("score"))
    known = seeds
    for _ in range(rounds):
        good = written(worthy(edges, known, support, trust, doubt))
        votes = edges.where("kind is null").join(good, "pattern").groupBy("instance", "pattern_kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("worth")))))).alias("score")  # one less the product of the doubts
        )
        best = votes.groupBy("instance").agg(F.max(F.struct("score", "pattern_kind")).alias("best"))
        sure = best.where(F.col("best.score") >= trust).select("instance", F.col("best.pattern_kind").alias("kind"), F.col("best.score").alias("score"))
        # what is a seed somewhere stays one
        known = written(seeds.union(sure.join(seeds, "instance", "left_anti").select("instance", "kind", "score")))
    good = worthy(edges, known, support, trust, doubt)
    added = seen.where("kind is null").join(good, "pattern").groupBy("rid", "a", "b").agg(F.min("pattern_kind").alias("kind"))
    added = added.groupBy("rid").agg(F.collect_list(F.struct("kind", "a", "b")).alias("added"))

    def basic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = [base_spans(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in x) for x in own], pa.int64()) for k in KINDS]
            text = pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), *counts, text], ["rid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base"])

    # only spans meet here, not texts
    own = texts.mapInArrow(basic, "rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string")
    both = own.join(added, "rid", "left")
    one = lambda s: F.struct(F.array_position(_kinds(), F.split(s, ":")[0]).alias("o"), F.split(s, ":")[1].cast("int").alias("a"), s.alias("s"))
    named = F.transform("added", lambda x: F.concat_ws(":", x["kind"], x["a"], x["b"]))
    merged = F.array_sort(F.transform(F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ",")), named), one))
    found = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_join(F.transform(merged, lambda x: x["s"]), ","))
    return both.select("rid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", found.alias("found"))


def _kinds():
    return F.array(*map(F.lit, KINDS))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(base(documents(spark, sf_dir)))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.col("found").alias("spans"))
