"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words. Words are ordered by rarity (counts in a
table of hash buckets of fixed size, from all lines; ties by hash). Two sets
with Jaccard similarity t or more share a word among each one's first
n - ceil(t n) + 1; rows for these prefix words meet by word, and length and
positional filters and a parity sketch (whose distance cannot exceed the
symmetric difference) leave few pairs, whose similarity is verified on all
words' hashes. A line goes if an earlier line, by doc_id (null last), row and
position, has that similarity, whether or not that one stays.

Equal sets are one set from the start. Sets that share their least or greatest
word hash are first compared with the earliest one of them, which settles most
of a family of near copies without expanding it into pairs; a pair is then
skipped only if both its sets are known to go, so no match is lost. Of the
pairs that are left, a later set's closest few by sketch are verified first,
and all its others only if none of those matches. A set so
small that one word more or less breaks the threshold matches equal sets only
and takes part in no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import base, bitmap_of, documents, fixed_array, free, written

BUCKETS = 1 << 16
HASH_BITS = 57  # of a word's hash; its rarity has the others of a long
SHORT = 64  # words of the largest set whose sketch is one long
FIRST = 4  # pairs of a set that are verified before its others
MOST_N, MOST_P = (1 << 20) - 1, (1 << 11) - 1


def spaced(text: Column) -> Column:
    """The text with blanks for its other white space but line ends: splitting at one plain character is far cheaper than at a pattern."""
    odd = reduce(lambda a, b: a | b, (text.contains(c) for c in "\t\x0b\x0c\r"))
    return F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with a word."""
    return docs.select("rid", "doc_id", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("pos", "line")).where(F.trim("line") != "")


def word_hashes(lines: DataFrame) -> DataFrame:
    """For each row of :func:`_lines`: ``ids``, the hashes of its distinct words, HASH_BITS wide."""
    hashed = lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - HASH_BITS)
    ids = F.array_remove(F.array_distinct(F.transform(F.split("line", " "), hashed)), hashed(F.lit("")))
    return lines.select("rid", "doc_id", "pos", ids.alias("ids"))


def rarity(hashed: DataFrame) -> list[int]:
    """For each hash bucket a number that grows with the count of lines that its words are in: a scaled logarithm, below 64."""
    counts = hashed.select(F.explode("ids").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    out = [0] * BUCKETS
    for b, r in counts.select("b", (F.log2(F.col("n") + 1) * 2).cast("int")).collect():  # BUCKETS rows at most
        out[b] = min(r, (1 << (63 - HASH_BITS)) - 1)
    return out


def joins(n: Column, threshold: float) -> Column:
    """Whether a set of another size or with another word can be similar enough to a set of ``n`` words."""
    return n >= (n + 1) * threshold - 1e-9


def line_sets(hashed: DataFrame, threshold: float) -> DataFrame:
    """For each row of ``hashed`` its set's identity (k1, k2), size, least and greatest word hash, sketch and prefix words, rarest first.

    The sketch has parities of the words by 6 bits of their hashes (p0), and in
    sets of more than SHORT words the same for half of the words (p1, else 0).
    The prefix is empty where only an equal set can be similar enough.
    """
    rare = fixed_array(rarity(hashed), "bigint")
    bits = [1 << i if i < 63 else -1 << 63 for i in range(64)]
    zero = F.lit(0).cast("bigint")
    n = F.size("ids")
    take = F.when(joins(n, threshold), n - F.ceil(n * threshold - 1e-9).cast("int") + 1).otherwise(0)
    # no element is null, which Spark has to know to sort and compare plain longs
    rank = lambda h: F.coalesce(F.shiftleft(rare[h.bitwiseAND(F.lit(BUCKETS - 1))], HASH_BITS) + h, zero)
    low32 = lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")
    lane = lambda table: F.aggregate("ids", zero, lambda a, h: a.bitwiseXOR(table[h.bitwiseAND(F.lit(2 * len(bits) - 1))]))
    p0, p1 = lane(fixed_array(bits * 2, "bigint")), lane(fixed_array([0] * 64 + bits, "bigint"))
    rows = hashed.select("rid", "doc_id", "pos", n.alias("n"), F.sort_array(F.transform("ids", rank)).alias("r"), p0.alias("p0"), F.when(n > SHORT, p1).otherwise(zero).alias("p1"), take.alias("take"), F.array_min("ids").alias("lo"), F.array_max("ids").alias("hi"))
    return rows.select("rid", "doc_id", "pos", "n", "p0", "p1", F.xxhash64("r").alias("k1"), F.hash("r").alias("k2"), F.transform(F.slice("r", F.lit(1), F.col("take")), low32).alias("prefix"), low32(F.col("lo")).alias("lo"), low32(F.col("hi")).alias("hi"))


def apart(n1: Column, n2: Column, par1: list[Column], par2: list[Column]) -> Column:
    """Distance of two sketches, at most the number of words that only one of the sets has."""
    x, y = (a.bitwiseXOR(b) for a, b in zip(par1, par2, strict=True))
    return F.when((n1 > SHORT) & (n2 > SHORT), F.bit_count(x.bitwiseXOR(y)) + F.bit_count(y)).otherwise(F.bit_count(x))


def closest(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each later set (k1, k2), dealt into FIRST parts by ``pa``, each part's nearest by ``far``."""
    part = F.pmod(F.xxhash64("pa.rid", "pa.pos"), F.lit(FIRST)).alias("part")
    return pairs.groupBy("k1", "k2", part).agg(F.min(F.struct("far", "pa", "pb")).alias("x")).select("k1", "k2", "x.*")


def decisions(docs: DataFrame, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """rid and ``removed`` (positions of lines to remove) of the rows of ``docs`` that lose any.

    Lines of fewer than ``least`` distinct words are left alone; the query and
    the pipeline take all lines that have a word. ``docs`` comes from
    :func:`llm.common.base`.
    """
    docs = docs.select("rid", "doc_id", "text")
    hashed = written(word_hashes(_lines(docs)))
    stored = written(line_sets(hashed, threshold))
    free(hashed)  # as large as the texts; few lines are verified, and hashed again
    lines = stored.where(F.col("n") >= least)
    lanes = ["p0", "p1"]
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "pos").alias("place")
    # lines whose set may occur again; all others are sets already
    again = lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = bitmap_of(again, "k1", "k2")
    rest = (place, "n", *lanes, "prefix", "lo", "hi")
    first = written(lines.where(shared).groupBy("k1", "k2").agg(F.min(F.struct(*rest)).alias("f")).select("k1", "k2", "f.*"))
    sets = lines.where(~shared).select("k1", "k2", *rest).unionByName(first)

    def may_match(n1: Column, p1: Column, n2: Column, p2: Column, par1: list[Column], par2: list[Column]) -> Column:
        """The sketches' distance, length and positional filters; p: positions of a common word, the first one of both sets."""
        need = F.ceil((n1 + n2) * (threshold / (1 + threshold)) - 1e-9)
        close = apart(n1, n2, par1, par2) <= (n1 + n2) * ((1 - threshold) / (1 + threshold)) + 1e-6
        return close & (F.least(n1, n2) >= F.greatest(n1, n2) * threshold - 1e-9) & (F.least(n1 - p1, n2 - p2) >= need)

    def words_at(wanted: DataFrame) -> DataFrame:
        """rid, pos and word hashes of the lines at these places (rid, pos), each there once."""
        few = word_hashes(_lines(docs.where(bitmap_of(wanted, "rid"))).where(bitmap_of(wanted, "rid", "pos")))
        return few.join(wanted, ["rid", "pos"]).select("rid", "pos", F.col("ids").alias("t"))

    def verified(ends: DataFrame, tokens: DataFrame) -> DataFrame:
        """Identities of the later sets of the pairs that match: ends has them and the places pa and pb of both sets' first lines."""
        a = tokens.select(F.col("rid").alias("ra"), F.col("pos").alias("qa"), F.col("t").alias("ta"))
        b = tokens.select(F.col("rid").alias("rb"), F.col("pos").alias("qb"), F.col("t").alias("tb"))
        both = ends.join(a, (F.col("pa.rid") == F.col("ra")) & (F.col("pa.pos") == F.col("qa"))).join(b, (F.col("pb.rid") == F.col("rb")) & (F.col("pb.pos") == F.col("qb")))
        common = F.size(F.array_intersect("ta", "tb"))
        return written(both.where(common >= (F.size("ta") + F.size("tb") - common) * threshold - 1e-9).select("k1", "k2").distinct())

    def cols(p: str) -> list[Column]:
        return [F.col(f"{p}{x}") for x in lanes]

    # families: each set with the earliest one of those that have the same least or greatest hash
    joining = sets.where(joins(F.col("n"), threshold))
    ends = joining.select("k1", "k2", "place", "n", *lanes, F.posexplode(F.array("lo", "hi")).alias("which", "h"))
    lead = ends.groupBy("which", "h").agg(F.min(F.struct("place", "n", *lanes)).alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    near = ends.join(lead, ["which", "h"])
    zero = F.lit(0)
    near = near.where((F.col("place") != F.col("lead.place")) & may_match(F.col("n"), zero, F.col("lead.n"), zero, cols(""), cols("lead.")))
    near = written(near.select(F.col("lead.place").alias("pa"), F.col("place").alias("pb"), "k1", "k2").distinct())
    gone = verified(near, words_at(near.select(F.explode(F.array("pa", "pb")).alias("x")).select("x.rid", "x.pos").distinct()))
    # the bitmap says for most sets that they are not among those; only the others are looked up
    key = ["k1", "k2"]
    lean = joining.select(*key, "n", *lanes, "prefix")
    listed = bitmap_of(gone, *key)
    known = lean.where(listed).join(gone.withColumn("gone", F.lit(1)), key, "left").withColumn("gone", F.coalesce("gone", F.lit(0)))
    all_sets = lean.where(~listed).withColumn("gone", F.lit(0)).unionByName(known)
    # a narrow row for each prefix word: word, identity (k1 alone will do here: the places have both), sketch; size, position and flag
    # share a long with the word. Too large a size or position counts as the largest one that there is room for, which lets more pairs through, never fewer
    prefix = all_sets.select("k1", "n", *lanes, "gone", F.posexplode("prefix").alias("p", "w"))
    small = F.shiftleft(F.least("n", F.lit(MOST_N)), 12) + F.shiftleft(F.least("p", F.lit(MOST_P)), 1) + F.col("gone")
    row = ["m", "k1", *lanes]
    prefix = prefix.withColumn("m", F.shiftleft(F.col("w").cast("bigint"), 32) + small.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))).select(*row)
    x = prefix.select(*(F.col(c).alias(f"a_{c}") for c in row))
    y = prefix.select(*(F.col(c).alias(f"b_{c}") for c in row))
    size = lambda m: F.shiftright(m, 12).bitwiseAND(F.lit(MOST_N)).cast("int")
    at = lambda m: F.shiftright(m, 1).bitwiseAND(F.lit(MOST_P)).cast("int")
    both_go = F.col("a_m").bitwiseAND(F.col("b_m")).bitwiseAND(F.lit(1)) == 1
    fits = may_match(size("a_m"), at("a_m"), size("b_m"), at("b_m"), cols("a_"), cols("b_"))
    pairs = x.join(y, (F.shiftright(x["a_m"], 32) == F.shiftright(y["b_m"], 32)) & (F.col("a_k1") < F.col("b_k1")) & ~both_go & fits)
    far = (apart(size("a_m"), size("b_m"), cols("a_"), cols("b_")) * 1000 / (size("a_m") + size("b_m"))).cast("int")
    pairs = written(pairs.select("a_k1", "b_k1", far.alias("far")).distinct())
    ids = pairs.select(F.explode(F.array("a_k1", "b_k1")).alias("k1"))
    where = written(sets.select(*key, "place").where(bitmap_of(ids, "k1")))
    ends = [where.select(*(F.col(c).alias(f"{p}_{c}") for c in where.columns)) for p in "ab"]
    placed = pairs.join(ends[0], "a_k1").join(ends[1], "b_k1")
    first_a = F.col("a_place") < F.col("b_place")
    pick = lambda p, q: F.when(first_a, F.col(p)).otherwise(F.col(q))
    at_line = lambda p: F.struct(F.col(f"{p}_place.rid").alias("rid"), F.col(f"{p}_place.pos").alias("pos"))
    pick_line = lambda p, q: F.when(first_a, at_line(p)).otherwise(at_line(q))
    placed = placed.select(pick_line("a", "b").alias("pa"), pick_line("b", "a").alias("pb"), pick("b_k1", "a_k1").alias("k1"), pick("b_k2", "a_k2").alias("k2"), "far")
    placed = written(placed.join(gone, key, "left_anti"))
    tokens = written(words_at(where.select("place.rid", "place.pos")))
    soon = verified(closest(placed), tokens)
    late = verified(placed.join(soon, key, "left_anti"), tokens)
    # lines of sets that go, and all but the first line of the others
    every = written(gone.union(soon).union(late).distinct())
    out = lines.where(bitmap_of(every, *key)).join(every, key, "left_semi").select("rid", "pos")
    firsts = first.select(*key, "place")
    copies = lines.where(shared).select(*key, "rid", "pos").join(firsts, key).where((F.col("rid") != F.col("place.rid")) | (F.col("pos") != F.col("place.pos")))
    out = written(out.union(copies.select("rid", "pos")))
    free(stored, first, near, gone, pairs, where, placed, tokens, soon, late, every)
    return out.groupBy("rid").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def line_dedup(docs: DataFrame, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """docs with each ``text`` less its removed lines, ``n_lines`` and ``removed``; null and empty texts have nothing to lose.

    Equal rows each keep a row. ``docs`` comes from :func:`llm.common.base`
    and may have any other columns; those two are replaced. Very long lines
    are compared whole.
    """
    docs = docs.drop("n_lines", "removed")
    out = docs.join(decisions(docs, threshold, least), "rid", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains("removed", i))
    text = F.when(F.size("removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return out.withColumn("n_lines", F.size(parts)).withColumn("text", text)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines, lines removed, and the removed lines' positions; texts are not moved for that."""
    docs = base(documents(spark, sf_dir))
    counts = docs.select("rid", "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    out = counts.join(decisions(docs), "rid", "left")
    n = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long")
    return out.select("doc_id", "n_lines", n.alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))
