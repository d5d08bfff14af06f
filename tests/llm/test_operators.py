"""Each operator against brute force or the library, on odd tables and on empty ones."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import bpe_words, flac, license_scan, line_dedup, minhash_dedup, mixing, pii, quality_rules, substring_dedup, token_counts
from llm.common import base, n_words

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^ \t-\r]+")


def split(t):
    return WORD.findall(t or "")


def in_order(docs):
    """(rid, doc_id, text), by doc_id with null last, then row."""
    rows = [(r.rid, r.doc_id, r.text) for r in base(docs).collect()]
    return sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))


def test_token_counts(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect())
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or ""))) for _, i, t in in_order(docs))
    assert got == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_counts_odd_texts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = [" a", "a ", "  a   b  ", "\n\n x", "x \n y", "▁a ▁▁b", "<s> </s> <unk>", "a b", "\t tab", "é́", "🙂🙂", "0x1F"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows, path).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in enumerate(odd)}


def test_bpe_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe_words.encode(base(docs), path).collect())
    want = Counter()
    for _, i, t in in_order(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), tok.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe_words.encode(base(empty), path).count() == 0
    out = bpe_words.decode(bpe_words.encode(base(docs), path).withColumnRenamed("decoded", "before"), path)
    assert out.where("decoded <> before").count() == 0 and out.count() == docs.count()


def test_bpe_words_of_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    spec, specials, _ = bpe_words.load(path)
    one, split_ = Tokenizer.from_str(spec), bpe_words.Splitter(list(specials))
    for t in ["It's WE'LL don't", "J̌ İ ΑΣ ΣΑΣ", "a<|endoftext|>B<|startoftext|>", "<|endof text|>", "x\x1cy\x85z　w", "９²Ⅷ½", "ﬁǄÅ"]:
        ids = [i for w in split_.words(t) for i in ([specials[w]] if w in specials else one.encode(w, add_special_tokens=False).ids)]
        assert ids == tok.encode(t, add_special_tokens=False).ids, t


def test_bpe_runs_and_distinct_words():
    """Both passes cut the same runs, whatever the separator, and list the same words in the same order."""
    for c in map(chr, range(0x110000)):
        t = f"a{c}b"
        if c.isspace() or bpe_words.RUN.findall(t) != [t]:
            assert bpe_words.runs_of(t) == bpe_words.RUN.findall(t), hex(ord(c))
    splitter = bpe_words.Splitter(["<s>"])
    texts = ["b a b's\x1cx <s> A-1 é", "", "z" * 100 + " a " + "z" * 100, "x\u3000ΣΑΣ 12 b"]
    numbers = bpe_words.Numbers()
    runs = bpe_words.Runs(splitter, numbers)
    for t in texts:
        for run in bpe_words.RUN.findall(t):
            runs[run]
    assert bpe_words.distinct_words(splitter, texts) == list(numbers)


def test_flac_round_trip(docs, empty):
    coded = flac.media(base(docs))
    rows = flac.read_back(coded).collect()
    got = Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in rows)
    want = Counter((i, len((t or "").encode()), hashlib.sha256(flac.payload_of(t)).hexdigest()) for _, i, t in in_order(docs))
    assert got == want
    assert flac.read_back(flac.media(base(empty))).count() == 0
    first = coded.orderBy("n_bytes", ascending=False).first()
    blocks = flac.pcm_blocks(coded.where(F.col("rid") == first.rid)).orderBy("sample_offset").collect()
    assert b"".join(b.pcm for b in blocks)[: first.n_bytes] == dict((r, t) for r, _, t in in_order(docs))[first.rid].encode()
    assert all(first.media[b.byte_offset : b.byte_offset + 2] == b"\xff\xf8" for b in blocks)


def test_flac_finds_damage():

    noise = np.random.default_rng(1).integers(0, 256, flac.BLOCK * 3, np.uint8).tobytes()
    for payload in (bytes(flac.BLOCK), noise, flac.payload_of("a" * 3000)):
        stream, lengths = flac.encode_payloads([payload])[0]
        assert flac.decode_streams([stream], [lengths]) == [payload]
        for at in (44, 47, len(stream) - 1, len(stream) - 40):
            bad = bytearray(stream)
            bad[at] ^= 1
            with pytest.raises(ValueError):
                flac.decode_streams([bytes(bad)], [lengths])


def shingle_set(t):
    w = split(t)
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def test_near_duplicates(docs, empty):
    rows = in_order(docs)
    sets = {r: shingle_set(t) for r, _, t in rows}
    parent = {r: r for r, _, _ in rows}
    place = {r: n for n, (r, _, _) in enumerate(rows)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            a, b = sets[x], sets[y]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                u, v = sorted((root(x), root(y)), key=place.get)
                parent[v] = u
    got = {r.rid: (r.class_rid, r.class_size) for r in minhash_dedup.near_duplicates(base(docs)).collect()}
    sizes = Counter(root(r) for r in parent)
    assert got == {r: (root(r), sizes[root(r)]) for r in parent}
    assert minhash_dedup.near_duplicates(base(empty)).count() == 0


def test_probability_jaccard():

    x = (np.array([1, 2, 3], np.uint64), np.array([1, 2, 3]))
    y = (np.array([2, 3, 9], np.uint64), np.array([4, 1, 5]))
    wx, wy = dict(zip([1, 2, 3], [1, 2, 3], strict=True)), dict(zip([2, 3, 9], [4, 1, 5], strict=True))
    want = sum(1 / sum(max(wx.get(e, 0) / wx[d], wy.get(e, 0) / wy[d]) for e in {1, 2, 3, 9}) for d in (2, 3))
    assert minhash_dedup.similarity(x, y) == pytest.approx(want)
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    w = rng.integers(1, 5, 300)
    a, b = (keys[:200], w[:200]), (keys[50:250], w[50:250])
    a, b = ((k[np.argsort(k)], x[np.argsort(k)]) for k, x in (a, b))
    agree = np.mean(minhash_dedup.signature(*a, 2000) == minhash_dedup.signature(*b, 2000))
    assert abs(agree - minhash_dedup.similarity(a, b)) < 0.05


@pytest.mark.parametrize("least", [1, 3])
def test_line_dedup(docs, empty, least):
    seen: list[frozenset] = []
    at = defaultdict(list)
    want = {}
    for rid, _, t in in_order(docs):
        gone = []
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(split(line))
            if len(s) < least:
                continue
            shared = Counter(j for w in s for j in at[w])
            if any(n >= 0.8 * (len(s) + len(seen[j]) - n) - 1e-9 for j, n in shared.items()):
                gone.append(k)
            for w in s:
                at[w].append(len(seen))
            seen.append(s)
        if gone:
            want[rid] = gone
    got = {r.rid: r.removed for r in line_dedup.decisions(base(docs), least=least).collect()}
    assert got == want
    out = {r.rid: r.text for r in line_dedup.line_dedup(base(docs), least=least).collect()}
    assert out == {rid: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in want.get(rid, ())) for rid, _, t in in_order(docs)}
    assert line_dedup.line_dedup(base(empty)).count() == 0


def test_line_dedup_verifies_few_pairs_of_a_family(spark, monkeypatch):
    """Near copies around the threshold: as brute force has it, and of a set's pairs a few are verified before its others."""
    import random

    rng = random.Random(3)
    kept = rng.sample(range(1000), 40)
    sets = []
    for _ in range(150):
        own = set(kept)
        for w in rng.sample(kept, rng.randint(1, 6)):
            own ^= {w, 1000 + rng.randrange(5000)}
        sets.append(own)
    want = [i for i, x in enumerate(sets) if any(len(x & y) >= 0.8 * len(x | y) - 1e-9 for y in sets[:i])]
    table = spark.createDataFrame([(i, " ".join(f"w{w}" for w in sorted(x))) for i, x in enumerate(sets)], "doc_id long, text string")
    met, real = [], line_dedup.closest

    def spy(pairs):
        out = real(pairs)
        met.append((pairs.count(), pairs.select("k1", "k2").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(line_dedup, "closest", spy)
    rows = base(table)
    gone = line_dedup.decisions(rows).select("rid").join(rows, "rid").collect()
    assert sorted(r.doc_id for r in gone) == want
    ((pairs, later, first),) = met
    assert later <= first <= line_dedup.FIRST * later and first < pairs


def test_line_sketches_bound_the_difference(spark):
    """Sets of up to and over SHORT words, against each other: no sketch distance above the number of words of one set only."""
    import random

    rng = random.Random(5)
    sizes = [1, 7, line_dedup.SHORT - 1, line_dedup.SHORT, line_dedup.SHORT + 1, 90, 200]
    sets = [set(rng.sample(range(400), n)) for n in sizes for _ in range(6)]
    table = spark.createDataFrame([(i, " ".join(f"w{w}" for w in x)) for i, x in enumerate(sets)], "doc_id long, text string")
    hashed = line_dedup.word_hashes(line_dedup._lines(base(table)))
    rows = line_dedup.line_sets(hashed, 0.8).select("doc_id", "n", "p0", "p1").cache()
    x, y = (rows.select(*(F.col(c).alias(f"{s}_{c}") for c in rows.columns)) for s in "xy")
    far = line_dedup.apart(F.col("x_n"), F.col("y_n"), [F.col("x_p0"), F.col("x_p1")], [F.col("y_p0"), F.col("y_p1")])
    got = x.crossJoin(y).select("x_doc_id", "y_doc_id", "x_n", far.alias("far")).collect()
    assert len(got) == len(sets) ** 2 and all(r.x_n == len(sets[r.x_doc_id]) for r in got)
    own = [(r.far, len(sets[r.x_doc_id] ^ sets[r.y_doc_id])) for r in got]
    assert all(f <= d and (f - d) % 2 == 0 for f, d in own) and sum(f > 0 for f, _ in own) > len(own) / 2


def test_near_duplicate_bound_holds(spark):
    """No pair that is similar enough has more shingles of its own than the sketches are held against."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(4000):
        n = int(rng.integers(2, 60))
        x = rng.geometric(rng.choice([0.1, 0.5, 0.99]), n)
        y = np.maximum(0, x + rng.integers(-2, 3, n) * (rng.random(n) < rng.random() * 0.5))
        keys = np.arange(n).astype(np.uint64)
        a, b = (keys[x > 0], x[x > 0]), (keys[y > 0], y[y > 0])
        if len(a[0]) and len(b[0]):
            own = len(np.setxor1d(a[0], b[0]))
            again = int(a[1].sum() - len(a[0]) + b[1].sum() - len(b[0]))
            rows.append((float(minhash_dedup.similarity(a, b)), int(a[1].sum()), int(b[1].sum()), again, own))
    df = spark.createDataFrame(rows, "s double, x long, y long, again long, own long")
    similar = df.where("s >= 0.8")
    assert similar.count() > 200
    assert similar.where(F.col("own") > minhash_dedup.most_apart(F.col("x"), F.col("y"), F.col("again"), 0.8) + 1e-6).isEmpty()


def test_line_dedup_is_native(docs):
    plan = line_dedup.line_dedup(base(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_substring_dedup(docs, empty):
    seen, want = set(), Counter()
    for _, i, t in in_order(docs):
        w = split(t)
        keep = [True] * len(w)
        for q in range(len(w) - 19):
            x = tuple(w[q : q + 20])
            if x in seen:
                keep[q : q + 20] = [False] * 20
            seen.add(x)
        want[i, len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep, strict=True) if k)] += 1
    for period in (13, 7):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs, 20, period).collect())
        assert got == want
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_keeps_one_steps_shuffles(docs):
    """The last step shuffles texts and runs, nothing of the steps before it, whose shuffle files can go by then."""
    plan = substring_dedup.substring_dedup(docs)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1


def test_covers_are_perfect():
    for period, cover in substring_dedup.COVERS.items():
        assert sorted((a - b) % period for a in cover for b in cover if a != b) == list(range(1, period))


def naive_repeats(codes):
    n = len(codes)
    out = []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and codes[i + k] == codes[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_suffix_array_repeats():
    import random


    rng = random.Random(2)
    for n in (0, 1, 2, 5, 30, 60):
        for size in (1, 2, 3, 20):
            codes = [rng.randrange(size) for _ in range(n)]
            best = quality_rules.longest_repeats(np.array(codes, np.int64))
            assert best.tolist() == naive_repeats(codes)
            marked = {q for i, b in enumerate(best.tolist()) if b >= 3 for q in range(i, i + b)}
            assert quality_rules.covered(best, 3) == len(marked)


def test_quality(docs, empty):
    rows = quality_rules.quality(base(docs)).collect()
    texts = {r: t for r, _, t in in_order(docs)}
    for r in rows:
        t, w = texts[r.rid] or "", split(texts[r.rid])
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {q for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for q in range(i, i + 3)}
        lines = [x for x in t.split("\n") if split(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 2 * len(again) > len(w))
        assert not (r.base_failed and r.kept)
    assert {r.kept for r in rows if r.doc_id == 130} == {True}
    assert {r.kept for r in rows if r.doc_id == 131} == {False}
    assert quality_rules.quality(base(empty)).count() == 0


def test_quality_rejects_one_long_repeat():
    part = " ".join(f"w{i}" for i in range(60))
    rules = quality_rules.Rules(max_repeat_words_pct=101)
    kept = lambda t: quality_rules.measure(t, rules)[6]
    assert kept(part)
    assert not kept(part + " " + part)


def test_pii_base_and_context(spark, docs, empty):
    rows = [(i, f"pls write me at user{i}@mail.example.com today") for i in range(8)]
    rows += [(50, "pls write me at bob77_at_site today and 10.0.0.1 x"), (51, None), (None, "call 12345 me"), (52, "999.1.1.1 x 4111 1111-11111111 y +1 (555) 123-4567")]
    got = {r.doc_id: r for r in pii.extract(base(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[50].base == "ip:40:48" and got[50].found == "email:16:29,ip:40:48"
    assert got[52].base == "card:12:30,phone:33:50"
    assert got[51].found == got[None].found == ""
    assert got[3].n_email == 1
    assert pii.extract(base(docs)).count() == docs.count()
    assert pii.extract(base(empty)).count() == 0


def test_pii_rounds_reach_what_no_seed_is_next_to(spark):
    """Seeds induce a pattern, its other instances a second one, and that one finds an identifier in a text without base spans."""
    rows = [(i, f"pls write me at user{i}@mail.example.com, {i}x") for i in range(9)]
    rows += [(20 + i, f"pls write me at hidden{i}_at_site99 today\nor by handle hidden{i}_at_site99 there") for i in range(6)]
    rows += [(40, "now use by handle only77_in_this place"), (41, "in the year 1984 so far"), (42, "by handle (743) 555-3824 it"), (43, "write me at\t" + "x" * 300 + "99 end")]
    got = {r.doc_id: (r.base, r.found) for r in pii.extract(base(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[20] == ("", "email:16:33,email:53:70")
    assert got[40] == ("", "email:18:32") and got[41] == ("", "")
    assert got[42] == ("", "email:11:24")
    assert got[43] == ("", f"email:12:{12 + 302}")
    one = {r.doc_id: r.found for r in pii.extract(base(spark.createDataFrame(rows, "doc_id long, text string")), rounds=0).collect()}
    assert one[20] == "email:16:33" and one[40] == ""


def test_pii_scores_by_brute_force(spark):
    import random

    rng = random.Random(8)
    edges = {(f"p{rng.randint(0, 12)}", f"i{rng.randint(0, 60)}") for _ in range(400)}
    known = {f"i{i}": (rng.choice(["email", "email", "email", "ip"]), rng.choice([1.0, 0.95])) for i in range(45)}
    want = {}
    for p in {p for p, _ in edges}:
        mine = [i for q, i in edges if q == p]
        total = sum(known[i][1] if i in known else 0.1 for i in mine)
        worth = {k: (sum(known[i][1] for i in mine if i in known and known[i][0] == k) / total, sum(i in known and known[i][0] == k for i in mine)) for k in pii.KINDS}
        kind, (w, n) = max(worth.items(), key=lambda x: (x[1], x[0]))
        if w >= 0.6 and n >= 5:
            want[p] = (kind, pytest.approx(w))
    df = spark.createDataFrame(sorted(edges), "pattern string, instance string")
    seeds = spark.createDataFrame([(i, *x) for i, x in known.items()], "instance string, kind string, score double")
    got = {r.pattern: (r.pattern_kind, r.worth) for r in pii.worthy(df, seeds, 5, 0.6, 0.1).collect()}
    assert want and got == want


def test_quality_method_decides_under_default_rules():
    words = [f"w{i}" for i in range(200)]
    part = words[:45]
    n, *_, failed, kept, cover, longest = quality_rules.measure(" ".join(words + part), quality_rules.Rules())
    assert (n, failed, kept, cover, longest) == (245, False, False, 90, 45)
    assert quality_rules.measure(" ".join(words + part[:20]), quality_rules.Rules())[6]


def test_mixing_takes_part_of_equal_rows(spark):
    df = spark.createDataFrame([(7, "a b c d e f g h i j", "s")] * 3000 + [(8, "x " * 40_000, "t")], "doc_id long, text string, source string")
    rows = mixing.mix(base(df, "source"), F.array("source"), n_words(F.col("text"))).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("n"), F.max("mix_target").alias("t")).collect()
    got = {r.source: (r.n, r.t) for r in rows}
    assert abs(got["s"][0] - got["s"][1]) <= 10


def test_pii_base_is_the_plain_patterns():
    import random

    plain = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    rng = random.Random(4)

    def ok(k, s):
        d = re.sub("[^0-9]", "", s)
        return k == "email" or k == "ip" and all(int(x) <= 255 for x in s.split(".")) or k == "card" and 13 <= len(d) <= 19 and pii.luhn(d) or k == "phone" and 9 <= len(d) <= 15

    for _ in range(5000):
        t = "".join(rng.choice("a1.@-+ (25)%4é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == [(k, *m.span()) for k, pattern in plain for m in re.finditer(pattern, t) if ok(k, m[0])], t


def test_mixing_targets():
    t = mixing.targets({"b": 100, "a": 1000, None: 50, "c": 10})
    assert sum(t.values()) == pytest.approx(1.5 * 1160)
    assert all(v <= 2 * s + 1e-6 for v, s in zip((t["b"], t["a"], t[None], t["c"]), (100, 1000, 50, 10), strict=True))
    assert mixing.targets({}) == {}


def test_flow_spreads_repeats():
    got = mixing.flow({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 120, "b": 60})
    assert sum(got.values()) == 180 and got["a",] <= 100 and got["b",] <= 10  # no second pass while first ones are free
    assert mixing.flow({("a",): 10}, {"a": 17}) == {("a",): 17}


def test_mixing(docs, empty):
    members = F.array(F.col("source"))
    run = lambda: mixing.mix(base(docs, "source"), members, n_words(F.col("text")))
    rows = run().collect()
    assert len(rows) == docs.count()
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.mix_size == len(split(r.text)) and 0 <= r.mix_copies <= 2
        taken[r.source] += r.mix_size * r.mix_copies
        largest[r.source] = max(largest[r.source], r.mix_size)
    for r in rows:
        assert abs(taken[r.source] - r.mix_target) <= largest[r.source]
    assert sorted((r.rid, r.mix_copies) for r in rows) == sorted((r.rid, r.mix_copies) for r in run().collect())
    assert mixing.mix(base(empty, "source"), members, n_words(F.col("text"))).count() == 0


def test_mixing_overlapping_sources(spark):
    rows = [(i, "w " * (5 + i % 7), ["a"] if i % 3 else ["a", "b"] if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    out = mixing.mix(df, F.col("m"), n_words(F.col("text")))
    assert out.count() == 300 and out.agg(F.max("mix_copies")).first()[0] <= 2


def test_licenses(spark, docs, empty):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    plain = "some words of code and nothing else to see in this file"
    rows = [(1, "p/LICENSE", mit), (2, "p/src/a.py", plain), (3, "p/src/b.py", plain + "\n" + gpl + "\n" + plain), (4, "q/x.py", plain), (5, "p/src/deep/er/c.py", None), (6, None, plain), (7, "p/vendor/COPYING", gpl), (8, "p/vendor/z.py", "")]
    files = spark.createDataFrame(rows, "rid long, path string, text string")
    got = {r.rid: (r.licence, r.origin, r.from_dir) for r in license_scan.scan(files).collect()}
    assert got[1] == ("MIT", "file", None) and got[2] == ("MIT", "inherited", "p") and got[3] == ("GPL-3.0", "header", None)
    assert got[4] == (None, "none", None) and got[5] == ("MIT", "inherited", "p") and got[6] == (None, "none", None)
    assert got[8] == ("GPL-3.0", "inherited", "p/vendor")
    with_path = lambda d: base(d, "source").withColumn("path", F.col("source"))
    assert license_scan.scan(with_path(docs)).count() == docs.count()
    assert license_scan.scan(with_path(empty)).count() == 0


def test_licenses_of_common_words(spark):
    """A notice that a third of a large table holds is found in each of them."""
    notice = "Released under the MIT License."
    text = F.when(F.col("id") % 3 == 0, F.lit(f"a b\n{notice}")).otherwise(F.concat(F.lit("of its own "), F.col("id").cast("string")))
    files = spark.range(30_000).select(F.col("id").alias("rid"), text.alias("text"))
    got = license_scan.own_licences(files).groupBy("licence").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).collect()
    assert {r.licence: (r.n, r.low) for r in got} == {"MIT": (10_000, 1.0), None: (20_000, 0.0)}


def test_licence_cues_lose_nothing():
    """Units without a cue stay below the bound, whatever the counts."""
    import random

    rng = random.Random(6)
    vocabulary = sorted({t for texts in license_scan.TEMPLATES.values() for x in texts for t in license_scan.terms(x)})
    skipped = 0
    for n in (1000, 1_000_000):
        for _ in range(20):
            scorer = license_scan.Scorer({t: rng.choice((0, 1, n // 100, n // 3, n)) for t in vocabulary}, n, license_scan.TEMPLATES, 0.6)
            for _ in range(200):
                base_ = license_scan.terms(rng.choice(rng.choice(list(license_scan.TEMPLATES.values()))))
                unit = [t for t in base_ if rng.random() < 0.7]
                if scorer.cues.isdisjoint(unit):
                    skipped += 1
                    assert not unit or scorer.best(unit)[0] < 0.6
    assert skipped


def test_whole_licences_are_inherited(spark):
    """A complete licence text is a licence file, however its lines are cut, and its directory passes it on."""
    plain = "some words of code and nothing else to see in this file"
    rows = []
    for k, (name, text) in enumerate(sorted(license_scan.whole_licences().items())):
        at = ("Copyright (c) 2021 Some Body. All rights reserved.\n\n" + text, " ".join(text.split()), text)[k % 3]
        rows += [(3 * k, f"{name}/LICENSE", at), (3 * k + 1, f"{name}/src/a.py", plain), (3 * k + 2, f"half-{name}/LICENSE", text[: len(text) // 3] + f"\n{plain}" * 300)]
    got = {r.rid: (r.licence, r.origin, r.from_dir) for r in license_scan.scan(spark.createDataFrame(rows, "rid long, path string, text string")).collect()}
    names = {p.split("/")[0] for _, p, _ in rows if not p.startswith("half-")}
    assert names == {"MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "CC-BY-NC-4.0"}
    for rid, path, _ in rows:
        name, last = path.split("/")[0], path.split("/")[-1]
        if name.startswith("half-"):
            assert got[rid][1] != "file"
        else:
            assert got[rid] == ((name, "file", None) if last == "LICENSE" else (name, "inherited", name))


def test_row_ids_do_not_depend_on_the_split(spark, docs, tmp_path):
    """The same ids when tasks are cut otherwise between two scans."""
    docs.select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "one"))
    docs.where("doc_id < 0").write.orc(str(tmp_path / "orc"))
    tables = [docs, spark.read.parquet(str(tmp_path / "one")), docs.union(docs), docs.where("doc_id > 100").withColumn("n", F.lit(1)), docs.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")), spark.read.orc(str(tmp_path / "orc"))]
    frames = [base(t) for t in tables]
    seen = lambda: [sorted(((r.rid, r.doc_id, r.text) for r in f.collect()), key=str) for f in frames]
    before, keys = seen(), ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "20000")
        again = [base(t) for t in tables[:2]]
        assert seen() == before and [sorted(((r.rid, r.doc_id, r.text) for r in f.collect()), key=str) for f in again] == before[:2]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for t, rows in zip(tables, before, strict=False):
        assert len({r[0] for r in rows}) == len(rows) == t.count()


def test_blocks_do_not_depend_on_the_cores(spark, docs):
    """After encode is planned, scans are cut alike whatever the number of cores that the cluster has by then."""
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism")
    for k in keys:
        spark.conf.unset(k)
    bpe_words.encode(base(docs), public_tokenizers.path("word_bpe_49k.json"))
    cut = []
    try:
        for n in (1, 64):
            spark.conf.set(keys[1], n)
            cut.append(sorted(map(tuple, base(docs).select("rid", F.spark_partition_id()).collect())))
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert cut[0] == cut[1]
