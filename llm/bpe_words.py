"""BPE encoding and decoding over a table of distinct words.

Texts are split into the tokenizer's words; a block of documents keeps its
texts as numbers into the block's own list of distinct words. Those lists
are dealt out by word and sorted, so that each distinct word of the corpus
is encoded once, however many blocks use it. The ids go back to the blocks
and are put in place by position. Decoding joins ids to the vocabulary's
pieces, a table of bounded size that every task holds.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import base, documents, fix_split, pieces

BLOCK = 24 << 20  # bytes of text in a block of documents
BATCH = 1 << 15

#: The word pattern that the supported vocabularies are made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


#: Unicode's white space; no word crosses it.
RUN = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def runs_of(text: str) -> list[str]:
    """The text's runs of non-white characters. str.split is far faster than a pattern, and differs at four separators only."""
    return RUN.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


class Numbers(dict):
    """key -> number in order of first use."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Runs(dict):
    """A run of non-white characters -> numbers of its words."""

    def __init__(self, splitter: Splitter, numbers: Numbers) -> None:
        super().__init__()
        self.words, self.number = splitter.words, numbers.__getitem__

    def __missing__(self, run: str) -> tuple[int, ...]:
        out = tuple(map(self.number, self.words(run)))
        if len(run) <= 64:
            self[run] = out
        return out


class Splitter:
    """A text's words, as the tokenizer's normalizer and pre-tokenizer give them; special strings are words of their own."""

    def __init__(self, specials: list[str]) -> None:
        import regex

        self.wide = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}"))
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII.findall(text.lower())
        # lower case is by character: a capital sigma's form does not depend on its neighbours
        return self.wide.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.plain(part)
        return out


def distinct_words(splitter: Splitter, texts: list[str]) -> list[str]:
    """The texts' distinct words, in the order in which :class:`Numbers` numbers them: equal runs are looked at once."""
    seen: dict[str, None] = {}
    for text in texts:
        seen.update(dict.fromkeys(runs_of(text)))
    local: dict[str, None] = {}
    for run in seen:
        local.update(dict.fromkeys(splitter.words(run)))
    return list(local)


@lru_cache(maxsize=4)
def load(path: str) -> tuple[str, dict[str, int], list[str]]:
    """A tokenizer for single words (as JSON), the special strings' ids, and the piece of each id; refuses other kinds of tokenizers."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if kinds != ["NFC", "Replace", "Lowercase"] or split["pattern"]["Regex"] != PATTERN or byte_level["use_regex"] or byte_level["add_prefix_space"]:
        raise ValueError("a tokenizer of another kind")
    if spec["decoder"] is not None or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("a tokenizer of another kind")
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    by_id = {i: p for p, i in (spec["model"]["vocab"] | specials).items()}
    listed = [by_id.get(i) for i in range(max(by_id) + 1)]
    own = {k: spec[k] for k in ("version", "model", "decoder", "post_processor", "truncation", "padding")}
    return json.dumps(own | {"normalizer": None, "added_tokens": [], "pre_tokenizer": byte_level}), specials, listed


_TOKENIZERS: dict[int, object] = {}


def _tokenizer(sent):
    """The broadcast tokenizer, made once a worker."""
    from tokenizers import Tokenizer

    if sent.value[0] not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[sent.value[0]] = Tokenizer.from_str(sent.value[1])
    return _TOKENIZERS[sent.value[0]]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded`` but ``ids``, and ``decoded``: the pieces of its ids joined by a space, for ids from anywhere.

    A join of ids to the vocabulary's table. Null and empty arrays give an empty text; ids that are in no vocabulary are left out.
    """
    spark = encoded.sparkSession
    listed = load(path)[2]
    table = spark.createDataFrame(pd.DataFrame({"id": range(len(listed)), "piece": listed}).dropna(), "id int, piece string")
    rows = encoded.withColumn("row_", F.monotonically_increasing_id())
    ids = rows.select("row_", F.posexplode("ids").alias("pos", "id"))
    named = ids.join(F.broadcast(table), "id").groupBy("row_")  # the vocabulary: bounded
    texts = named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ").alias("decoded"))
    return rows.drop("ids").join(texts, "row_", "left").drop("row_").withColumn("decoded", F.coalesce("decoded", F.lit("")))


def encode(docs: DataFrame, path: str, ids: bool = True, text: bool = True, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """rid, doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs`` (from :func:`llm.common.base`); with ``ids`` and ``text`` also the array ``ids`` and the text ``decoded``.

    As the tokenizers library gives them, without added special tokens;
    decoding keeps special tokens. Empty texts: no ids, an empty text. Equal
    rows each get a row. Of the other columns of ``docs`` those in ``carry``
    come along (``text`` squeezed), the others are left out. A very long
    text is a block of its own; a smaller ``block`` takes less memory and
    shuffles more words.
    """
    spark = docs.sparkSession
    spec, specials, listed = load(path)
    sent = spark.sparkContext.broadcast((hash(spec), spec))  # the vocabulary: bounded
    vocabulary = spark.sparkContext.broadcast(listed)
    names, size = list(specials), block

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list[tuple], pa.RecordBatch]]:
        splitter = Splitter(names)
        for batch in pieces(batches, size):
            local = Numbers()
            runs, rows = Runs(splitter, local), []
            for rid, doc_id, text in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows.append((rid, doc_id, np.fromiter(chain.from_iterable(map(runs.__getitem__, runs_of(text))), np.uint32)))
            if rows:
                yield rows[0][0], list(local), rows, batch

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(names)
        for batch in pieces(batches, size):
            block, local = batch.column("rid")[0].as_py(), distinct_words(splitter, batch.column("text").to_pylist())
            for at in range(0, len(local), BATCH):
                w = local[at : at + BATCH]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), block, np.int64)), pa.array(np.arange(at, at + len(w), dtype=np.int32)), pa.array(w, pa.string())], ["block", "i", "word"])

    def brought(part: pa.RecordBatch) -> list[pa.Array]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return [pa.array([squeeze(x.encode("utf-8")) for x in part.column(c).to_pylist()], pa.binary()) if c == "text" else part.column(c) for c in carry]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for block, local, rows, batch in blocks(batches):
            kind = np.uint16 if len(local) < 1 << 16 else np.uint32
            for at in range(0, len(rows), 500):
                part = rows[at : at + 500]
                # the low bytes of all codes, then the next ones: equal high bytes stand together
                packed = [squeeze(c.astype(kind).view(np.uint8).reshape(-1, kind().nbytes).T.tobytes()) for _, _, c in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(part), pa.int64()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([len(r[2]) for r in part], pa.int32()), pa.array(packed, pa.binary()), *brought(batch.slice(at, len(part)))],
                    ["block", "rid", "doc_id", "n", "codes", *(f"c_{c}" for c in carry)],
                )

    wide = np.dtype("<u2") if len(listed) <= 1 << 16 else np.dtype("<u4")

    def word_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal words follow one another: each is encoded once."""
        tok, last = _tokenizer(sent), (None, b"")
        for batch in batches:
            found = batch.column("word").dictionary_encode()
            new = found.dictionary.to_pylist()
            ids = [e.ids for e in tok.encode_batch(new, add_special_tokens=False)] if new != [last[0]] else [None]
            own = [last[1] if w == last[0] else np.array([specials[w]] if w in specials else x, wide).tobytes() for w, x in zip(new, ids, strict=True)]
            if new:
                last = new[-1], own[-1]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("i"), pa.array(own, pa.binary()).take(found.indices)], ["block", "i", "ids"])

    fix_split(spark)  # both scans must cut the same blocks
    others = [c for c in carry if c != "text"]
    used = docs.select("rid", "doc_id", "text", *others)
    carried = "".join(f", `c_{c}` " + ("binary" if c == "text" else docs.schema[c].dataType.simpleString()) for c in carry)
    listed_words = used.mapInArrow(words, "block long, i int, word string")
    dealt = listed_words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word").sortWithinPartitions("word")
    back = dealt.mapInArrow(word_ids, "block long, i int, ids binary")
    coded = used.mapInArrow(codes, "block long, rid long, doc_id long, n int, codes binary" + carried)

    fields = [("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out_schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * ids + [("decoded", pa.string())] * text)
    own_width = len(out_schema)
    for c in carry:
        out_schema = out_schema.append(pa.field(c, to_arrow_type(docs.schema[c].dataType)))
    ddl = "rid long, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * text + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's rows from its words' ids and its texts' word numbers. Numbers stay in flat arrays; a few hundred rows at a time become texts."""
        piece = vocabulary.value
        order = pa.array(np.argsort(left.column("i").to_numpy()))
        coded_words = left.column("ids").combine_chunks().take(order)
        length = pc.binary_length(coded_words).to_numpy() // wide.itemsize
        flat = np.frombuffer(b"".join(coded_words.to_pylist()), wide)
        start = np.cumsum(length) - length
        del left, coded_words
        listed_ids = flat.tolist()
        bounds = list(zip(start.tolist(), (start + length).tolist(), strict=True))
        piece_text = np.array([" ".join(map(piece.__getitem__, listed_ids[x:y])) for x, y in bounds], object)  # the join of ids to pieces
        id_text = np.array([" ".join(map(str, listed_ids[x:y])) for x, y in bounds], object)
        del listed_ids, bounds
        open_up, done = zstandard.ZstdDecompressor().decompress, []
        for part in right.to_batches(max_chunksize=500):
            columns: list[list] = [[] for _ in range(own_width)]
            codes_of = []
            for rid, doc_id, n, packed in zip(*(part.column(c).to_pylist() for c in ("rid", "doc_id", "n", "codes")), strict=True):
                packed = open_up(packed) if n else b""
                code = np.zeros(n, np.int64)
                for k in range(len(packed) // n if n else 0):
                    code |= np.frombuffer(packed, np.uint8, n, k * n).astype(np.int64) << (8 * k)
                whole = " ".join(piece_text[code].tolist())
                joined = " ".join(id_text[code].tolist())
                row = (rid, doc_id, int(length[code].sum()), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(whole.encode("utf-8")).hexdigest())
                for values, x in zip(columns, row, strict=False):
                    values.append(x)
                codes_of.append(code)
                if text:
                    columns[-1].append(whole)
            arrays = [pa.array(values, f.type) for values, f in zip(columns, out_schema, strict=False)]
            if ids:
                code = np.concatenate(codes_of)
                n, first = length[code], start[code]
                ends = np.cumsum(n)
                token = np.arange(int(n.sum())) - np.repeat(ends - n, n) + np.repeat(first, n)
                offsets = np.concatenate(([0], np.cumsum(columns[2]))).astype(np.int32)
                arrays[5] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[token].astype(np.int32)))
            for c in carry:
                came = part.column(f"c_{c}")
                arrays.append(pa.array([open_up(x).decode("utf-8") for x in came.to_pylist()], pa.string()) if c == "text" else came.cast(out_schema.field(c).type))
            done.append(pa.RecordBatch.from_arrays(arrays, schema=out_schema))
        return pa.Table.from_batches(done, out_schema)

    return back.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, ddl)


def op3_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(base(documents(spark, sf_dir)), public_tokenizers.path("word_bpe_49k.json"), ids=False, text=False).drop("rid")
