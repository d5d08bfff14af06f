"""Token counts by the whole-token shortcut.

A pre-token is a run of spaces and the characters up to the next space or
line end. Two facts are proved offline from the vocabulary, on the driver:

* no piece has a space after another character, and none holds a line end,
  so merges never cross a pre-token's border;
* which strings of the vocabulary, taken as a pre-token, encode as one token.

Pre-tokens in that proven set count one each; the rest are merged by the
library, once per distinct string while it stays in a bounded memory.
A vocabulary for which the first fact fails is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import base, documents, pieces

SPACE = "▁"
PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
REMEMBERED = 400_000


def _processor(model: bytes):
    """The library without its leading space: the caller puts that in front of the text."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    spec = proto.normalizer_spec
    if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("the shortcut needs a model that leaves texts as they are")
    prefix, spec.add_dummy_prefix = spec.add_dummy_prefix, False
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), prefix, proto


@lru_cache(maxsize=4)
def prove(path: str) -> tuple[bytes, frozenset[str]]:
    """The model's bytes and the pre-tokens that are one token each."""
    with open(path, "rb") as f:
        model = f.read()
    sp, _, proto = _processor(model)
    texts = [p.piece for p in proto.pieces if p.type in (1, 4)]
    if any(SPACE in t.lstrip(SPACE) or "\n" in t or " " in t for t in texts):
        raise ValueError("a piece of this vocabulary crosses words")
    strings = [s for s in (t.replace(SPACE, " ") for t in texts) if PRE_TOKEN.fullmatch(s)]
    return model, frozenset(s for s, ids in zip(strings, sp.encode(strings), strict=True) if len(ids) == 1)


class Counts(dict):
    """Pre-token -> number of tokens; the proven ones are there from the start, others are merged when first met."""

    def __init__(self, sp, whole: frozenset[str]) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.encode, self.whole, self.least = sp.encode, whole, len(whole)

    def __missing__(self, pre: str) -> int:
        if len(self) > self.least + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = len(self.encode(pre))
        if len(pre) <= 64:
            self[pre] = n
        return n


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and n_whole (tokens counted by the shortcut alone) of each row.

    ``model_path`` is read on the driver only. Null text: empty, no tokens.
    Null doc_id: stays null. Equal rows each get a row. Other columns are ignored.
    """
    model, whole = prove(model_path)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model, whole))  # bounded by the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, whole = sent.value
        sp, prefix, _ = _processor(model)
        counts, lead = Counts(sp, whole), " " if prefix else ""
        for batch in pieces(batches):
            n_tokens, n_whole = [], []
            for text in batch.column("text").to_pylist():
                pre = PRE_TOKEN.findall((lead + text).replace(SPACE, " ")) if text else []
                n_tokens.append(sum(map(counts.__getitem__, pre)))
                n_whole.append(sum(map(whole.__contains__, pre)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n_tokens, pa.int64()), pa.array(n_whole, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "n_whole"],
            )

    rows = base(docs).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, n_whole long")


def op2_token_counts(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    import public_tokenizers

    counted = token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_whole")
