"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept, and returns the columns of ``documents``; the last adds the
token ids and the decoded text's digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe_words import encode
from llm.common import base, n_words, shared_folder, written
from llm.line_dedup import line_dedup
from llm.minhash_dedup import near_duplicates
from llm.mixing import mix
from llm.quality_rules import quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of documents, other ones dropped, and a row id; null texts count as empty."""
    return base(docs, "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality(_rows(docs)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go, and documents whose every word was in such lines."""
    out = line_dedup(_rows(docs))
    emptied = (F.size("removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~emptied).withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class stays."""
    rows = _rows(docs)
    kept = near_duplicates(rows.select("rid", "doc_id", "text")).where("rid = class_rid").select("rid")
    return rows.join(kept, "rid", "left_semi").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes the document."""
    mixed = mix(_rows(docs), F.array(F.col("source").cast("string")), n_words(F.col("text")))
    times = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("time")
    return mixed.where("mix_copies > 0").select(*COLUMNS, times).drop("time")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents' columns, the token ids, their number, and the SHA-256 of the decoded text."""
    import public_tokenizers

    rows = _rows(docs)
    coded = encode(rows, public_tokenizers.path("word_bpe_49k.json"), text=False, block=8 << 20, carry=COLUMNS[1:])
    return coded.select(*COLUMNS, "n_tokens", "ids", "decoded_sha256")


STAGES = [("quality rules", quality_rules), ("line dedup", lines), ("near dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: SQL expresses neither the suffix arrays nor the tokenizer. Tests hold the operators, on small tables, and the last stage's tokens against
#: brute force or the library; no brute-force run of all five stages is compared row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
