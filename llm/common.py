"""What the operators share: row ids, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = re.compile(r"[^ \t-\r]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
SPACES_SQL = r"[\x20\x09-\x0D]+"
FILTER_WORDS = 1 << 15  # longs in the fixed-size bitmap that thins out rows before a join


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


ROW_BITS = 32  # of a row id: the row's number in its file; a file's hash has the others


def _file_rows(docs: DataFrame) -> Column | None:
    """A row id from file and row number, None unless ``docs`` is rows of Parquet files, each at most once."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() != "LogicalRelation" or "HadoopFsRelation" not in node.relation().getClass().getName():
        return None
    listed = list(node.relation().location().inputFiles())
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        files = docs.select(path.alias("path"), row.alias("row")).select("path")
    except AnalysisException:  # another format
        return None
    if len(set(listed)) < len(listed):
        return None
    if len(listed) <= 1:
        return row
    hashed = lambda path, seed: F.pmod(F.xxhash64(path, F.lit(seed)), F.lit(1 << (63 - ROW_BITS)))
    counts = files.distinct().agg(F.count(F.lit(1)), *(F.size(F.collect_set(hashed(F.col("path"), k))) for k in range(8))).first()  # a row a file
    seed = next((k for k in range(8) if counts[k + 1] == counts[0]), None)
    return None if seed is None else F.shiftleft(hashed(path, seed), ROW_BITS) + row


def base(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns, with a row id ``rid``.

    The id is the same in each scan, in whatever job and however the scan is
    split: it follows file and row. A table without those is written with its
    ids first. Rows with equal or null doc_id stay apart by it.
    """
    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    rid = _file_rows(docs)
    if rid is None:
        return written(docs.select(*kept, *more, F.monotonically_increasing_id().alias("rid")))
    return docs.select(*kept, *more, rid.alias("rid"))


def fix_split(spark: SparkSession) -> None:
    """From now on the split of files into tasks does not follow the number of cores that are registered when a scan is planned."""
    key = "spark.sql.files.minPartitionNum"
    if not spark.conf.get(key, None):
        spark.conf.set(key, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Shuffle files go when a write ends; the driver keeps no long descriptions of plans that hold a literal array.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "65536"}


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: lineage is cut, lost executors lose nothing. The write's shuffle files go when it ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    try:
        for k, v in WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made; nothing that is still to be computed may read them. Other DataFrames are left alone."""
    for df in tables:
        path = vars(df).pop("written_at", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def pieces(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``; a longer row is a batch of its own."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_SQL)).cast("long")


def fixed_array(values: list[int], kind: str) -> Column:
    """A literal array; split and cast are folded when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def bitmap_of(df: DataFrame, *columns: str) -> Column:
    """A test for columns of these names: false only for values that df lacks. The bitmap has a fixed size, whatever the number of rows."""
    h = F.pmod(F.xxhash64(*columns), F.lit(FILTER_WORDS * 64))
    bits = df.select(h.alias("h")).groupBy(F.shiftright("h", 6).cast("int").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("v"))
    out = [0] * FILTER_WORDS
    for i, v in bits.collect():  # FILTER_WORDS rows at most
        out[i] = v
    array = fixed_array(out, "bigint")
    return F.getbit(F.get(array, F.shiftright(h, 6).cast("int")), h % 64) == 1
