"""The pipeline's stages, and the registered queries, on the smallest table."""

import hashlib
import os
from collections import Counter

import pytest

import corpus_pipeline
from llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[5] == counts[4]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    once = lambda: Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert once() == Counter((r.doc_id, r.n_tokens) for r in docs.collect())


def test_stages_take_odd_tables(spark, docs, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() > 0
        assert stage(spark, empty, "").count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_queries_cover_the_table(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_short_lines_go_too(spark, docs, tmp_path):
    """The query and the stage remove later copies of lines of one or two words as well, and of long ones that repeat few words."""
    rows = [(1, "Les.\nand more of it\nbuy now buy now buy now"), (2, "Les.\n\nnow buy now\nLes Les\nyes no"), (3, "no yes\nLes"), (4, "Les."), (5, None)]
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 0").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed for r in queries.QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "0,2", 3: "0,1", 4: "0", 5: ""}
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect()}
    assert kept == {1: rows[0][1], 2: "\nLes Les\nyes no", 5: ""}


def test_line_dedup_query_by_brute_force(spark, docs, texts, tmp_path):
    """All lines with a word, against every earlier one; equal ids in no particular order are left out."""
    import re

    few = {i: t for i, t in texts if i is not None and i != 140}
    docs.where("doc_id <> 140").write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = [], {}
    for i in sorted(few):
        gone = []
        for k, line in enumerate((few[i] or "").split("\n")):
            s = frozenset(re.findall(r"[^ \t-\r]+", line))
            if s and any(len(s & x) >= 0.8 * len(s | x) - 1e-9 for x in seen):
                gone.append(k)
            if s:
                seen.append(s)
        want[i] = ",".join(map(str, gone))
    assert {r.doc_id: r.removed for r in queries.QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()} == want
