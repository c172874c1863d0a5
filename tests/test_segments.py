"""The one-pass chunker against the line windows and the column functions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillspan.catalog import derived as D
from quillspan.functions import terms as TM, text as T
from quillspan.operators import blocks as BL, chunks as CH, segments as SG
from quillspan.operators.embed import embed_tokens
from quillspan.operators.packing import pack_blocks
from quillspan.plans import index as IX

LINES = ["", "", "  ", "plain words here", "- item", "1. Title", "## head", "```", "~~~", "[[PAGE 2]]", "[[PAGE 3]]", "    indented = 1",
         "Run the following steps:", "Install it:", "$ ls", "a) list", "Notes:", "step 3: do it:", "x => y", "\tTabbed"]


def test_blocks_equal_the_line_windows(spark, sf_dir):
    source = random.Random(6)
    made = [(k, "\n".join(source.choice(LINES) for _ in range(source.randint(0, 40)))) for k in range(400)]
    docs = spark.createDataFrame(made, "doc_id long, text string").unionByName(
        D.frame(spark, sf_dir, D.shaped).select((F.col("doc_id") + 1000).alias("doc_id"), "text")).unionByName(
        D.frame(spark, sf_dir, D.paged).select((F.col("doc_id") + 100000).alias("doc_id"), T.clean_text(F.col("text")).alias("text")))
    windows = {}
    for r in BL.split_blocks(docs).collect():
        windows.setdefault(r.doc_id, []).append((r.block_no, r.block, r.heading))
    listed = {r.doc_id: list(r.blocks) for r in BL.semantic_blocks(docs).collect()}
    for doc_id, text in docs.collect():
        assert SG.segments(text) == [(b, h) for _, b, h in sorted(windows.get(doc_id, []))], (doc_id, text)
        assert SG.text_blocks(text) == listed.get(doc_id, [])


def test_tokens_equal_the_column_function(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", TM.embedding_tokens(F.col("text")).alias("tokens"))
    for text, tokens in docs.collect():
        assert SG.surface_tokens(text) == list(tokens)


def test_chunks_equal_packing_of_windows(spark, sf_dir):
    docs = D.frame(spark, sf_dir, D.shaped).withColumn("source_type", F.lit("doc")).withColumn("size_bytes", F.lit(0))
    old = CH.pack_chunks(CH.with_profile(BL.semantic_blocks(docs).withColumn("source_type", F.lit("doc")).withColumn("size_bytes", F.lit(0))))
    new = SG.chunk_texts(docs)
    texts = lambda rows: {r.doc_id: [c.text for c in r.chunks] for r in rows.select("doc_id", "chunks").collect()}
    assert texts(new.where(F.size("chunks") > 0)) == texts(old)


def test_vectors_split_unlike_blocks_and_are_summed(spark):
    like = "\n\n".join(f"kubernetes cluster node upgrade steps for the kubernetes cluster number {i} " * 6 for i in range(3))
    other = "banana apple cherry fruit salad with sugar and honey on a plate " * 12
    files = spark.createDataFrame([("kb/a.txt", "a.txt", 10, 1, "direct", f"{like}\n\n{other}")],
                                  "path string, file_name string, size_bytes long, modified_ms long, extractor string, text string")
    index = IX.index_corpus(files, vectors=True)
    rows = index.chunks.orderBy("chunk_index").collect()
    blocks = SG.text_blocks(files.first().text)
    want = pack_blocks(blocks, 1200, 520, 1500, 110, [embed_tokens(SG.surface_tokens(b)).tolist() for b in blocks])
    assert [r.text for r in rows] == [t for t, _ in want] and len(rows) >= 2
    assert all(abs(x - y) < 1e-5 for r, (_, v) in zip(rows, want) for x, y in zip(r.embedding, v))
