from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspan.llm import queries, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(rows, library):
    """doc_id, start, n_tokens, crc of rows in ascending id order by the library alone."""
    out, at = [], 0
    for doc_id, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_the_library(spark, sf_dir, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(tuple(r) for r in queries.QUERIES["op13_token_store"](spark, sf_dir).collect())
    assert found == expected(docs, library)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_odd_rows(spark, make, tidy, library, encoding):
    store = token_store.write(make(tidy), PATH, encoding=encoding)
    found = token_store.checksums(token_store.read(spark, store)).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted((row[0] for row in tidy), key=lambda k: (k is not None, k))
    assert [r["start"] for r in found] == np.cumsum([0, *(r["n_tokens"] for r in found)]).tolist()[:-1]
    want = sorted((n, c) for _, _, n, c in expected([(0, row[1] or "") for row in tidy], library))
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in found) == want
    assert {r["n_tokens"] for r in found if r["doc_id"] in (1, 2, 9)} == {1}


def test_empty_table(spark, make):
    store = token_store.write(make([]), PATH)
    assert token_store.read(spark, store).count() == 0
    assert token_store.read_span(spark, store, 0, 10).count() == 0
    assert token_store.parts(spark, store).count() == 0


def test_hot_id_is_split(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = token_store.write(spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("one text").alias("text")), PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert token_store.parts(spark, store).count() > 4
    starts = sorted(r["start"] for r in token_store.read(spark, store, ids=False).collect())
    assert starts == list(range(0, 4000 * 3, 3))


def test_spans_and_documents(spark, library):
    source = random.Random(2)
    rows = [(k, " ".join(source.choice(["alpha", "beta", "<|endoftext|>", "γ", "x" * 90]) for _ in range(source.randint(0, 40)))) for k in range(300)]
    every = [i for _, text in rows for i in [*library.encode(text, add_special_tokens=False).ids, 0]]
    store = token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    for first, end in [(0, 1), (0, len(every)), (17, 900), (len(every) - 5, len(every) + 50), (400, 400), (len(every), len(every) + 9)]:
        span = token_store.read_span(spark, store, first, end).orderBy("start").collect()
        assert [i for r in span for i in r["ids"]] == every[first:end]
        assert [r["start"] for r in span] == (first + np.cumsum([0, *(len(r["ids"]) for r in span)])).tolist()[:-1]
    some = token_store.read_documents(spark, store, 30, 41).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["ids"]) for r in some] == [(k, [*library.encode(t, add_special_tokens=False).ids, 0]) for k, t in rows[30:42]]


@pytest.mark.parametrize("encoding, used", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_layout_of_the_files(spark, sf_dir, encoding, used):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = token_store.write(docs.coalesce(1), PATH, encoding=encoding, row_group_bytes=64 << 10, page_bytes=4 << 10, page_rows=50)
    columns = [
        (group, group.column(c)) for name in glob.glob(f"{store}/part-*") for meta in [pq.ParquetFile(name).metadata]
        for g in range(meta.num_row_groups) for group in [meta.row_group(g)] for c in range(group.num_columns)
    ]
    assert all(c.has_offset_index and c.has_column_index for _, c in columns)
    by_name = {c.path_in_schema: c for _, c in columns}
    assert used in by_name["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings
    assert max(g.total_byte_size for g, _ in columns) < 1 << 20


def test_metadata_reads_no_ids(spark, sf_dir):
    store = token_store.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH)
    plan = token_store.read(spark, store, ids=False)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan and "n_tokens" in plan


def test_unknown_encoding(make):
    with pytest.raises(ValueError):
        token_store.write(make([]), PATH, encoding="plain")
