"""Corpus pipeline: the stages between a raw document table and token ids, each written as Parquet and read again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspan.llm import bpe, langid, mixing, nearcopies, quotient
from quillspan.llm.common import SEPARATORS, small, utf8
from quillspan.llm.queries import TOKENIZER
from quillspan.session import cut_lineage

#: A document goes if no language has this share of its words; mixed texts of up to three languages stay.
LEAST_LANGUAGE_SHARE = 0.25


def _row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row_sha`` appended, the digest of the text without separators; with the id it tells rows apart."""
    docs = docs.drop("_row_sha")
    schema = StructType([*docs.schema.fields, StructField("_row_sha", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1024):
            digests = [hashlib.sha256(t.translate(None, SEPARATORS)).hexdigest() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "_row_sha"])

    return docs.mapInArrow(run, schema)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language stay; texts that are null or have no letter go.

    Learns from all rows that have a text and a label.  Without any label nothing can be told apart and all rows go.
    """
    return langid.keep_identified(docs, langid.learn(docs), LEAST_LANGUAGE_SHARE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without separators the longest row with the smallest id stays; of rows that repeat an id
    and its text one stays."""
    kept = quotient.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    keyed = _row_key(docs).withColumn("_length", F.coalesce(F.char_length("text"), F.lit(0)))
    rows = keyed.join(kept.distinct(), (F.col("_row_sha") == F.col("_kept_sha")) & F.col("doc_id").eqNullSafe(F.col("_kept_id")))
    longest = rows.groupBy("doc_id", "_row_sha").agg(F.max_by(F.struct(*docs.columns), "_length").alias("row"))
    return longest.select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard similarity 0.8 or more) the document with the smallest
    id stays; rows without an id stay."""
    gone = nearcopies.near_copies(docs).select(F.col("doc_id").alias("_gone_id"), F.col("sha").alias("_gone_sha"))
    same = (docs["doc_id"] == F.col("_gone_id")) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == F.col("_gone_sha"))
    return docs.join(gone, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson draw says, in a global random order."""
    return mixing.mix(docs).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_tokens),
]
#: Language spans have no SQL form, so neither have the rows that follow from them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
