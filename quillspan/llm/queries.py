"""Registered queries of this package: one per operator, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspan.llm import (
    bpe, langid, language_model, licenses, mixing, quotient, repair, secrets, simhash, spelling, telephony, token_store,
    windows,
)
from quillspan.llm.common import documents, held_out
from quillspan.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


@query("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; digests of the ids and of the decoded text."""
    done = bpe.encode(documents(spark, sf_dir), TOKENIZER, packed=True, decoded=True)
    return done.select(
        "doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


@query("op2_window_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.remove_repeated(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query("op3_recurrent_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(7, 2)
    scored = language_model.score_documents(documents(spark, sf_dir), ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_language_spans")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out(3, 1)
    found = langid.identify(docs, langid.learn(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query("op5_secret_ledger")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a version of the path that its id names; the ledger starts empty."""
    findings, _ = secrets.scan_versions(documents(spark, sf_dir))
    return findings.select(
        F.col("path").alias("doc_id"), *(secrets.count_kind(k).alias(f"n_{k}") for k in secrets.BASE),
        F.sha2(secrets.spans_text(list(secrets.BASE)).cast("binary"), 256).alias("base_sha256"), secrets.spans_text().alias("spans"),
    )


@query("op6_poisson_mix", mixing.oracle_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "source", F.col("_mix_copy").alias("copy"), F.col("_mix_order").alias("order_key"), "text"
    )


@query("op7_telephony_columns")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = telephony.store(documents(spark, sf_dir))
    read = telephony.decode(stored, outputs=("codec", "payload", "feature"))
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.concat_ws(";", "codec", "feature").alias("feature"),
    )


@query("op8_simhash_components")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op9_quotient_dedup", """
    WITH texts AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
    ), ranked AS (
      SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size
      FROM texts
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient.exact_dedup(documents(spark, sf_dir))


@query("op10_license_join", licenses.brute_force_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage the conversations by hash, repair them, and digest the repaired turns."""
    turns = repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = cut_lineage(repair.repairs(turns), "repairs")
    digests = repair.repaired_digests(turns, found).withColumnRenamed("conv_id", "of")
    return found.join(digests, found["conv_id"].eqNullSafe(digests["of"])).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


@query("op13_token_store")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all token ids, then checksums of what is read back."""
    return token_store.checksums(token_store.read(spark, token_store.write(documents(spark, sf_dir), TOKENIZER)))
