"""Incremental refresh: what changed between the files and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def refresh_status(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, status): unchanged, touched, changed, new or removed.

    Unchanged means equal time and size; touched means equal content hash only.
    One shuffle by path; the hash is compared only where it is needed.
    """
    c = current.select("path", F.col("modified_ms").alias("c_ms"), F.col("size_bytes").alias("c_size"),
                       F.col("content_hash").alias("c_hash"))
    i = indexed.select("path", F.col("modified_ms").alias("i_ms"), F.col("size_bytes").alias("i_size"),
                       F.col("content_hash").alias("i_hash"))
    status = (
        F.when(F.col("c_ms").isNull(), "removed").when(F.col("i_ms").isNull(), "new")
        .when((F.col("c_ms") == F.col("i_ms")) & (F.col("c_size") == F.col("i_size")), "unchanged")
        .when((F.col("i_hash") != "") & (F.col("c_hash") == F.col("i_hash")), "touched")
        .otherwise("changed")
    )
    return c.join(i, "path", "full_outer").select("path", status.alias("status"))


def removed_files(current: DataFrame, indexed: DataFrame) -> DataFrame:
    return indexed.join(current.select("path"), "path", "left_anti")


def ingest_tallies(statuses: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files by outcome, chunk count and shared-embedding hits."""
    files = statuses.filter("status != 'removed'").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("status").isin("unchanged", "touched")).alias("reused"),
        F.count_if(F.col("status").isin("new", "changed")).alias("rebuilt"),
        F.count_if(F.col("status") == "touched").alias("hash_reused"),
    ).withColumn("one", F.lit(1))
    parts = chunks.agg(
        F.count_if("shared").alias("shared_hits"), F.count(F.lit(1)).alias("chunks")
    ).withColumn("one", F.lit(1))
    return files.join(parts, "one").drop("one")
