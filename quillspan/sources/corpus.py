"""Files, manifests and index tables."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillspan import constants as K
from quillspan.functions import text as TX
from quillspan.session import scratch_path

MANIFEST_SCHEMA = (
    "format string, collections array<struct<collectionId:string,label:string,createdAt:string,"
    "entries:array<struct<internalPath:string,relativePath:string,originalPath:string,groupId:string,groupLabel:string>>>>"
)


def _globs_regex(patterns: list[str]) -> str:
    return "(?i)^(?:" + "|".join(re.sub(r"\\z|\\Z", "", fnmatch.translate(p)) for p in patterns) + r")\z"


def scan_corpus(spark: SparkSession, root: str | list[str], patterns: list[str] = K.CORPUS_GLOBS,
                content: bool = True) -> DataFrame:
    """(path, file_name, modified_ms, size_bytes[, content]) of matching files below ``root``.

    Reserved metadata files are skipped.  Without ``content`` the file bodies are
    never opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.substring_index("path", "/", -1)
    rows = files.withColumn("file_name", name).filter(
        F.col("file_name").rlike(_globs_regex(patterns)) & ~F.col("file_name").startswith(K.RESERVED_FILE_PREFIX))
    columns = ["path", "file_name", F.unix_millis("modificationTime").alias("modified_ms"),
               F.col("length").alias("size_bytes")]
    return rows.select(*columns, *(["content"] if content else []))


def read_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``extractor`` (direct, binary-skipped, read-failed) and cleaned ``text``.

    A NUL byte marks a binary file.  Nothing raises: the outcome is a column.
    """
    raw = F.col(content)
    binary = F.contains(raw, F.lit(b"\x00"))
    decoded = TX.clean_text(F.decode(F.when(~binary, raw), "UTF-8"))
    return files.withColumn(
        "extractor", F.when(raw.isNull(), "read-failed").when(binary, "binary-skipped").otherwise("direct")
    ).withColumn("text", F.coalesce(F.when(~binary, decoded), F.lit("")))


def parse_manifest(rows: DataFrame, json: str = "json") -> DataFrame:
    """Manifest entry rows from JSON text; bad JSON, ids and paths that are missing give no row."""
    doc = F.from_json(F.col(json), MANIFEST_SCHEMA)
    collections = rows.select(F.explode(doc["collections"]).alias("c")).filter(F.coalesce("c.collectionId", F.lit("")) != "")
    blank = F.lit("")
    return collections.select(
        F.col("c.collectionId").alias("collection_id"), F.coalesce("c.label", blank).alias("collection_label"),
        F.coalesce("c.createdAt", blank).alias("created_at"), F.explode("c.entries").alias("e"),
    ).filter(F.coalesce("e.internalPath", blank) != "").select(
        "collection_id", "collection_label", "created_at", F.col("e.internalPath").alias("internal_path"),
        F.coalesce("e.relativePath", blank).alias("relative_path"),
        F.coalesce("e.originalPath", blank).alias("original_path"),
        F.coalesce("e.groupId", blank).alias("group_id"), F.coalesce("e.groupLabel", blank).alias("group_label"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entry rows of one or more whole-file JSON manifests."""
    return parse_manifest(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def write_manifest(manifest: DataFrame, root: str | None = None) -> str:
    """Write the manifest rows to a new version directory; the job commit makes it visible as a whole."""
    path = scratch_path(manifest.sparkSession, "manifest") if root is None else root
    manifest.write.parquet(path)
    return path


def index_stamps(fmt: str, root: str, strategy: str, vector_key: str, extractor: str = "1") -> dict[str, str]:
    """The version stamps an index must match to be read."""
    return {"stamp_format": fmt, "stamp_root": root, "stamp_strategy": strategy, "stamp_vectors": vector_key,
            "stamp_extractor": extractor}


def save_index(chunks: DataFrame, sources: DataFrame, stamps: dict[str, str], path: str) -> None:
    """Two Parquet tables partitioned by source type, every row carrying the stamps."""
    for name, rows in (("chunks", chunks), ("sources", sources)):
        for stamp, value in stamps.items():
            rows = rows.withColumn(stamp, F.lit(value))
        rows.write.partitionBy("source_type").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, stamps: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(chunks, sources) whose stamps match; others read as empty.  Rows without path or text are dropped."""
    tables = []
    for name in ("chunks", "sources"):
        rows = spark.read.parquet(f"{path}/{name}")
        for stamp, value in stamps.items():
            rows = rows.filter(F.col(stamp) == value)
        rows = rows.filter(F.coalesce("path", F.lit("")) != "")
        if name == "chunks":
            rows = rows.filter(F.coalesce("text", F.lit("")) != "")
        tables.append(rows.drop(*stamps))
    return tables[0], tables[1]
