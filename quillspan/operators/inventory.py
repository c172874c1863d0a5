"""Corpus inventory: metadata join, roll-ups, filter and selection statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspan.functions import labels as LB, text as T
from quillspan.operators.positions import number_rows

LEGACY_ID, LEGACY_LABEL = "legacy", "Legacy imports"


def attach_metadata(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """sources ⟕ manifest by path; files without an entry go to the legacy collection.

    Of several entries of a path the last counts, by ``ord`` where the manifest has it.  No broadcast is forced: the
    manifest has a row per file.
    """
    fields = ["collection_id", "collection_label", "group_id", "group_label", "relative_path", "original_path"]
    place = F.struct("ord", *fields) if "ord" in manifest.columns else F.struct(*fields)
    meta = (
        manifest.groupBy(F.col("internal_path").alias("path")).agg(F.max_by(F.struct(*fields), place).alias("last"))
        .select("path", "last.*")
    )
    rel = F.coalesce("relative_path", "source_relative_path")
    group = F.coalesce("group_label", LB.group_label(F.col("source_relative_path")))
    return (
        sources.withColumnRenamed("relative_path", "source_relative_path").join(meta, "path", "left")
        .withColumn("found", F.col("collection_id").isNotNull())
        .withColumn("group_label", group)
        .withColumn("collection_id", F.coalesce("collection_id", F.lit(LEGACY_ID)))
        .withColumn("collection_label", F.coalesce("collection_label", F.lit(LEGACY_LABEL)))
        .withColumn("group_id", F.coalesce("group_id", LB.group_id(F.col("collection_id"), F.col("group_label"))))
        .withColumn("relative_path", rel)
        .withColumn("original_path", F.coalesce("original_path", F.lit("")))
        .drop("source_relative_path", "found")
    )


def text_metrics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_count, word_count, char_count)."""
    return docs.select(
        key, T.count_lines(F.col(text)).alias("line_count"), T.count_words(F.col(text)).alias("word_count"),
        F.length(text).alias("char_count"),
    )


def inventory_rollup(sources: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """(level, collection_id, group_id, file_count, chunk_count, total_bytes): total, collection, group.

    ``collections`` adds manifest collections without a file.
    """
    roll = (
        sources.rollup("collection_id", "group_id")
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum("chunk_count").alias("chunk_count"),
             F.sum("size_bytes").alias("total_bytes"), F.grouping_id().alias("gid"))
        .withColumn("level", F.when(F.col("gid") == 0, "group").when(F.col("gid") == 1, "collection").otherwise("total"))
        .drop("gid")
    )
    if collections is None:
        return roll
    empty = collections.select("collection_id").distinct().join(
        sources.select("collection_id").distinct(), "collection_id", "left_anti"
    ).select("collection_id", F.lit(None).cast("string").alias("group_id"), F.lit(0).cast("long").alias("file_count"),
             F.lit(0).cast("long").alias("chunk_count"), F.lit(0).cast("long").alias("total_bytes"),
             F.lit("collection").alias("level"))
    return roll.unionByName(empty)


def inventory_files(sources: DataFrame, previews: DataFrame) -> DataFrame:
    """Per-file inventory rows with preview counts; the nested document is one JSON line per file.

    Nesting stops at the file, so no collection or group is ever gathered in one row;
    the ids on each line rebuild the hierarchy.
    """
    shown = previews.groupBy("path").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("chunk_index", "char_count", "word_count", "preview"))))
        .alias("chunks_preview"),
        F.count(F.lit(1)).alias("preview_count"),
    )
    return (
        sources.join(shown, "path", "left")
        .withColumn("preview_count", F.coalesce("preview_count", F.lit(0)))
        .withColumn("omitted_count", F.greatest(F.lit(0), F.col("chunk_count") - F.col("preview_count")))
        .withColumn("chunks_preview", F.coalesce("chunks_preview", F.lit("[]")))
    )


def inventory_filter(sources: DataFrame, needle: str, fields: list[str]) -> DataFrame:
    """Adds ``visible``: the needle occurs in one of the fields, whatever the case."""
    blob = F.lower(F.concat_ws("\n", *fields))
    return sources.withColumn("visible", blob.contains(needle.strip().lower()) if needle.strip() else F.lit(True))


def visible_ancestors(filtered: DataFrame) -> DataFrame:
    """(collection_id, group_id, visible_files, total_files) of groups with a visible file."""
    return (
        filtered.groupBy("collection_id", "group_id")
        .agg(F.count_if("visible").alias("visible_files"), F.count(F.lit(1)).alias("total_files"))
        .filter("visible_files > 0")
    )


def source_order(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0, by labels, relative path and name without regard to case."""
    labels = [F.lower(c) for c in ("collection_label", "group_label", "relative_path", "file_name")]
    return number_rows(sources, [], [*labels, F.col("path")])


def sort_inventory(sources: DataFrame, by: str = "name") -> DataFrame:
    """``sources`` with ``place``, from 0, by file name or by source type, then path."""
    return number_rows(sources, [], [F.col("file_name" if by == "name" else "source_type"), F.col("path")])


def _not_negative(name: str) -> Column:
    return F.when(F.col(name) < 0, 0).otherwise(F.col(name))


def selection_stats(selected: DataFrame, sources: DataFrame, chunks: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, file_count, total_chars, total_chunks, max_chars, max_chunks).

    A selected file without a source row falls back to its chunks.
    """
    wanted = selected.select(request, "path").distinct()
    from_source = sources.select("path", F.col("char_count").alias("s_chars"), F.col("chunk_count").alias("s_chunks"))
    missing = wanted.select("path").distinct().join(sources.select("path"), "path", "left_anti")
    from_chunks = (
        chunks.join(missing, "path", "left_semi").groupBy("path")
        .agg(F.sum(F.length("text")).alias("c_chars"), F.count(F.lit(1)).alias("c_chunks"))
    )
    zero = F.lit(0).cast("long")
    return (
        wanted.join(from_source, "path", "left").join(from_chunks, "path", "left")
        .withColumn("chars", F.coalesce(_not_negative("s_chars"), "c_chars", zero))
        .withColumn("chunks", F.coalesce(_not_negative("s_chunks"), "c_chunks", zero))
        .groupBy(request)
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum("chars").alias("total_chars"),
             F.sum("chunks").alias("total_chunks"), F.max("chars").alias("max_chars"),
             F.max("chunks").alias("max_chunks"))
    )
