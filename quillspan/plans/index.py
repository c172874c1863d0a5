"""Corpus indexing: files to sources and chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quillspan.functions import labels as LB, text as T
from quillspan.operators import chunks as CH, embed as EM, segments as SG
from quillspan.session import cut_lineage


@dataclass
class Index:
    """Result tables of one indexing run."""

    sources: DataFrame
    chunks: DataFrame


def classify(files: DataFrame) -> DataFrame:
    """Adds source_type, source_role and the text measures to (path, file_name, text, ...)."""
    text = F.col("text")
    kind = LB.source_type(F.col("file_name"))
    return (
        files.withColumn("source_type", kind)
        .withColumn("source_role", LB.source_role(F.col("file_name"), F.col("path"), F.col("source_type"), text))
        .withColumn("char_count", F.length("text")).withColumn("line_count", T.count_lines(text))
        .withColumn("word_count", T.count_words(text))
    )


def candidate_chunks(files: DataFrame, semantic: bool = False) -> DataFrame:
    """(path, file facts, pos, text, embedding, fingerprint, kept, blocks): chunk candidates of each file, made in its row."""
    facts = ["path", "file_name", "source_type", "source_role", "size_bytes", "modified_ms"]
    packed = SG.chunk_texts(files.select(*facts, "text"), semantic, keep_text=False)
    return CH.explode_chunks(packed, [*facts, "blocks_n", "profile_label"])


def index_corpus(files: DataFrame, known: DataFrame | None = None, vectors: bool = False) -> Index:
    """Chunk and source tables of cleaned files.

    files: path, file_name, size_bytes, modified_ms, extractor, text.  ``known`` is an
    indexed chunk table whose vectors are shared by fingerprint.  ``vectors`` packs by
    block vectors and gives every chunk the sum of its blocks'.  Candidates are
    written once, since both result tables and the vectors read them.
    """
    rich = classify(files)
    candidates = cut_lineage(candidate_chunks(rich, vectors), "candidates")
    kept = CH.drop_duplicates_in_doc(candidates.filter("kept"), "path")
    chunks = CH.number_chunks(kept, "path").select(
        "path", "file_name", "source_type", "source_role", "chunk_index", "text", "fingerprint", "embedding",
        "modified_ms")
    if known is not None:
        chunks = CH.share_embeddings(chunks, known)
    if vectors:
        fresh = EM.hash_embed(chunks.filter("embedding IS NULL"), ["path", "chunk_index"]).withColumnRenamed(
            "embedding", "fresh")
        chunks = chunks.join(fresh, ["path", "chunk_index"], "left").withColumn(
            "embedding", F.coalesce("embedding", "fresh")).drop("fresh")
    tallies = CH.chunk_tallies(candidates, "path")
    shape = candidates.groupBy("path").agg(F.max("blocks_n").alias("blocks_n"),
                                           F.max("profile_label").alias("chunking_profile"))
    zero = F.lit(0)
    sources = (
        rich.drop("text").join(tallies, "path", "left").join(shape, "path", "left")
        .withColumn("chunk_count", F.coalesce("chunks", zero))
        .withColumn("zero_chunk_reason", F.when(F.col("chunk_count") > 0, "").otherwise(LB.zero_chunk_reason(
            F.col("extractor") == "direct", F.col("extractor"), F.col("char_count"), F.col("word_count"),
            F.coalesce("blocks_n", zero), F.coalesce("candidates", zero), F.coalesce("filtered", zero),
            F.coalesce("duplicates", zero))))
        .withColumn("chunking_profile", F.coalesce("chunking_profile", F.lit("unavailable")))
        .drop("chunks", "blocks_n")
    )
    return Index(sources, chunks)


def refresh_index(current: DataFrame, sources: DataFrame, chunks: DataFrame) -> Index:
    """Index of ``current``: unchanged and touched files keep their chunks, the others are rebuilt.

    ``sources`` carries path, modified_ms, size_bytes and content_hash of the last run.
    """
    from quillspan.operators.refresh import refresh_status

    status = cut_lineage(refresh_status(current, sources), "refresh-status")
    todo = status.filter(F.col("status").isin("new", "changed")).select("path")
    rebuilt = index_corpus(current.join(todo, "path", "left_semi"), chunks)
    kept = status.filter(F.col("status").isin("unchanged", "touched"))
    stamps = current.select("path", F.col("modified_ms").alias("now_ms"), F.col("size_bytes").alias("now_bytes"))
    kept_sources = (
        sources.join(kept.select("path"), "path", "left_semi").join(stamps, "path")
        .withColumn("modified_ms", F.col("now_ms")).withColumn("size_bytes", F.col("now_bytes"))
        .drop("now_ms", "now_bytes")
    )
    return Index(
        kept_sources.unionByName(rebuilt.sources, allowMissingColumns=True),
        CH.refresh_chunks(chunks, status.join(stamps.select("path", "now_ms"), "path", "left"), rebuilt.chunks),
    )
