"""Block segmentation of cleaned text by gaps-and-islands windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quillspan.functions import lines as L, text as T

BLOCK_LIMIT = 1800


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, raw, line): one row per text line, ``line`` trimmed."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw"))
    return lines.withColumn("line", T.trimmed(F.col("raw")))


def _content_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Content lines with what lies in the gap before each: a blank line, a page marker.

    Rows between two content lines share ``gap``, so one window per gap finds the
    last marker and whether a blank line precedes the first one.  A marker after
    the last content line stays as a row of its own.
    """
    order = Window.partitionBy(key).orderBy("pos")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    line, raw = F.col("line"), F.col("raw")
    shaped = (
        explode_lines(docs, key, text)
        .withColumn("marker", L.is_page_marker(line))
        .withColumn("fence", L.is_fence(line) & ~F.col("marker"))
        .withColumn("inside", F.coalesce(F.sum(F.col("fence").cast("int")).over(earlier), F.lit(0)) % 2 == 1)
        .withColumn("content", ~F.col("marker") & (F.col("inside") | (line != "")))
        .withColumn("gap", F.coalesce(F.sum(F.col("content").cast("int")).over(earlier), F.lit(0)))
    )
    gap = Window.partitionBy(key, "gap")
    marker_pos = F.when(F.col("marker"), F.col("pos"))
    blank_pos = F.when(~F.col("marker") & ~F.col("content"), F.col("pos"))
    shaped = (
        shaped.withColumn("first_marker", F.min(marker_pos).over(gap))
        .withColumn("last_marker", F.max(F.when(F.col("marker"), F.struct("pos", "line"))).over(gap))
        .withColumn("first_blank", F.min(blank_pos).over(gap))
        .withColumn("open", F.max("content").over(gap))
    )
    trailing = F.col("marker") & ~F.col("open") & (F.col("pos") == F.col("last_marker.pos"))
    takes_marker = F.col("last_marker").isNotNull() & ~F.col("inside") & ~trailing
    plain = ~F.col("inside") & ~F.col("fence")
    return shaped.filter(F.col("content") | trailing).select(
        key, "pos", "raw", "fence", "inside",
        F.when(takes_marker, F.concat(F.col("last_marker.line"), F.lit("\n"), raw)).otherwise(raw).alias("shown"),
        trailing.alias("trailing"),
        F.col("first_marker").isNotNull().alias("paged"),
        (F.col("first_blank") < F.coalesce("first_marker", "pos")).alias("blank_first"),
        (L.is_heading(line) & plain).alias("heading"),
        (L.is_bullet(line) | L.is_code_like(raw)).alias("structured"),
        L.is_procedural_lead(line).alias("lead"),
        (L.is_procedural_lead(line) | L.is_code_like(raw)).alias("procedural"),
    )


def split_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_no, block, heading): blocks before oversize splitting.

    A block is a run of lines; a fence pair or a heading stands alone, blank lines
    separate, and a structured line starts a new block unless its predecessor is
    structured or introduces it.  A page marker ends a block unless its last lines
    are procedural, and moves to the line that follows it.  Every window starts
    with the key, so the whole chain costs one exchange.
    """
    order = Window.partitionBy(key).orderBy("pos")

    def before(name: str, n: int = 1):
        return F.coalesce(F.lag(name, n).over(order), F.lit(False))

    rows = _content_lines(docs, key, text)
    fresh_structure = (
        F.col("structured") & F.lag("pos").over(order).isNotNull()
        & ~before("structured") & ~before("lead") & ~F.col("inside") & ~F.col("fence")
    )
    rows = rows.withColumn(
        "cut",
        (F.col("fence") & ~F.col("inside")) | F.col("heading") | before("heading")
        | (before("fence") & before("inside")) | F.coalesce("blank_first", F.lit(False))
        | F.col("trailing") | fresh_structure,
    )
    recent = before("procedural") | (
        ~before("cut") & (before("procedural", 2) | (~before("cut", 2) & before("procedural", 3)))
    )
    starts = F.col("cut") | (F.col("paged") & ~F.col("inside") & ~recent)
    return (
        rows.withColumn("starts", starts.cast("int"))
        .withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "island")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda r: r["shown"]),
                         "\n").alias("block"),
            F.max("heading").alias("heading"),
        )
        .withColumn("block", T.normalize_block(F.col("block")))
        .filter(F.col("block") != "")
        .select(key, (F.row_number().over(Window.partitionBy(key).orderBy("island")) - 1).alias("block_no"),
                "block", "heading")
    )


def split_oversized(blocks: DataFrame, text: str = "block", limit: int = BLOCK_LIMIT) -> DataFrame:
    """Adds ``pieces``: the text itself, or its cuts when longer than ``limit``.

    Only oversize texts are sent to the Python worker.
    """
    from quillspan.operators.packing import split_text

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t, limit))

    norm = T.normalize_block(F.col(text))
    long = F.length(norm) > limit
    small = F.filter(F.array(norm), lambda p: p != "")
    return blocks.withColumn("pieces", F.coalesce(cut(F.when(long, norm)), small))


def semantic_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blocks): the ordered block list of each document, oversize blocks cut."""
    pieces = split_oversized(split_blocks(docs, key, text))
    pieces = pieces.withColumn(
        "pieces", F.when(F.col("heading"), F.array(F.col("block"))).otherwise(F.col("pieces"))
    )
    return pieces.groupBy(key).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "pieces"))),
                              lambda r: r["pieces"])).alias("blocks")
    )
