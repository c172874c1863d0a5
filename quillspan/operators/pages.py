"""Page tables, repeated header and footer removal, OCR audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspan.functions import text as T

PROBE_LINES = 3
PROBE_CHARS = 180


def raw_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, raw_page, text, raw_total): every form-feed separated page, blank ones included."""
    # the arrays are made before the explode, else they would be made again for every page
    split = docs.select(
        key, F.split(T.clean_page_text(F.col(text)), "\f").alias("_pages"), F.size(F.split(F.col(text), "\f")).alias("raw_total"))
    return split.select(key, F.posexplode("_pages").alias("raw_page", "text"), "raw_total")


def page_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page_no, text): non-blank pages numbered from one."""
    return number_pages(raw_pages(docs, key, text), key)


def number_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    order = Window.partitionBy(key).orderBy("raw_page")
    return (
        pages.withColumn("text", T.normalize_block(F.col("text"))).filter("text != ''")
        .withColumn("page_no", F.row_number().over(order)).select(key, "page_no", "text")
    )


def join_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): pages joined with numbered page markers."""
    block = F.concat(F.lit("[[PAGE "), F.col("page_no").cast("string"), F.lit("]]\n"), F.col("text"))
    return pages.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("page_no", block.alias("block")))), lambda r: r["block"]),
            "\n\n").alias("text")
    )


def _page_lines() -> Column:
    """The trimmed lines of the normalised page; a blank page has none."""
    lines = F.transform(F.split(T.normalize_block(F.col("text")), "\n"), T.trimmed)
    return F.when(~T.is_blank(F.col("text")), lines).otherwise(F.array().cast("array<string>"))


def repeated_edges(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, side, line, n): lines repeated among the first or last three of the pages of a document."""
    lined = pages.filter("raw_total >= 3").select(key, "raw_total", _page_lines().alias("lines"))
    first = F.greatest(F.size("lines") - (PROBE_LINES - 1), F.lit(1))
    on = lambda side, lines: F.transform(lines, lambda x: F.struct(F.lit(side).alias("side"), x.alias("line")))
    edges = F.concat(on("header", F.slice("lines", 1, PROBE_LINES)), on("footer", F.slice("lines", first, PROBE_LINES)))
    threshold = F.greatest(F.lit(2), F.floor(F.col("raw_total") / 3))
    return (
        lined.select(key, "raw_total", F.explode(edges).alias("e")).select(key, "raw_total", "e.side", "e.line")
        .filter((F.col("line") != "") & (F.length("line") <= PROBE_CHARS))
        .groupBy(key, "side", "line", "raw_total").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= threshold).drop("raw_total")
    )


def _without_run(lines: Column, known: str) -> Column:
    """``lines`` (pos, line) from the first that is not among ``known``."""
    other = F.array_position(F.transform(lines, lambda x: ~F.array_contains(F.col(known), x["line"])), True).cast("int")
    return F.when(other > 0, F.slice(lines, F.greatest(other, F.lit(1)), F.size(lines))).otherwise(F.slice(lines, 1, 0))


def strip_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page_no, text): page table without leading header runs and trailing footer runs.

    A line is cut while every line above it on the page is a repeated header, or
    every line below it a repeated footer.  Header cuts come first.

    Pages move once, to the task of their document; the lines of a page stay in its row.  Rows that repeat an id share
    their pages.
    """
    none = F.array().cast("array<string>")
    lines_of = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("line")))
    edges = repeated_edges(raw_pages(docs, key, text), key).groupBy(key).agg(
        lines_of("header").alias("heads"), lines_of("footer").alias("feet"))
    multi = F.col("raw_total") >= 3
    placed = F.when(F.col(key).isNotNull(), F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x.alias("line"))))
    pages = raw_pages(docs, key, text).withColumn("lines", _page_lines()).select(
        key, "raw_page", F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("apart"),
        F.when(~multi, F.col("text")).alias("few"), multi.alias("multi"), placed.alias("lines"))
    grouped = pages.repartition(F.col(key)).groupBy(key, "raw_page", "apart").agg(
        F.collect_list("few").alias("few"), F.when(F.col(key).isNotNull(), F.count_if("multi")).otherwise(0).cast("int").alias("copies"),
        F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"))
    known = grouped.join(edges, key, "left").withColumn("heads", F.coalesce("heads", none)).withColumn("feet", F.coalesce("feet", none))
    headless = known.withColumn("lines", _without_run(F.col("lines"), "heads")).withColumn("lines", F.reverse("lines"))
    bare = headless.withColumn("lines", F.reverse(_without_run(F.col("lines"), "feet")))
    stripped = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    shown = F.concat("few", F.array_repeat(stripped, F.col("copies")))
    return number_pages(bare.select(key, "raw_page", F.explode(shown).alias("text")), key)


def needs_ocr(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 150,
              min_words: int = 6) -> DataFrame:
    """(key, raw_page, words): pages with fewer than ``min_words`` words, at most ``limit`` per document."""
    order = Window.partitionBy(key).orderBy("raw_page")
    return (
        raw_pages(docs, key, text).withColumn("words", T.count_words(F.col("text")))
        .filter(F.col("words") < min_words)
        .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
        .select(key, "raw_page", "words")
    )
