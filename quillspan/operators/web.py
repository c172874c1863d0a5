"""External search results: allow-list, caps and prompt text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillspan import constants as K
from quillspan.functions import policy as P


def allowed_domain(rows: DataFrame, domains: DataFrame | list[str], url: str = "url") -> DataFrame:
    """Rows whose host is a listed domain or below one; an empty list allows all.

    A host matches a domain exactly when one of its own dot suffixes equals it, so
    the distinct hosts are tested by an equi semi-join on suffixes, and the rows by a
    second one on the hosts that passed.
    """
    spark = rows.sparkSession
    if isinstance(domains, list):
        domains = spark.createDataFrame([(d,) for d in domains], "domain string")
    if domains.isEmpty():
        return rows
    listed = domains.select(F.lower(F.trim("domain")).alias("suffix")).filter("suffix != ''")
    hosted = rows.withColumn("_host", F.lower(P.url_host(F.col(url))))
    parts = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    passed = (
        hosted.select("_host").filter("_host != ''").distinct()
        .select("_host", F.explode(suffixes).alias("suffix")).join(listed, "suffix", "left_semi").select("_host")
    )
    return hosted.join(passed, "_host", "left_semi").drop("_host")


def first_hits(hits: DataFrame, limit: int, request: str = "request_id", order: str = "ord") -> DataFrame:
    """First ``limit`` hits of each request in payload order."""
    rank = Window.partitionBy(request).orderBy(order)
    return hits.withColumn("hit_no", F.row_number().over(rank)).filter(F.col("hit_no") <= limit)


def external_context(hits: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, external_context): hit lines inside the untrusted-data envelope."""
    domain = F.when(F.col("domain") == "", "web").otherwise(F.col("domain"))
    line = F.concat(F.lit("["), domain, F.lit("] "), F.col("title"), F.lit(" -- "), F.col("snippet"))
    begin, end = K.ENVELOPE_MARKERS
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("hit_no", line.alias("l")))), lambda r: r["l"]), "\n\n")
    return hits.groupBy(request).agg(
        F.concat(F.lit(begin + "\n"), body, F.lit("\n" + end)).alias("external_context"))
