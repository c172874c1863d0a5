"""Web pages: snippets, hosts, payloads, allow-list."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan import constants as K
from quillspan.catalog import derived as D, duck as X
from quillspan.catalog.registry import query
from quillspan.functions import policy as P
from quillspan.operators import web as W
from quillspan.sources import records as R

def _pages(spark, sf_dir):
    return D.frame(spark, sf_dir, lambda d: f"SELECT * FROM {d.table('pages')}")


query("html_snippet", "page_id:b, t:s", f"SELECT page_id, {X.html_snippet('html')} AS t FROM pages")(
    lambda spark, sf: _pages(spark, sf).select("page_id", P.html_snippet(F.col("html")).alias("t")))

query("url_host", "page_id:b, host:s", f"SELECT page_id, {X.host('url')} AS host FROM pages")(
    lambda spark, sf: _pages(spark, sf).select("page_id", P.url_host(F.col("url")).alias("host")))


def _payloads(spark, sf_dir):
    """One JSON payload per page: the page itself, under a snippet key in turn, and a result without text."""
    page = _pages(spark, sf_dir)
    body = [F.when(F.col("page_id") % 6 == i, F.col("html")).alias(k) for i, k in enumerate(K.SNIPPET_KEYS)]
    lists = F.when(F.col("page_id") % 6 == 5, F.array(F.substring("html", 1, 400), F.lit(""), F.col("html"), F.lit("never"))).alias("descriptions")
    first = F.struct(F.concat(F.lit("<b>"), "url", F.lit("</b>")).alias("title"), F.concat(F.lit(" "), "url").alias("url"), *body, lists)
    empty = F.struct(F.lit(" ").alias("title"), F.col("url"), *[F.lit(None).cast("string").alias(k) for k in K.SNIPPET_KEYS],
                     F.lit(None).cast("array<string>").alias("descriptions"))
    return page.select(F.col("page_id").alias("request_id"), F.to_json(F.struct(F.array(first, empty, first).alias("results"))).alias("json"))


_HIT = f"""
    WITH s AS (SELECT page_id, url, {X.html_snippet('html')} AS full_text, {X.html_snippet('left(html, 400)')} AS head FROM pages),
    c AS (SELECT page_id AS request_id, url, {X.html_snippet("'<b>' || url || '</b>'")} AS title,
        CASE WHEN page_id % 6 < 5 THEN full_text ELSE {X.simplified("head || ' ' || full_text || CASE WHEN length(head) + 1 + length(full_text) >= 900 THEN '' ELSE ' never' END")} END AS content FROM s),
    hit AS (SELECT request_id, ord, title, url, {X.trimmed('left(content, 900)')} AS snippet, {X.host('url')} AS domain
        FROM c, (VALUES (0), (2)) AS o(ord))
    --final
"""

query("parse_search_payload", "request_id:b, ord:b, title:s, url:s, snippet:s, domain:s", _HIT + "SELECT * FROM hit")(
    lambda spark, sf: R.parse_search_payload(_payloads(spark, sf)))

DOMAINS = ["example.com", "m.ththth.example.net", " EXAMPLE.org "]
_ALLOWED = " OR ".join(f"lower(domain) = '{d.strip().lower()}' OR ends_with(lower(domain), '.{d.strip().lower()}')" for d in DOMAINS)

query("allowed_domain", "page_id:b, url:s", f"SELECT page_id, url FROM (SELECT page_id, url, {X.host('url')} AS domain FROM pages) WHERE {_ALLOWED}")(
    lambda spark, sf: W.allowed_domain(_pages(spark, sf).select("page_id", "url"), DOMAINS))

query("first_external_hits", "domain:s, hit_no:b, request_id:b, ord:b", _HIT + """
    SELECT domain, hit_no, request_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY request_id, ord) AS hit_no FROM hit)
    WHERE hit_no <= 2""")(
    lambda spark, sf: W.first_hits(
        R.parse_search_payload(_payloads(spark, sf)).withColumn("seq", F.struct("request_id", "ord")), 2, "domain", "seq"))

query("external_context", "request_id:b, external_context:s", _HIT + f"""
    SELECT request_id, '{K.ENVELOPE_MARKERS[0]}' || chr(10) || string_agg('[' || CASE WHEN domain = '' THEN 'web' ELSE domain END || '] ' || title || ' -- ' || snippet,
    chr(10) || chr(10) ORDER BY ord) || chr(10) || '{K.ENVELOPE_MARKERS[1]}' AS external_context FROM hit GROUP BY request_id""")(
    lambda spark, sf: W.external_context(W.first_hits(R.parse_search_payload(_payloads(spark, sf)), 2)))
