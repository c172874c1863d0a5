"""Corpus reading, page tables and record parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.catalog import derived as D, duck as X
from quillspan.catalog.registry import query
from quillspan.operators import conversation as CV, pages as PG
from quillspan.session import scratch_path
from quillspan.sources import corpus as CP, records as R



def _corpus_files(spark, sf_dir):
    """Documents written as text files, one for each language and source, and scanned again with their content."""
    root = scratch_path(spark, "corpus")
    rows = D.frame(spark, sf_dir, D.documents).select("lang", "source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("lang", "source").sortWithinPartitions("lang", "source", "doc_id")
    ordered.select("lang", "source", "text").write.partitionBy("lang", "source").text(root)
    files = CP.read_text(CP.scan_corpus(spark, root, ["*.txt"]))
    folder = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
    return files.select(folder("lang"), folder("source"), "size_bytes", "extractor", F.sha1(F.encode("text", "UTF-8")).alias("text_sha1"))


query("scan_corpus", "lang:s, source:s, size_bytes:b, extractor:s, text_sha1:s", f"""
    SELECT lang, source, octet_length(encode(t)) AS size_bytes, 'direct' AS extractor, sha1({X.clean('t')}) AS text_sha1 FROM (
    SELECT lang, source, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY lang, source)""")(_corpus_files)


def _contents(spark, sf_dir):
    """Document bytes, some of them with a NUL byte, some missing."""
    raw = F.encode("text", "UTF-8")
    nul = F.concat(raw, F.lit(b"\x00"))
    return D.frame(spark, sf_dir, D.dirty).select("doc_id", F.when(F.col("doc_id") % 10 == 3, nul).when(
        F.col("doc_id") % 10 == 7, F.lit(None)).otherwise(raw).alias("content"))


query("read_text", "doc_id:b, extractor:s, text:s", f"""
    SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN 'binary-skipped' WHEN 7 THEN 'read-failed' ELSE 'direct' END AS extractor,
    CASE WHEN doc_id % 10 IN (3, 7) THEN '' ELSE {X.clean('text')} END AS text FROM ({D.sql(D.dirty)})""")(
    lambda spark, sf: CP.read_text(_contents(spark, sf)))

PAGED = D.sql(D.paged)
RAW_PAGES = f"""
    raw AS ({D.Duck().unnest(f'({PAGED}) AS s', "string_split(text, chr(12))", 'doc_id, len(string_split(text, chr(12))) AS raw_total')}),
    page AS (SELECT doc_id, pos AS raw_page, raw_total, {X.clean_page('item')} AS text FROM raw)"""
_PAGES = f"""{RAW_PAGES},
    pg AS (SELECT doc_id, raw_page, row_number() OVER (PARTITION BY doc_id ORDER BY raw_page) AS page_no, text
        FROM (SELECT doc_id, raw_page, {X.normalize_block('text')} AS text FROM page) WHERE text <> '')"""

query("page_table", "doc_id:b, page_no:b, text:s", f"WITH {_PAGES}\n--final\nSELECT doc_id, page_no, text FROM pg")(
    lambda spark, sf: PG.page_table(D.frame(spark, sf, D.paged)))

query("join_pages", "doc_id:b, text:s", f"""
    WITH {_PAGES}
    --final
    SELECT doc_id, string_agg('[[PAGE ' || page_no || ']]' || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) AS text FROM pg GROUP BY doc_id""")(
    lambda spark, sf: PG.join_pages(PG.page_table(D.frame(spark, sf, D.paged))))

_EDGES = f"""{RAW_PAGES},
    np AS (SELECT doc_id, raw_page, raw_total, {X.normalize_block('text')} AS t FROM page),
    ln AS (SELECT doc_id, raw_page, raw_total, idx - 1 AS pos, n AS total, {X.trimmed('ls[idx]')} AS line FROM (
        SELECT *, unnest(range(1, n + 1)) AS idx FROM (SELECT *, string_split(t, chr(10)) AS ls, len(string_split(t, chr(10))) AS n FROM np WHERE t <> ''))),
    edge AS (SELECT doc_id, side, line, count(*) AS n, any_value(raw_total) AS raw_total FROM (
        SELECT doc_id, raw_total, line, 'header' AS side FROM ln WHERE pos < 3 AND line <> '' AND length(line) <= 180
        UNION ALL SELECT doc_id, raw_total, line, 'footer' FROM ln WHERE pos >= total - 3 AND line <> '' AND length(line) <= 180)
        WHERE raw_total >= 3 GROUP BY doc_id, side, line HAVING count(*) >= greatest(2, any_value(raw_total) // 3))"""

query("repeated_edges", "doc_id:b, side:s, line:s, n:b", f"WITH {_EDGES}\n--final\nSELECT doc_id, side, line, n FROM edge")(
    lambda spark, sf: PG.repeated_edges(PG.raw_pages(D.frame(spark, sf, D.paged))))

query("strip_boilerplate", "doc_id:b, page_no:b, text:s", f"""
    WITH {_EDGES},
    fl AS (SELECT ln.*, EXISTS (SELECT 1 FROM edge e WHERE e.doc_id = ln.doc_id AND e.side = 'header' AND e.line = ln.line) AS h,
        EXISTS (SELECT 1 FROM edge e WHERE e.doc_id = ln.doc_id AND e.side = 'footer' AND e.line = ln.line) AS f FROM ln),
    cut AS (SELECT * FROM (SELECT *, bool_and(h) OVER (PARTITION BY doc_id, raw_page ORDER BY pos) AS gone FROM fl) WHERE NOT gone),
    cut2 AS (SELECT * FROM (SELECT *, bool_and(f) OVER (PARTITION BY doc_id, raw_page ORDER BY pos DESC) AS gone2 FROM cut) WHERE NOT gone2),
    kept AS (SELECT doc_id, raw_page, string_agg(line, chr(10) ORDER BY pos) AS text FROM cut2 WHERE raw_total >= 3 GROUP BY doc_id, raw_page
        UNION ALL SELECT doc_id, raw_page, text FROM page WHERE raw_total < 3),
    fin AS (SELECT doc_id, raw_page, {X.normalize_block('text')} AS text FROM kept)
    --final
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw_page) AS page_no, text FROM fin WHERE text <> ''""")(
    lambda spark, sf: PG.strip_boilerplate(D.frame(spark, sf, D.paged)))

query("needs_ocr", "doc_id:b, raw_page:b, words:b", f"""
    WITH {RAW_PAGES}
    --final
    SELECT doc_id, raw_page, words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw_page) AS n
    FROM (SELECT doc_id, raw_page, {X.words('text')} AS words FROM page) WHERE words < 6) WHERE n <= 150""")(
    lambda spark, sf: PG.needs_ocr(D.frame(spark, sf, D.paged)))


def _manifest_json(spark, sf_dir):
    """One manifest JSON per document; some lack the collection id, some the path, some are cut off."""
    f = D.frame(spark, sf_dir, D.files)
    entry = F.struct(F.when(F.col("doc_id") % 7 != 1, F.col("path")).alias("internalPath"), F.col("relative_path").alias("relativePath"),
                     F.concat(F.lit("/orig/"), "path").alias("originalPath"), F.lit("g1").alias("groupId"), F.col("source").alias("groupLabel"))
    collection = F.struct(F.when(F.col("doc_id") % 5 != 2, F.col("lang")).alias("collectionId"), F.lit("L").alias("label"),
                          F.lit("2024").alias("createdAt"), F.array(entry).alias("entries"))
    json = F.to_json(F.struct(F.lit("v1").alias("format"), F.array(collection).alias("collections")))
    return f.select(F.when(F.col("doc_id") % 11 == 4, F.left(json, F.lit(40))).otherwise(json).alias("json"))


query("read_manifest", "collection_id:s, internal_path:s, relative_path:s, original_path:s, group_label:s", f"""
    SELECT lang AS collection_id, path AS internal_path, relative_path, '/orig/' || path AS original_path, source AS group_label
    FROM ({D.sql(D.files)}) WHERE doc_id % 7 <> 1 AND doc_id % 5 <> 2 AND doc_id % 11 <> 4""")(
    lambda spark, sf: CP.parse_manifest(_manifest_json(spark, sf)))

query("write_manifest", "collection_id:s, internal_path:s, relative_path:s, group_id:s", f"""
    SELECT collection_id, internal_path, relative_path, group_id FROM ({D.sql(D.manifest)})""")(
    lambda spark, sf: spark.read.parquet(CP.write_manifest(D.frame(spark, sf, D.manifest).drop("ord"))))


def _saved_index(spark, sf_dir, stamps_read):
    from quillspan.session import scratch_path

    path = scratch_path(spark, "index")
    chunks = D.frame(spark, sf_dir, D.line_chunks).withColumn("text", F.when(F.col("chunk_index") % 9 == 4, "").otherwise(F.col("text")))
    sources = D.frame(spark, sf_dir, D.files).select("path", "file_name", F.lit("doc").alias("source_type"), "size_bytes")
    stamps = CP.index_stamps("v1", "kb", "blocks", "hash-192")
    CP.save_index(chunks, sources, stamps, path)
    return CP.load_index(spark, path, stamps_read or stamps)


query("save_load_index", "path:s, chunk_index:b, source_type:s, text:s", f"""
    SELECT path, chunk_index, source_type, text FROM ({D.sql(D.line_chunks)}) WHERE chunk_index % 9 <> 4""")(
    lambda spark, sf: _saved_index(spark, sf, None)[0])

query("load_index_other_stamp", "path:s, file_name:s", f"SELECT path, file_name FROM ({D.sql(D.files)}) WHERE false")(
    lambda spark, sf: _saved_index(spark, sf, CP.index_stamps("v2", "kb", "blocks", "hash-192"))[1])


def _conversation_json(spark, sf_dir):
    """One JSON document per message pair start; documents without an id are dropped by the reader."""
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    doc = F.struct(F.when(F.col("turn") % 5 != 4, F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("id"),
                   F.lit("t").alias("title"), F.lit("2024-01-01").alias("updatedAt"),
                   F.array(F.struct("role", F.col("text").alias("content")),
                           F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("content"))).alias("messages"))
    return m.select(F.to_json(doc).alias("json"))


query("read_conversations", "conversation_id:s, turn:b, role:s, content:s", """
    SELECT conv_id || '-' || c.turn AS conversation_id, o.n AS turn, CASE WHEN o.n = 0 THEN role ELSE 'user' END AS role,
    CASE WHEN o.n = 0 THEN text ELSE '' END AS content FROM conversations c, (VALUES (0), (1)) AS o(n) WHERE c.turn % 5 <> 4""")(
    lambda spark, sf: R.read_conversations(_conversation_json(spark, sf)))

query("read_memories", "id:s, key:s, value:s, category:s, updated_at:s, confidence:d, pinned:o", f"""
    SELECT id, CASE WHEN seq % 3 = 0 THEN '' ELSE key END AS key, value, category, updated_at, CASE WHEN seq % 4 = 0 THEN 0 ELSE confidence END AS confidence,
    pinned FROM ({D.sql(D.memories)})""")(
    lambda spark, sf: R.read_memories(D.frame(spark, sf, D.memories).select(F.to_json(F.struct(
        "id", F.when(F.col("seq") % 3 != 0, F.col("key")).alias("key"), "value", "category", F.col("created_at").alias("createdAt"),
        F.col("updated_at").alias("updatedAt"), F.when(F.col("seq") % 4 != 0, F.col("confidence")).alias("confidence"), "pinned")).alias("json"))))


def _stream_lines(spark, sf_dir):
    """Messages as NDJSON lines in five shapes: response, nested content, thinking, error, broken."""
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    none = F.lit(None).cast("string")
    kind = (F.col("conv_id") + F.col("turn")) % 5

    def line(response=none, thinking=none, error=none, done=none, content=none):
        return F.to_json(F.struct(response.alias("response"), thinking.alias("thinking"), error.alias("error"), done.alias("done_reason"),
                                  F.when(content.isNotNull(), F.struct(content.alias("content"))).alias("message"),
                                  F.col("turn").cast("int").alias("prompt_eval_count"), (F.col("turn") * 1000000).cast("double").alias("prompt_eval_duration")))

    t = F.col("text")
    shape = (
        F.when(kind == 0, line(response=t)).when(kind == 1, line(content=t, done=F.lit("length"))).when(kind == 2, line(thinking=t))
        .when(kind == 3, line(response=t, error=F.lit(" boom "))).otherwise(F.concat(F.lit("not json "), t))
    )
    return m.select("conv_id", "turn", F.concat(F.lit("  "), shape).alias("line"))


query("parse_model_stream", "conv_id:b, turn:b, bad_json:o, delta:s, thinking:s, error:s, done_reason:s, eval_count:b, eval_ns:b", """
    SELECT conv_id, turn, k = 4 AS bad_json, CASE WHEN k IN (0, 1) THEN text ELSE '' END AS delta, CASE WHEN k = 2 THEN text ELSE '' END AS thinking,
    CASE WHEN k = 3 THEN 'boom' ELSE '' END AS error, CASE WHEN k = 1 THEN 'length' ELSE '' END AS done_reason,
    CASE WHEN k < 3 THEN turn END AS eval_count, CASE WHEN k < 3 THEN turn * 1000000 END AS eval_ns
    FROM (SELECT *, (conv_id + turn) % 5 AS k FROM conversations)""")(
    lambda spark, sf: R.parse_model_stream(_stream_lines(spark, sf)))


def _vector_json(spark, sf_dir):
    """Vectors as embedding responses: two per response, single legacy ones, errors and empty vectors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v, empty = F.col("embedding"), F.array().cast("array<float>")
    kind = F.col("vec_id") % 4
    return e.select(F.col("vec_id").alias("request_id"), F.to_json(F.struct(
        F.when(kind == 2, "no").alias("error"),
        F.when(kind == 0, F.array(v, F.reverse(v))).when(kind == 2, F.array(v)).when(kind == 3, F.array(v, empty)).alias("embeddings"),
        F.when(kind == 1, v).alias("embedding"))).alias("json"))


query("parse_embedding_payload", "request_id:b, item_no:b, dim:b, x:d", """
    WITH v AS (SELECT vec_id AS request_id, n AS item_no, CASE WHEN n = 0 THEN embedding ELSE list_reverse(embedding) END AS e
        FROM embeddings, (VALUES (0), (1)) AS o(n) WHERE (vec_id % 4 = 0) OR (vec_id % 4 = 1 AND n = 0))
    --final
    SELECT request_id, item_no, idx - 1 AS dim, e[idx] AS x FROM (SELECT *, unnest(range(1, len(e) + 1)) AS idx FROM v)""")(
    lambda spark, sf: R.parse_embedding_payload(_vector_json(spark, sf)).select(
        "request_id", "item_no", F.posexplode("embedding").alias("dim", "x")))

query("export_messages_jsonl", "conv_id:b, line:s", """
    SELECT conv_id, '{"messages":[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn) || ']}' AS line
    FROM conversations GROUP BY conv_id""")(
    lambda spark, sf: CV.message_samples(spark.read.parquet(f"{sf}/conversations.parquet")))
