"""Chunk table upkeep, refresh, inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.catalog import derived as D, duck as X
from quillspan.catalog.label_queries import _TYPE as TYPE_SQL, chars_sql, scale_sql
from quillspan.catalog.outline_queries import positioned_chunks
from quillspan.catalog.registry import query
from quillspan.catalog.search_queries import shaped_chunks
from quillspan.catalog.text_queries import tokens_sql
from quillspan.functions import budgets as B, labels as LB, lines as L, text as T
from quillspan.operators import chunks as CH, inventory as IV, refresh as RF
from quillspan.plans import index as IX
from quillspan.session import scratch_path


def copied_chunks(d) -> str:
    """Lines of a document's text written twice, so every chunk has a copy in its file."""
    lines = d.unnest(f"{d.table('documents')}", d.split("text || chr(10) || text", "chr(10)"), "doc_id")
    return f"SELECT doc_id, pos, item AS text FROM ({lines}) AS l"


def _candidates(spark, sf_dir):
    rows = D.frame(spark, sf_dir, copied_chunks)
    return rows.withColumn("fingerprint", T.fingerprint(F.col("text"))).withColumn("kept", L.keep_chunk(F.col("text")))


_COPIES = f"""
    WITH c AS (SELECT *, {X.simplified('text')} AS simple FROM ({D.sql(copied_chunks)})),
    k AS (SELECT *, sha1(simple) AS fp, {X.keep_chunk('text', 'simple')} AS kept FROM c),
    d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fp ORDER BY pos) AS cn FROM k)
    --final
"""
query("drop_duplicates_in_doc", "doc_id:b, pos:b, fp:s", _COPIES + "SELECT doc_id, pos, fp FROM d WHERE cn = 1")(
    lambda spark, sf: CH.drop_duplicates_in_doc(_candidates(spark, sf)).withColumn("fp", F.col("fingerprint")))

query("number_chunks", "doc_id:b, pos:b, chunk_index:b", _COPIES + """
    SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index FROM d WHERE kept AND cn = 1""")(
    lambda spark, sf: CH.number_chunks(CH.drop_duplicates_in_doc(_candidates(spark, sf).filter("kept"))))

query("chunk_tallies", "doc_id:b, candidates:b, filtered:b, duplicates:b, chunks:b", _COPIES + """
    SELECT doc_id, count(*) AS candidates, count(*) FILTER (WHERE NOT kept) AS filtered, count(*) FILTER (WHERE kept AND cn > 1) AS duplicates,
    count(*) FILTER (WHERE kept AND cn = 1) AS chunks FROM d GROUP BY doc_id""")(
    lambda spark, sf: CH.chunk_tallies(_candidates(spark, sf)))


def _shared(spark, sf_dir):
    """Document lines against an index of the French ones, whose vectors are two numbers per line."""
    chunks = D.frame(spark, sf_dir, D.line_chunks).withColumn("fingerprint", T.fingerprint(F.col("text"))).withColumn(
        "embedding", F.lit(None).cast("array<float>"))
    known = chunks.filter("source_role = 'reference'").withColumn("embedding", F.when(
        F.col("doc_id") % 3 > 0, F.array(F.col("doc_id").cast("float"), F.col("chunk_index").cast("float"))))
    return CH.share_embeddings(chunks, known)


query("share_embeddings", "path:s, chunk_index:b, shared:o, e0:d, e1:d", f"""
    WITH c AS (SELECT *, sha1({X.simplified('text')}) AS fp FROM ({D.sql(D.line_chunks)})),
    k AS (SELECT fp, min(struct_pack(p := path, i := chunk_index, d := doc_id)) AS best FROM c WHERE source_role = 'reference' AND doc_id % 3 > 0 GROUP BY fp)
    --final
    SELECT path, chunk_index, best IS NOT NULL AS shared, best.d AS e0, best.i AS e1 FROM c LEFT JOIN k ON c.fp = k.fp""")(
    lambda spark, sf: _shared(spark, sf).withColumn("e0", F.get("embedding", F.lit(0))).withColumn("e1", F.get("embedding", F.lit(1))))


def _old_files(d) -> str:
    """The index of an earlier run: newer, touched, changed and removed files."""
    return (
        f"SELECT CASE WHEN doc_id % 9 = 0 THEN path || '.old' ELSE path END AS path, modified_ms - CASE WHEN doc_id % 9 IN (1, 2, 3) THEN 500 ELSE 0 END AS modified_ms, "
        f"size_bytes, CASE WHEN doc_id % 9 = 2 THEN 'other' WHEN doc_id % 9 = 3 THEN '' ELSE 'h' || {d.text('doc_id')} END AS content_hash, doc_id "
        f"FROM ({D.files(d)}) AS f"
    )


def _now_files(d) -> str:
    return f"SELECT path, modified_ms, size_bytes, 'h' || {d.text('doc_id')} AS content_hash, doc_id FROM ({D.files(d)}) AS f"


_STATUS = f"""
    WITH c AS ({_now_files(D.Duck())}), i AS ({_old_files(D.Duck())}),
    s AS (SELECT coalesce(c.path, i.path) AS path, CASE WHEN c.path IS NULL THEN 'removed' WHEN i.path IS NULL THEN 'new'
        WHEN c.modified_ms = i.modified_ms AND c.size_bytes = i.size_bytes THEN 'unchanged' WHEN i.content_hash <> '' AND c.content_hash = i.content_hash THEN 'touched'
        ELSE 'changed' END AS status FROM c FULL OUTER JOIN i ON c.path = i.path)
    --final
"""


def _status(spark, sf_dir):
    return RF.refresh_status(D.frame(spark, sf_dir, _now_files), D.frame(spark, sf_dir, _old_files))


query("refresh_status", "path:s, status:s", _STATUS + "SELECT path, status FROM s")(_status)

query("removed_files", "path:s", _STATUS + "SELECT path FROM s WHERE status = 'removed'")(
    lambda spark, sf: RF.removed_files(D.frame(spark, sf, _now_files), D.frame(spark, sf, _old_files)))

query("refresh_chunks", "path:s, chunk_index:b, text:s", _STATUS.replace("--final", f""",
    ch AS (SELECT * FROM ({D.sql(D.line_chunks)}))
    --final""") + """
    SELECT ch.path, chunk_index, text FROM ch JOIN s ON ch.path = s.path WHERE status IN ('unchanged', 'touched')
    UNION ALL SELECT ch.path, chunk_index, 'rebuilt ' || text FROM ch JOIN s ON ch.path = s.path WHERE status IN ('new', 'changed')""")(
    lambda spark, sf: _refreshed(spark, sf))


def single_chunk_sql(rows: str) -> str:
    """CTE ``ck``: the rows with a text of one line that make a chunk, which is the cleaned line."""
    return f"""cl AS (SELECT *, {X.normalize_block(X.clean('text'))} AS body FROM ({rows}) WHERE text IS NOT NULL),
    ck AS (SELECT *, sha1(simple) AS fp FROM (SELECT *, {X.simplified('body')} AS simple FROM cl) WHERE body <> '' AND {X.keep_chunk('body', 'simple')})"""


def _states(d) -> str:
    """Message lines as files in two states of a folder: unchanged, touched, changed, new and removed ones."""
    lines = d.unnest(f"{d.table('conversations')}", d.split("text", "chr(10)"), "conv_id, turn")
    return (
        f"SELECT path, file_name, kind, CASE WHEN kind = 3 THEN 'once ' || item ELSE item END AS old_text, item AS now_text, stamp AS old_ms, "
        f"CASE WHEN kind IN (2, 3) THEN stamp + 500 ELSE stamp END AS now_ms FROM (SELECT (conv_id * 8 + turn * 3 + pos) % 5 AS kind, item, "
        f"'chat/' || {d.text('conv_id')} || '-' || {d.text('turn')} || '/' || {d.text('pos')} || '.txt' AS path, {d.text('pos')} || '.txt' AS file_name, "
        f"1000 + turn AS stamp FROM ({lines}) AS l) AS s"
    )


def _state_files(states, side: str):
    text = T.clean_text(F.col(f"{side}_text"))
    return states.select(
        "path", "file_name", F.length(text).cast("long").alias("size_bytes"), F.col(f"{side}_ms").cast("long").alias("modified_ms"),
        F.lit("direct").alias("extractor"), text.alias("text"))


def _refresh_store(spark, sf_dir):
    """A store of the first state brought to the second: (store, status)."""
    from quillspan.plans.store import ChunkStore

    states = D.frame(spark, sf_dir, _states)
    store = ChunkStore.create(spark, scratch_path(spark, "refresh-store"), 8)
    store.refresh(_state_files(states.where("kind <> 1"), "old"))
    return store, store.refresh(_state_files(states.where("kind <> 4"), "now"))


_REFRESH = f"""
    WITH st AS (SELECT *, CASE kind WHEN 0 THEN 'unchanged' WHEN 1 THEN 'new' WHEN 2 THEN 'touched' WHEN 3 THEN 'changed' ELSE 'removed' END AS status
        FROM ({_states(D.Duck())})),
    {single_chunk_sql("SELECT path, status, now_ms, now_text AS text FROM st WHERE kind <> 4")}
    --final
"""

query("refresh_index", "path:s, status:s, chunk_index:b, modified_ms:b, fingerprint:s", _REFRESH + """
    SELECT st.path, st.status, CASE WHEN ck.path IS NOT NULL THEN 0 END AS chunk_index, ck.now_ms AS modified_ms, ck.fp AS fingerprint
    FROM st LEFT JOIN ck ON st.path = ck.path""")(
    lambda spark, sf: (lambda store, status: status.join(store.chunks().drop("version", "bucket"), "path", "left"))(*_refresh_store(spark, sf)))

query("refresh_index_sources", "path:s, modified_ms:b, char_count:b, chunk_count:b", _REFRESH + f"""
    SELECT st.path, st.now_ms AS modified_ms, length({X.clean('now_text')}) AS char_count, CASE WHEN ck.path IS NULL THEN 0 ELSE 1 END AS chunk_count
    FROM st LEFT JOIN ck ON st.path = ck.path WHERE kind <> 4""")(
    lambda spark, sf: _refresh_store(spark, sf)[0].sources())


def _refreshed(spark, sf_dir):
    status = _status(spark, sf_dir)
    chunks = D.frame(spark, sf_dir, D.line_chunks)
    todo = status.filter("status IN ('new', 'changed')").select("path")
    rebuilt = chunks.join(todo, "path", "left_semi").withColumn("text", F.concat(F.lit("rebuilt "), "text"))
    return CH.refresh_chunks(chunks, status, rebuilt)


query("ingest_tallies", "files:b, reused:b, rebuilt:b, hash_reused:b, shared_hits:b, chunks:b", _STATUS.replace("--final", f""",
    c2 AS (SELECT *, sha1({X.simplified('text')}) AS fp FROM ({D.sql(D.line_chunks)})),
    k2 AS (SELECT DISTINCT fp FROM c2 WHERE source_role = 'reference' AND doc_id % 3 > 0)
    --final""") + """
    SELECT count(*) FILTER (WHERE status <> 'removed') AS files, count(*) FILTER (WHERE status IN ('unchanged', 'touched')) AS reused,
    count(*) FILTER (WHERE status IN ('new', 'changed')) AS rebuilt, count(*) FILTER (WHERE status = 'touched') AS hash_reused,
    (SELECT count(*) FROM c2 WHERE fp IN (SELECT fp FROM k2)) AS shared_hits, (SELECT count(*) FROM c2) AS chunks FROM s""")(
    lambda spark, sf: RF.ingest_tallies(_status(spark, sf), _shared(spark, sf)))


def _index(spark, sf_dir):
    files = D.frame(spark, sf_dir, D.shaped).select(
        F.concat(F.lit("kb/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.length("text").alias("size_bytes"),
        (F.col("doc_id") * 1000).alias("modified_ms"), F.lit("direct").alias("extractor"), T.clean_text(F.col("text")).alias("text"))
    return IX.index_corpus(files)


query("index_corpus_chunks", "path:s, chunk_index:b, source_role:s, fingerprint:s, text:s")(lambda spark, sf: _index(spark, sf).chunks)
query("index_corpus_sources", "path:s, chunk_count:b, candidates:b, filtered:b, duplicates:b, chunking_profile:s, zero_chunk_reason:s")(
    lambda spark, sf: _index(spark, sf).sources)

_BATCHES = f"""
    WITH RECURSIVE m AS (SELECT role, conv_id * 1000 + turn AS item_no, length(text) AS chars, {tokens_sql('text')} AS tokens,
        row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn) AS n FROM (SELECT * FROM conversations)),
    b AS (SELECT role, item_no, n, 1 AS cnt, chars AS c, tokens AS t, 0 AS batch_no FROM m WHERE n = 1 UNION ALL
        SELECT role, item_no, n, CASE WHEN fits THEN cnt + 1 ELSE 1 END, CASE WHEN fits THEN c + 1 + chars ELSE chars END,
            CASE WHEN fits THEN t + 4 + tokens ELSE tokens END, CASE WHEN fits THEN batch_no ELSE batch_no + 1 END
        FROM (SELECT m.role, m.item_no, m.n, chars, tokens, cnt, c, t, batch_no, cnt < 4 AND c + 1 + chars <= 1800 AND t + 4 + tokens <= 520 AS fits
            FROM b JOIN m ON m.role = b.role AND m.n = b.n + 1))
    --final
    SELECT role, item_no, batch_no FROM b"""

query("batch_texts", "role:s, item_no:b, batch_no:b", _BATCHES)(
    lambda spark, sf: CH.batch_texts(spark.read.parquet(f"{sf}/conversations.parquet").withColumn(
        "item_no", F.col("conv_id") * 1000 + F.col("turn")), "role", "item_no", slice_rows=64))

query("chunk_preview", "path:s, chunk_index:b, char_count:b, word_count:b, preview:s", f"""
    SELECT path, chunk_index, char_count, word_count, {X.preview('t', 900)} AS preview FROM (SELECT path, chunk_index, length(text) AS char_count, {X.words('text')} AS word_count,
    {X.normalize_block('text')} AS t, row_number() OVER (PARTITION BY path ORDER BY chunk_index) AS r, count(*) OVER (PARTITION BY path) AS n FROM ({shaped_chunks(D.Duck())}))
    WHERE n <= 8 OR r <= 4 OR r > n - 2""")(
    lambda spark, sf: CH.preview_chunks(D.frame(spark, sf, shaped_chunks)))

query("text_metrics", "doc_id:b, line_count:b, word_count:b, char_count:b", f"""
    SELECT doc_id, {X.lines('text')} AS line_count, {X.words('text')} AS word_count, length(text) AS char_count FROM documents""")(
    lambda spark, sf: IV.text_metrics(D.frame(spark, sf, D.documents)))


def inventory_sources(spark, sf_dir):
    """Files with manifest metadata and chunk counts."""
    files = D.frame(spark, sf_dir, D.files).withColumn("source_type", LB.source_type(F.col("file_name"))).withColumn(
        "chunk_count", T.count_lines(F.col("text"))).withColumn("char_count", F.length("text")).drop("text", "lang", "source")
    manifest = D.frame(spark, sf_dir, D.manifest)
    replaced = manifest.withColumn("ord", F.col("ord") - 1_000_000_000).withColumn("group_label", F.lit("replaced later"))
    return IV.attach_metadata(files, replaced.unionByName(manifest))


INVENTORY_SQL = f"""
    WITH f AS (SELECT *, {X.lines('text')} AS chunk_count, length(text) AS char_count FROM ({D.sql(D.files)})),
    inv AS (SELECT f.path, f.file_name, f.doc_id, f.size_bytes, f.chunk_count, f.char_count, coalesce(m.collection_id, 'legacy') AS collection_id,
        coalesce(m.collection_label, 'Legacy imports') AS collection_label, coalesce(m.group_label, f.lang || '/' || f.source) AS group_label,
        coalesce(m.group_id, sha1('legacy|' || f.lang || '/' || f.source)) AS group_id, coalesce(m.relative_path, f.relative_path) AS relative_path,
        coalesce(m.original_path, '') AS original_path FROM f LEFT JOIN ({D.sql(D.manifest)}) m ON f.path = m.internal_path)
    --final
"""
query("attach_metadata", "path:s, collection_id:s, collection_label:s, group_id:s, group_label:s, relative_path:s, original_path:s",
      INVENTORY_SQL + "SELECT * FROM inv")(inventory_sources)

query("inventory_rollup", "lvl:s, collection_id:s, group_id:s, file_count:b, chunk_count:b, total_bytes:b", INVENTORY_SQL + """
    SELECT CASE WHEN grouping(group_id) = 0 THEN 'group' WHEN grouping(collection_id) = 0 THEN 'collection' ELSE 'total' END AS lvl, collection_id, group_id,
    count(*) AS file_count, sum(chunk_count) AS chunk_count, sum(size_bytes) AS total_bytes FROM inv GROUP BY ROLLUP (collection_id, group_id)
    UNION ALL SELECT 'collection', 'empty_' || region_key, NULL, 0, 0, 0 FROM (SELECT CAST(r_regionkey AS VARCHAR) AS region_key FROM region)""")(
    lambda spark, sf: IV.inventory_rollup(inventory_sources(spark, sf), spark.read.parquet(f"{sf}/region.parquet").select(
        F.concat(F.lit("empty_"), F.col("r_regionkey").cast("string")).alias("collection_id"))).withColumnRenamed("level", "lvl"))

query("inventory_files", "path:s, chunk_count:b, preview_count:b, omitted_count:b", INVENTORY_SQL + f"""
    SELECT inv.path, chunk_count, coalesce(n, 0) AS preview_count, greatest(0, chunk_count - coalesce(n, 0)) AS omitted_count FROM inv LEFT JOIN (
    SELECT path, CASE WHEN count(*) <= 8 THEN count(*) ELSE 6 END AS n FROM ({D.sql(D.line_chunks)}) GROUP BY path) p ON inv.path = p.path""")(
    lambda spark, sf: IV.inventory_files(inventory_sources(spark, sf), CH.preview_chunks(D.frame(spark, sf, D.line_chunks))))

_FIELDS = ["collection_label", "group_label", "file_name", "relative_path", "original_path"]


def _filtered(spark, sf_dir):
    return IV.inventory_filter(inventory_sources(spark, sf_dir), " SRC1/ ", _FIELDS)


_VISIBLE = "contains(lower(concat_ws(chr(10), " + ", ".join(_FIELDS) + ")), 'src1/')"
query("inventory_filter", "path:s, visible:o", INVENTORY_SQL + f"SELECT path, {_VISIBLE} AS visible FROM inv")(_filtered)

query("visible_ancestors", "collection_id:s, group_id:s, visible_files:b, total_files:b", INVENTORY_SQL + f"""
    SELECT collection_id, group_id, count(*) FILTER (WHERE {_VISIBLE}) AS visible_files, count(*) AS total_files FROM inv GROUP BY collection_id, group_id
    HAVING count(*) FILTER (WHERE {_VISIBLE}) > 0""")(lambda spark, sf: IV.visible_ancestors(_filtered(spark, sf)))

query("source_order", "path:s, collection_label:s, group_label:s, place:b", INVENTORY_SQL + """
    SELECT path, collection_label, group_label, row_number() OVER (ORDER BY lower(collection_label), lower(group_label), lower(relative_path),
    lower(file_name), path) - 1 AS place FROM inv""")(
    lambda spark, sf: IV.source_order(inventory_sources(spark, sf)))

query("sort_inventory", "path:s, place:b, by_type:b", INVENTORY_SQL.replace("--final", f""",
    ty AS (SELECT path, {TYPE_SQL} AS source_type FROM ({D.sql(D.files)}))
    --final""") + """
    SELECT inv.path, row_number() OVER (ORDER BY file_name, inv.path) - 1 AS place, row_number() OVER (ORDER BY source_type, inv.path) - 1 AS by_type
    FROM inv JOIN ty ON inv.path = ty.path""")(
    lambda spark, sf: (lambda rows: IV.sort_inventory(rows).join(IV.sort_inventory(rows, "type").select(
        "path", F.col("place").alias("by_type")), "path"))(inventory_sources(spark, sf)))


def _selection(spark, sf_dir):
    """Each source as a request for its files; every fourth file has no source row."""
    files = D.frame(spark, sf_dir, D.files)
    wanted = files.select(F.col("source").alias("request_id"), "path")
    sources = files.filter("doc_id % 4 != 0").select("path", F.length("text").alias("char_count"), T.count_lines(F.col("text")).alias("chunk_count"))
    return IV.selection_stats(wanted, sources, D.frame(spark, sf_dir, D.line_chunks))


SELECTION_SQL = f"""
    WITH f AS (SELECT source AS request_id, path, doc_id, length(text) AS s_chars, {X.lines('text')} AS s_chunks FROM ({D.sql(D.files)})),
    c AS (SELECT path, sum(length(text)) AS c_chars, count(*) AS c_chunks FROM ({D.sql(D.line_chunks)}) GROUP BY path),
    j AS (SELECT request_id, CASE WHEN doc_id % 4 <> 0 THEN s_chars ELSE coalesce(c_chars, 0) END AS chars, CASE WHEN doc_id % 4 <> 0 THEN s_chunks ELSE coalesce(c_chunks, 0) END AS chunks
        FROM f LEFT JOIN c ON f.path = c.path),
    sel AS (SELECT request_id, count(*) AS file_count, sum(chars)::BIGINT AS total_chars, sum(chunks)::BIGINT AS total_chunks, max(chars)::BIGINT AS max_chars, max(chunks)::BIGINT AS max_chunks
        FROM j GROUP BY request_id)
    --final
"""
query("selection_stats", "request_id:s, file_count:b, total_chars:b, total_chunks:b, max_chars:b, max_chunks:b", SELECTION_SQL + "SELECT * FROM sel")(_selection)

_TUNE = SELECTION_SQL.replace("--final", f""",
    t0 AS (SELECT request_id, file_count, ex, {chars_sql('32768', 'true', "'gpu'")} AS loc, {scale_sql('greatest(max_chars, total_chars // file_count) * 40', 'greatest(max_chunks, total_chunks // file_count) * 40')} AS sc
        FROM sel, (VALUES (false), (true)) AS e(ex)),
    t1 AS (SELECT *, greatest(14000, (loc - 2200) // greatest(1, least(file_count, 2))) AS per FROM t0),
    t2 AS (SELECT *, least(greatest(20000, least(72000, 28000 + {X.half_up('sc * 24000')} + 3000)), per, loc) AS mx, greatest(800, least(1800, {X.half_up('loc * 0.05::DOUBLE')})) AS fb FROM t1),
    t3 AS (SELECT *, greatest(8, least(18, least(10 + {X.half_up('sc * 6')}, greatest(8, mx // 1800)))) AS cov FROM t2),
    t4 AS (SELECT *, greatest(10, least(24, cov + 4)) AS xcov, least(loc, greatest(mx, least(greatest(22000, per), greatest(22000, loc - 1400)))) AS xmx FROM t3)
    --final""")


@query("study_tuning", "request_id:s, ex:o, coverage:b, hit_floor:b, max_per_file:b, fallback:b, loc:b", _TUNE + f"""
    SELECT request_id, ex, CASE WHEN ex THEN xcov ELSE cov END AS coverage, CASE WHEN ex THEN greatest(14, least(24, xcov + 6)) ELSE greatest(10, least(18, cov + 4)) END AS hit_floor,
    CASE WHEN ex THEN xmx ELSE mx END AS max_per_file, CASE WHEN ex THEN greatest(1200, least(2400, {X.half_up('loc * 0.07::DOUBLE')})) ELSE fb END AS fallback, loc FROM t4""")
def study_tuning(spark, sf_dir):
    rows = _selection(spark, sf_dir).withColumn("ex", F.explode(F.array(F.lit(False), F.lit(True))))
    tuned = B.study_tuning(F.col("file_count"), F.col("total_chars") * 40, F.col("total_chunks") * 40, F.col("max_chars") * 40,
                           F.col("max_chunks") * 40, F.lit(True), F.col("ex"), F.lit(32768), F.lit("gpu"))
    return rows.select("request_id", "ex", tuned.alias("t")).select(
        "request_id", "ex", F.col("t.coverage_per_file").alias("coverage"), F.col("t.hit_floor").alias("hit_floor"),
        F.col("t.max_chars_per_file").alias("max_per_file"), F.col("t.fallback_budget").alias("fallback"), F.col("t.local_budget").alias("loc"))
