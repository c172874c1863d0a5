"""Blocks, outlines, anchors, spans, packets over shaped documents."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillspan import constants as K
from quillspan.catalog import derived as D, duck as X
from quillspan.catalog.registry import query
from quillspan.catalog.search_queries import shaped_chunks
from quillspan.catalog.text_queries import _LINE_SQL
from quillspan.operators import blocks as BL, chunks as CH, outline as O, segments as SG
from quillspan.plans import study as ST
from quillspan.session import cut_and_clean

_RULES = f"""{_LINE_SQL.split('--final')[0]},
    f AS (SELECT *, {X.is_fence('line')} AS fence, {X.is_bullet('line')} OR {X.is_code('raw', 'line')} AS st, {X.is_lead('line')} AS lead FROM line),
    g AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM f),
    h AS (SELECT *, {X.is_heading('line')} AND NOT inside AND NOT fence AS head, line = '' AND NOT inside AS blank FROM g),
    p AS (SELECT *, lag(blank) OVER w AS pb, lag(head) OVER w AS ph, lag(fence AND inside) OVER w AS pc, lag(st) OVER w AS ps, lag(lead) OVER w AS pl, lag(pos) OVER w AS pp
        FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    b AS (SELECT *, (fence AND NOT inside) OR head OR coalesce(ph, false) OR coalesce(pc, false) OR coalesce(pb, false)
        OR (st AND NOT inside AND NOT fence AND pp IS NOT NULL AND NOT pb AND NOT ph AND NOT pc AND NOT ps AND NOT pl) AS starts FROM p),
    i AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b),
    k AS (SELECT doc_id, island, string_agg(raw, chr(10) ORDER BY pos) AS blk, bool_or(head) AS heading FROM i WHERE NOT blank GROUP BY doc_id, island),
    n AS (SELECT doc_id, island, heading, {X.normalize_block('blk')} AS block FROM k)
    --final
"""
query("split_blocks", "doc_id:b, block_no:b, block:s, heading:o", _RULES + """
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS block_no, block, heading FROM n WHERE block <> ''""")(
    lambda spark, sf: BL.split_blocks(D.frame(spark, sf, D.shaped)))

query("split_paged_blocks", "doc_id:b, block_no:b, block:s")(lambda spark, sf: _paged_blocks(spark, sf))


def _paged_blocks(spark, sf_dir):
    from quillspan.operators import pages as PG

    return BL.split_blocks(PG.join_pages(PG.page_table(D.frame(spark, sf_dir, D.paged))))


def _last(x: str, needle: str, size: int) -> str:
    head = f"left({x}, 1800 + {size})"
    return f"CASE WHEN contains({head}, {needle}) THEN length({head}) - strpos(reverse({head}), reverse({needle})) - {size - 1} ELSE -1 END"


query("split_oversized", "doc_id:b, piece_no:b, piece:s", f"""
    WITH RECURSIVE t AS (SELECT doc_id, 0 AS step, {X.normalize_block('text')} AS rest, '' AS piece FROM documents
        UNION ALL SELECT doc_id, step + 1, CASE WHEN cut < 0 THEN '' ELSE ltrim(substr(rest, cut + 1), '{K.WS_CHARS}') END,
            {X.trimmed('CASE WHEN cut < 0 THEN rest ELSE left(rest, cut) END')}
        FROM (SELECT doc_id, step, rest, CASE WHEN length(rest) <= 1800 THEN -1
            WHEN ({_last('rest', 'chr(10) || chr(10)', 2)}) >= 900 THEN ({_last('rest', 'chr(10) || chr(10)', 2)})
            WHEN ({_last('rest', 'chr(10)', 1)}) >= 900 THEN ({_last('rest', 'chr(10)', 1)})
            WHEN ({_last('rest', "' '", 1)}) >= 900 THEN ({_last('rest', "' '", 1)}) ELSE 1800 END AS cut FROM t WHERE rest <> ''))
    --final
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS piece_no, piece FROM t WHERE step > 0 AND piece <> ''""")(
    lambda spark, sf: BL.split_oversized(D.frame(spark, sf, D.documents), "text").select(
        "doc_id", F.posexplode("pieces").alias("piece_no", "piece")))

_CAND = f"""{_LINE_SQL.split('--final')[0]},
    cand AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM line WHERE line <> '' AND NOT {X.is_marker('line')}),
    fl AS (SELECT *, {X.is_contents('line')} AS ct, {X.matches('line', K.RE_NUMBER_ONLY)} AS num, {X.matches('line', K.RE_TOP_NUMBER)} AS tnum,
        {X.is_heading('line')} AS hd, {X.one_of('lower(line)', K.OUTLINE_RESERVED)} AS rsv, {X.matches('line', K.RE_TOP_HEADING)} AS top,
        {X.strip_page('line')} AS stripped, {X.is_contents('nxt')} AS nct, {X.matches('nxt', K.RE_NUMBER_ONLY)} AS nnum, {X.matches('nxt', K.RE_TOP_NUMBER)} AS ntnum FROM cand),
    ol AS (SELECT doc_id, pos, CASE WHEN ct THEN line WHEN num THEN CASE WHEN nxt IS NOT NULL AND length(nxt) <= 180 AND NOT nct AND NOT nnum THEN line || ' ' || nxt END
        WHEN hd OR rsv THEN line END AS shown FROM fl),
    ok AS (SELECT doc_id, pos, shown, {X.outline_key('shown')} AS okey FROM ol WHERE shown IS NOT NULL),
    ou AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, okey ORDER BY pos) AS cn FROM ok WHERE okey <> '') WHERE cn = 1),
    sh0 AS (SELECT doc_id, pos, CASE WHEN rsv THEN line WHEN ct THEN CASE WHEN {X.matches('stripped', K.RE_TOP_HEADING)} THEN stripped END
        WHEN tnum THEN CASE WHEN nxt IS NOT NULL AND NOT nct AND NOT ntnum AND NOT starts_with(nxt, '[') THEN line || ' ' || nxt END
        WHEN top THEN line END AS shown FROM fl),
    sh1 AS (SELECT doc_id, pos, {X.strip_page('shown')} AS heading FROM sh0 WHERE shown IS NOT NULL),
    sh2 AS (SELECT *, {X.outline_key('heading')} AS okey FROM sh1),
    sh AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS line_no FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, okey ORDER BY pos) AS cn FROM sh2 WHERE okey <> '') WHERE cn = 1)
    --final
"""
query("outline_lines", "doc_id:b, line_no:b, outline_line:s", _CAND + """
    SELECT doc_id, line_no, shown AS outline_line FROM ou WHERE line_no <= 180""")(
    lambda spark, sf: O.outline_lines(D.frame(spark, sf, D.shaped), 180))

query("section_headings", "doc_id:b, line_no:b, heading:s", _CAND + "SELECT doc_id, line_no, heading FROM sh WHERE line_no <= 64")(
    lambda spark, sf: O.section_headings(D.frame(spark, sf, D.shaped), 64))


def positioned_chunks(spark, sf_dir):
    """(doc_id, pos, text, path): shaped chunks with dense positions."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    return D.frame(spark, sf_dir, shaped_chunks).withColumn("pos", (F.row_number().over(order) - 1).cast("int"))


# The oracle looks a heading up by its key and body only; the chunk's own outline adds points the same way.
_BODY = X.re_first(X.re_first("heading", r"^\d+(?:\.\d+){0,4}[.)]?\s*", ""), r"^[A-Z][.)]\s*", "")
query("anchor_headings", "doc_id:b, heading:s, chunk_pos:b")(lambda spark, sf: _anchors(spark, sf))


def _anchors(spark, sf_dir):
    return O.anchor_headings(O.coverage_headings(D.frame(spark, sf_dir, D.shaped)), positioned_chunks(spark, sf_dir))


def _key_anchors(spark, sf_dir):
    """Section headings placed at the last chunk that contains their key."""
    heads = O.section_headings(D.frame(spark, sf_dir, D.shaped), 64)
    chunks = positioned_chunks(spark, sf_dir).select("doc_id", "pos", F.lower("text").alias("t"))
    return (
        heads.join(chunks, "doc_id").filter(F.contains("t", "outline_key"))
        .groupBy("doc_id", "heading", "outline_key").agg(F.max("pos").alias("chunk_pos"))
    )


_SPANS = _CAND.replace("--final", f""",
    ch AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS cp FROM ({shaped_chunks(D.Duck())})),
    an AS (SELECT sh.doc_id, heading, okey, max(cp) AS chunk_pos FROM sh JOIN ch ON sh.doc_id = ch.doc_id AND contains(lower(ch.text), okey)
        WHERE line_no <= 64 GROUP BY sh.doc_id, heading, okey),
    a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, okey ORDER BY chunk_pos, heading) AS k1 FROM an) WHERE k1 = 1),
    a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_pos ORDER BY heading) AS k2 FROM a1) WHERE k2 = 1),
    tot AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY doc_id)
    --final""")
query("section_spans", "doc_id:b, heading:s, chunk_pos:b, end_pos:b", _SPANS + """
    SELECT a2.doc_id, heading, chunk_pos, coalesce(lead(chunk_pos) OVER (PARTITION BY a2.doc_id ORDER BY chunk_pos, heading), n) AS end_pos
    FROM a2 JOIN tot ON a2.doc_id = tot.doc_id""")(
    lambda spark, sf: O.section_spans(O.normalize_anchors(_key_anchors(spark, sf)), ST.chunk_totals(positioned_chunks(spark, sf)).select("doc_id", "chunk_total")))


def _ranges(d) -> str:
    """Chunk windows of one to five positions around every third shaped chunk."""
    return (
        f"SELECT path, chunk_index - chunk_index % 2 AS start_pos, chunk_index + chunk_index % 4 AS end_pos FROM ({shaped_chunks(d)}) AS c "
        f"WHERE chunk_index % 3 = 0"
    )


query("merge_ranges", "path:s, start_pos:b, end_pos:b", f"""
    WITH a AS (SELECT *, max(end_pos) OVER (PARTITION BY path ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({_ranges(D.Duck())})),
    b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS isl FROM a)
    --final
    SELECT path, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM b GROUP BY path, isl""")(
    lambda spark, sf: O.merge_ranges(D.frame(spark, sf, _ranges), "path"))


def _packed(spark, sf_dir):
    docs = D.frame(spark, sf_dir, D.shaped).withColumn("source_type", F.lit("doc")).withColumn("size_bytes", F.lit(0))
    return CH.explode_chunks(SG.chunk_texts(docs, keep_text=False), ["doc_id"])


query("pack_chunks", "doc_id:b, pos:b, text:s, kept:o")(_packed)


def _study_docs(spark, sf_dir):
    return D.frame(spark, sf_dir, D.shaped).select(
        "doc_id", "text", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"),
        F.lit("reference").alias("source_role"), F.lit("doc").alias("source_type"), F.lit("direct").alias("extractor"))


def _study_chunks(spark, sf_dir):
    """The positioned chunks, written once: a study reads them in several branches."""
    return cut_and_clean(positioned_chunks(spark, sf_dir), "study-chunks")


def _coverage(docs, chunks):
    docs = cut_and_clean(docs, "study-docs")
    return ST.section_coverage(ST.section_spans(docs, chunks), chunks)


query("section_coverage", "doc_id:b, section_no:b, section:s")(
    lambda spark, sf: _coverage(_study_docs(spark, sf), _study_chunks(spark, sf)))

query("study_packets", "doc_id:b, packet:s")(
    lambda spark, sf: ST.study_packets(_study_docs(spark, sf), _study_chunks(spark, sf)))


def _extraction_inputs(spark, sf_dir):
    chunks = positioned_chunks(spark, sf_dir).withColumn("file_name", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).withColumn(
        "source_role", F.lit("procedure")).withColumn("source_type", F.lit("doc"))
    return chunks, chunks.filter("chunk_index % 10 = 7").select("path", "chunk_index")


query("extraction_packets", "path:s, packet:s")(
    lambda spark, sf: ST.extraction_packets(*_extraction_inputs(spark, sf), max_chars=16000))


def _focus_ranges(spark, sf_dir):
    from quillspan.operators.sampling import focus_positions

    chunks, hits = _extraction_inputs(spark, sf_dir)
    return ST.extraction_ranges(chunks, focus_positions(chunks, hits, 16000), 16000)


query("extraction_ranges", "path:s, start_pos:b, end_pos:b")(_focus_ranges)
