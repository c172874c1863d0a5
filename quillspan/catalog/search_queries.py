"""Search over document chunks, vectors, sampling and hit handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan import constants as K
from quillspan.catalog import derived as D, duck as X
from quillspan.catalog.registry import query
from quillspan.catalog.text_queries import EMBED_TOKENS_SQL, embed_tokens_sql, excerpt_sql
from quillspan.functions import scoring as S
from quillspan.operators import embed as EM, sampling as SA, search as SE

LINES, DOCS, QUERIES = D.sql(D.line_chunks), D.sql(D.doc_chunks), D.sql(D.queries)


def queries_frame(spark, sf_dir):
    """Benchmark queries; every second one prefers procedure sources."""
    roles = F.when(F.col("query_id") % 2 == 0, F.array(F.lit(" Procedure "))).otherwise(F.array().cast("array<string>"))
    return D.frame(spark, sf_dir, D.queries).withColumn("preferred_roles", roles)


def lexical_sql(chunks: str, queries: str) -> str:
    """CTEs up to ``lex(query_id, path, chunk_index, lexical)`` and ``pq`` (prepared queries)."""
    return f"""
    pq AS (SELECT *, {X.ordered_distinct('tl')} AS terms, {X.trimmed('lower(query)')} AS whole
        FROM (SELECT *, {X.query_terms('query')} AS tl FROM ({queries}))),
    qt AS (SELECT query_id, whole, len(terms) AS n, unnest(terms) AS term FROM pq WHERE len(terms) > 0),
    low AS MATERIALIZED (SELECT path, chunk_index, lower(text) AS body, lower(file_name) AS fname FROM ({chunks})),
    cnt AS (SELECT query_id, path, chunk_index, n, whole, body, fname, {X.occurrences('body', 'term')} AS b, {X.occurrences('fname', 'term')} AS f
        FROM low JOIN qt ON contains(body, term) OR contains(fname, term)),
    lex AS (SELECT query_id, path, chunk_index, sum(CASE WHEN b > 0 THEN 0.95::DOUBLE + least(1.25::DOUBLE, 0.16::DOUBLE * (b - 1)) ELSE 0::DOUBLE END
        + CASE WHEN f > 0 THEN 0.55::DOUBLE + least(0.75::DOUBLE, 0.18::DOUBLE * (f - 1)) ELSE 0::DOUBLE END)
        + 1.8::DOUBLE * count(*) / any_value(n)
        + CASE WHEN contains(any_value(body), any_value(whole)) THEN 1.2::DOUBLE ELSE 0::DOUBLE END
        + CASE WHEN contains(any_value(fname), any_value(whole)) THEN 0.75::DOUBLE ELSE 0::DOUBLE END AS lexical
        FROM cnt GROUP BY query_id, path, chunk_index)"""


query("term_hits", "query_id:b, path:s, chunk_index:b, lexical:d",
      f"WITH {lexical_sql(LINES, QUERIES)}\n--final\nSELECT query_id, path, chunk_index, lexical FROM lex")(
    lambda spark, sf: SE.lexical_pairs(D.frame(spark, sf, D.line_chunks), SE.prepare_queries(queries_frame(spark, sf))))


EVEN_QUERIES = "pq.query_id % 2 = 0 AND source_role = 'procedure'"


def ranked_sql(weights: tuple, limit: int, roles: str = EVEN_QUERIES, cap_floor: int = 0) -> str:
    """CTEs ``sc`` (scored) and ``hit`` (ranked) after ``pair(query_id, path, chunk_index, lexical, semantic)``; ``roles`` says
    when a chunk's role is preferred."""
    liked = f" + CASE WHEN {roles} THEN 0.28::DOUBLE ELSE 0::DOUBLE END"
    order = "round(rerank, 9) DESC, round(lexical, 9) DESC, round(semantic, 9) DESC, file_name, chunk_index, path"
    cap = "CASE WHEN intent IN ('document_generation', 'architecture') THEN 10 ELSE 6 END"
    cap = f"greatest({cap}, {cap_floor})" if cap_floor else cap
    return f"""
    sc AS (SELECT pair.*, file_name, source_type, source_role, intent, pq.terms, c.text AS chunk_text,
        lexical * {weights[0]}::DOUBLE + semantic * {weights[1]}::DOUBLE + {X.role_bias('intent', 'source_role')}{liked} AS rerank
        FROM pair JOIN chunk c ON pair.path = c.path AND pair.chunk_index = c.chunk_index JOIN pq ON pq.query_id = pair.query_id),
    ok AS (SELECT * FROM sc WHERE (lexical > 0 OR semantic >= {K.MIN_SEMANTIC}) AND rerank > {weights[2]}),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY {order}) AS file_rank FROM ok),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM fr WHERE file_rank <= {cap}),
    hit AS (SELECT * FROM rk WHERE rank <= {limit})"""


_LOCAL = K.SEARCH_WEIGHTS[False]
LEXICAL_HITS = f"""
    WITH {lexical_sql(LINES, QUERIES)}, chunk AS (SELECT * FROM ({LINES})), pair AS (SELECT *, 0::DOUBLE AS semantic FROM lex),
    {ranked_sql(_LOCAL, K.MAX_LOCAL_HITS)}
    --final
"""

query("lexical_search", "query_id:b, rank:b, path:s, chunk_index:b, lexical:d, rerank:d, score:b, match_reason:s", LEXICAL_HITS + """
    SELECT query_id, rank, path, chunk_index, lexical, rerank, floor(round(rerank, 9) * 100 + 0.5) AS score,
    CASE WHEN lexical >= 1.8 THEN 'strong lexical overlap' ELSE 'keyword overlap' END || ', role=' || source_role AS match_reason FROM hit""")(
    lambda spark, sf: SE.hybrid_search(D.frame(spark, sf, D.line_chunks), queries_frame(spark, sf), detail=False))


def _vector_inputs(spark, sf_dir):
    """Documents with the vector of the same number, queries with the vector of theirs."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    chunks = D.frame(spark, sf_dir, D.doc_chunks).join(
        vectors.select(F.col("vec_id").alias("chunk_index"), "embedding"), "chunk_index", "left")
    queries = queries_frame(spark, sf_dir).join(
        vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")), "query_id", "left")
    return chunks, queries


def cosine_sql(a: str, b: str) -> str:
    def dot(x: str, y: str) -> str:
        return f"list_dot_product({x}::DOUBLE[], {y}::DOUBLE[])"

    norm = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL OR {norm} = 0 THEN 0::DOUBLE ELSE {dot(a, b)} / {norm} END"


_NEURAL = K.SEARCH_WEIGHTS[True]
HYBRID = f"""
    WITH {lexical_sql(DOCS, QUERIES)}, chunk AS (SELECT * FROM ({DOCS})),
    pr AS (SELECT q.query_id, c.path, c.chunk_index, coalesce(l.lexical, 0) AS lexical,
        greatest(0::DOUBLE, {cosine_sql('qe.embedding', 'ce.embedding')}) AS semantic
        FROM chunk c CROSS JOIN pq q LEFT JOIN embeddings ce ON ce.vec_id = c.chunk_index LEFT JOIN embeddings qe ON qe.vec_id = q.query_id
        LEFT JOIN lex l ON l.query_id = q.query_id AND l.path = c.path AND l.chunk_index = c.chunk_index),
    pair AS (SELECT * FROM pr WHERE lexical > 0 OR semantic >= {K.MIN_SEMANTIC}),
    {ranked_sql(_NEURAL, K.MAX_LOCAL_HITS)}
    --final
"""


@query("hybrid_search", "query_id:b, rank:b, path:s, chunk_index:b, lexical:d, semantic:d, rerank:d, match_reason:s", HYBRID + """
    SELECT query_id, rank, path, chunk_index, lexical, semantic, rerank, concat_ws(', ',
    CASE WHEN lexical >= 1.8 THEN 'strong lexical overlap' WHEN lexical > 0 THEN 'keyword overlap' END,
    CASE WHEN semantic >= 0.65 THEN 'strong embedding similarity' WHEN semantic >= 0.38 THEN 'embedding similarity' END,
    'role=' || source_role) AS match_reason FROM hit""")
def hybrid(spark, sf_dir):
    chunks, queries = _vector_inputs(spark, sf_dir)
    return SE.hybrid_search(chunks, queries, neural=True, detail=False)




def hash_vectors_sql(rows: str, mark: str) -> str:
    """CTEs up to ``vec{mark}(doc_id, bucket, x)``, the unit hash vectors, and ``len{mark}(doc_id, norm)``."""
    return f"""{embed_tokens_sql(rows, mark)},
    fr{mark} AS (SELECT doc_id, token, count(*) AS freq, md5(token) AS m FROM tok{mark} GROUP BY doc_id, token),
    bk{mark} AS (SELECT doc_id, ('0x' || substr(m, 1, 8))::BIGINT % {K.EMBED_DIMS} AS bucket, sum((1 + ln(1 + freq::DOUBLE))
        * CASE WHEN ('0x' || substr(m, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS weight FROM fr{mark} GROUP BY 1, 2),
    vec{mark} AS (SELECT doc_id, bucket, CAST(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS FLOAT)::DOUBLE AS x FROM bk{mark}),
    len{mark} AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM vec{mark} GROUP BY doc_id)"""


_HYBRID_LOCAL = f"""
    WITH {lexical_sql(DOCS, QUERIES)}, chunk AS (SELECT * FROM ({DOCS})), {hash_vectors_sql('documents', 'c')},
    {hash_vectors_sql('(SELECT query_id AS doc_id, query AS text FROM pq)', 'q')},
    dots AS (SELECT q.doc_id AS query_id, c.doc_id AS chunk_index, sum(q.x * c.x) AS dot FROM vecc c JOIN vecq q ON c.bucket = q.bucket GROUP BY 1, 2),
    sem AS (SELECT query_id, chunk_index, greatest(0::DOUBLE, dot / (lc.norm * lq.norm)) AS semantic FROM dots
        JOIN lenc lc ON lc.doc_id = chunk_index JOIN lenq lq ON lq.doc_id = query_id),
    pr AS (SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.chunk_index, s.chunk_index) AS chunk_index,
        coalesce(lexical, 0::DOUBLE) AS lexical, coalesce(semantic, 0::DOUBLE) AS semantic
        FROM lex l FULL JOIN sem s ON l.query_id = s.query_id AND l.chunk_index = s.chunk_index),
    pair AS (SELECT pr.query_id, c.path, pr.chunk_index, lexical, semantic FROM pr JOIN chunk c ON c.chunk_index = pr.chunk_index
        WHERE lexical > 0 OR semantic >= {K.MIN_SEMANTIC}),
    {ranked_sql(_LOCAL, K.MAX_LOCAL_HITS)}
    --final
    SELECT query_id, rank, path, chunk_index, lexical, semantic, rerank, concat_ws(', ',
    CASE WHEN lexical >= 1.8 THEN 'strong lexical overlap' WHEN lexical > 0 THEN 'keyword overlap' END,
    CASE WHEN semantic >= 0.65 THEN 'strong surface-form vector similarity' WHEN semantic >= {K.MIN_SEMANTIC} THEN 'surface-form vector similarity' END,
    'role=' || source_role) AS match_reason FROM hit"""

query("hybrid_local", "query_id:b, rank:b, path:s, chunk_index:b, lexical:d, semantic:d, rerank:d, match_reason:s", _HYBRID_LOCAL)(
    lambda spark, sf: SE.hybrid_local(D.frame(spark, sf, D.doc_chunks), queries_frame(spark, sf), detail=False))

query("search_in_files", "query_id:b, rank:b, path:s, chunk_index:b, rerank:d", f"""
    WITH scope AS (SELECT * FROM ({DOCS}) WHERE path IN (SELECT 'kb/' || source || '.txt' FROM documents WHERE lang = 'es')),
    {lexical_sql('SELECT * FROM scope', QUERIES)}, chunk AS (SELECT * FROM scope), pair AS (SELECT *, 0::DOUBLE AS semantic FROM lex),
    {ranked_sql(_LOCAL, 12, cap_floor=12)}
    --final
    SELECT query_id, rank, path, chunk_index, rerank FROM hit""")(
    lambda spark, sf: SE.hybrid_search(
        D.frame(spark, sf, D.doc_chunks), queries_frame(spark, sf), 12, detail=False,
        paths=D.frame(spark, sf, D.documents).filter("lang = 'es'").select(F.concat(F.lit("kb/"), "source", F.lit(".txt")).alias("path"))))

_TOPK = f"""
    SELECT query_id, rank, item_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, item_id) AS rank
    FROM (SELECT b.item_id AS query_id, e.vec_id AS item_id, {cosine_sql('q.embedding', 'e.embedding')} AS cosine
    FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings e)) WHERE rank <= 10"""


@query("vector_topk", "query_id:b, rank:b, item_id:b, cosine:d", _TOPK)
def vector_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    probes = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("vec_id")).join(vectors, "vec_id")
    return SE.vector_topk(vectors, probes.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")), 10)


query("cosine", "vec_id:b, c:d", f"""
    SELECT vec_id, {cosine_sql('embedding', 'other')} AS c FROM (SELECT vec_id, embedding, list_reverse(embedding) AS other FROM embeddings)""")(
    lambda spark, sf: spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", S.cosine(F.col("embedding"), F.reverse("embedding")).alias("c")))

_BUCKETS = f"""
    {EMBED_TOKENS_SQL},
    fr AS (SELECT doc_id, token, count(*) AS freq, md5(token) AS m FROM tok GROUP BY doc_id, token),
    bk AS (SELECT doc_id, ('0x' || substr(m, 1, 8))::BIGINT % {K.EMBED_DIMS} AS bucket, sum((1 + ln(1 + freq::DOUBLE))
        * CASE WHEN ('0x' || substr(m, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS weight FROM fr GROUP BY 1, 2)"""

query("hash_buckets", "doc_id:b, bucket:b, weight:d", f"WITH {_BUCKETS}\n--final\nSELECT doc_id, bucket, weight FROM bk")(
    lambda spark, sf: EM.hash_buckets(D.frame(spark, sf, D.documents), ["doc_id"]))

query("hash_embed", "doc_id:b, dim:b, x:d", f"""
    WITH {_BUCKETS}, nm AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM bk GROUP BY doc_id)
    --final
    SELECT bk.doc_id, bucket AS dim, round(CAST(weight / norm AS FLOAT)::DOUBLE, 5) AS x FROM bk JOIN nm ON bk.doc_id = nm.doc_id
    WHERE abs(round(CAST(weight / norm AS FLOAT)::DOUBLE, 5)) > 0""")(
    lambda spark, sf: EM.hash_embed(D.frame(spark, sf, D.documents), ["doc_id"]).select("doc_id", F.posexplode("embedding").alias("dim", "x"))
    .withColumn("x", F.round(F.col("x").cast("double"), 5)).filter("abs(x) > 0"))

query("sum_vectors", "label:b, dim:b, x:d", """
    SELECT label, idx - 1 AS dim, round(sum(e[idx]::DOUBLE), 3) AS x FROM (SELECT label, embedding AS e, unnest(range(1, len(embedding) + 1)) AS idx FROM embeddings)
    GROUP BY label, idx""")(
    lambda spark, sf: EM.sum_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), ["label"]).select(
        "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round(F.col("x").cast("double"), 3)))


def _intent_roles(d) -> str:
    """Documents with an intent and a role in turn."""
    return (
        f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'general' WHEN 1 THEN 'troubleshooting' WHEN 2 THEN 'document_generation' WHEN 3 THEN 'architecture' "
        f"ELSE 'implementation' END AS intent, CASE doc_id % 7 WHEN 0 THEN 'procedure' WHEN 1 THEN 'reference' WHEN 2 THEN 'scenario' WHEN 3 THEN 'config' "
        f"WHEN 4 THEN 'log' ELSE 'code' END AS role FROM {d.table('documents')}"
    )


query("role_bias", "doc_id:b, bias:d", f"""
    SELECT doc_id, {X.role_bias('intent', 'role')} + CASE WHEN role IN ('procedure', 'log') THEN 0.28 ELSE 0 END AS bias FROM ({_intent_roles(D.Duck())})""")(
    lambda spark, sf: D.frame(spark, sf, _intent_roles).select("doc_id", S.role_bias(
        F.col("intent"), F.col("role"), F.array(F.lit(" Procedure"), F.lit("log"), F.lit("procedure"))).alias("bias")))


def _general_hits(spark, sf_dir):
    return SE.hybrid_search(D.frame(spark, sf_dir, D.line_chunks), queries_frame(spark, sf_dir), detail=True)


query("hit_blocks", "query_id:b, rank:b, line:s", LEXICAL_HITS.replace("--final", "\n--final") + f"""
    SELECT query_id, rank, '--- Source: ' || file_name || ' | role=' || source_role || ' | type=' || source_type || ' | chunk=' || chunk_index
    || ' | rerank=' || round(CAST(round(rerank, 6) AS DECIMAL(18, 6)), 2) || ' ---' || chr(10) || chunk_text AS line FROM hit""")(
    lambda spark, sf: _general_hits(spark, sf).select("query_id", "rank", S.hit_line(
        F.col("file_name"), F.col("source_role"), F.col("source_type"), F.col("chunk_index"), F.col("rerank"), F.col("chunk_text"),
        F.col("excerpt"), F.col("match_reason")).alias("line")))

_TWO = "round(CAST(round({}, 6) AS DECIMAL(18, 6)), 2)"
query("hit_display", "query_id:b, rank:b, block:s", LEXICAL_HITS.replace("--final", f""",
    {excerpt_sql("SELECT query_id, rank, chunk_text AS text, terms FROM hit", "query_id, rank")}
    --final""") + f"""
    SELECT hit.query_id, hit.rank, 'File: ' || path || chr(10) || 'Role: ' || source_role || ' | Type: ' || source_type || chr(10) || 'Chunk: ' || chunk_index
    || ' | Rerank: ' || {_TWO.format('rerank')} || ' | Lexical: ' || {_TWO.format('lexical')} || ' | Embedding: 0.00' || chr(10) || 'Reason: '
    || CASE WHEN lexical >= 1.8 THEN 'strong lexical overlap' ELSE 'keyword overlap' END || ', role=' || source_role || chr(10) || 'Excerpt: ' || excerpt || chr(10) AS block
    FROM hit JOIN exc ON hit.query_id = exc.query_id AND hit.rank = exc.rank""")(
    lambda spark, sf: _general_hits(spark, sf).select("query_id", "rank", S.hit_block(
        F.col("path"), F.col("source_role"), F.col("source_type"), F.col("chunk_index"), F.col("rerank"), F.col("lexical"), F.col("semantic"),
        F.col("match_reason"), F.col("excerpt")).alias("block")))


def _two_lists(spark, sf_dir):
    """Preferred hits from one file set, general hits from all files, of the same queries."""
    chunks, queries = D.frame(spark, sf_dir, D.doc_chunks), queries_frame(spark, sf_dir)
    paths = D.frame(spark, sf_dir, D.documents).filter("lang = 'es'").select(F.concat(F.lit("kb/"), "source", F.lit(".txt")).alias("path")).distinct()
    marked = SE.mark_scope(chunks, paths).withColumn("scoped", F.col("scoped") & (F.col("source_role") == "config"))
    return SE.hybrid_lists(marked, queries, scoped_limit=4)


_LISTS = f"""
    WITH {lexical_sql(DOCS, QUERIES)}, chunk AS (SELECT * FROM ({DOCS})), pair AS (SELECT *, 0::DOUBLE AS semantic FROM lex),
    {ranked_sql(_LOCAL, K.MAX_LOCAL_HITS)},
    pref AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank, 9) DESC, round(lexical, 9) DESC, file_name, chunk_index, path) AS prank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY round(rerank, 9) DESC, round(lexical, 9) DESC, file_name, chunk_index, path) AS fr2
        FROM ok WHERE source_role = 'config') WHERE fr2 <= CASE WHEN intent IN ('document_generation', 'architecture') THEN 10 ELSE 6 END),
    both_ AS (SELECT query_id, path, chunk_index, rerank, true AS pf, prank AS rank FROM pref WHERE prank <= 4
        UNION ALL SELECT query_id, path, chunk_index, rerank, false, rank FROM hit),
    uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path, chunk_index ORDER BY pf DESC, rank) AS cn FROM both_) WHERE cn = 1),
    mg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pf DESC, rank) AS merged_rank FROM uniq) WHERE merged_rank <= 8)
    --final
"""

query("merge_hits", "query_id:b, merged_rank:b, path:s, chunk_index:b, from_preferred:o", _LISTS + """
    SELECT query_id, merged_rank, path, chunk_index, pf AS from_preferred FROM mg""")(
    lambda spark, sf: SE.merge_hits(*_two_lists(spark, sf), 8))

query("merge_summary", "query_id:b, best_score:d, preferred_hits:b, used:s", _LISTS + """
    SELECT query_id, max(rerank) AS best_score, count(*) FILTER (WHERE pf) AS preferred_hits,
    coalesce(array_to_string(list_sort(list(DISTINCT path) FILTER (WHERE pf)), '|'), '') AS used FROM mg GROUP BY query_id""")(
    lambda spark, sf: SE.merge_summary(SE.merge_hits(*_two_lists(spark, sf), 8)).withColumn("used", F.array_join("used_paths", "|")))

query("study_files", "query_id:b, file_no:b, path:s, hit_count:b, best_score:d", LEXICAL_HITS + """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_count DESC, round(best_score, 9) DESC, path) AS file_no FROM (
    SELECT query_id, path, count(*) AS hit_count, max(rerank) AS best_score FROM hit GROUP BY query_id, path)) WHERE file_no <= 2""")(
    lambda spark, sf: SE.study_files(SE.hybrid_search(D.frame(spark, sf, D.line_chunks), queries_frame(spark, sf), detail=False)))

query("grounding_gate", "query_id:b, best_score:d, has_context:o, weak_context:o, must_refuse:o", LEXICAL_HITS + """
    SELECT q.query_id, best_score, best_score IS NOT NULL AS has_context, coalesce(best_score < 3.5, false) AS weak_context,
    q.query_id % 2 = 0 AND best_score IS NULL AS must_refuse FROM pq q LEFT JOIN (SELECT query_id, max(rerank) AS best_score FROM hit GROUP BY query_id) b
    ON q.query_id = b.query_id""")(
    lambda spark, sf: SE.grounding_gate(
        queries_frame(spark, sf).select("query_id", (F.col("query_id") % 2 == 0).alias("needs_grounding")),
        SE.hybrid_search(D.frame(spark, sf, D.line_chunks), queries_frame(spark, sf), detail=False), 3.5)
    .withColumn("weak_context", F.coalesce("weak_context", F.lit(False))))


def shaped_chunks(d) -> str:
    """Shaped documents cut at blank lines into chunks of one file each."""
    pieces = d.unnest(f"({D.shaped(d)}) AS s", d.split("text", "chr(10) || chr(10)"), "doc_id, source")
    return f"SELECT doc_id, 'kb/' || source || '/' || doc_id AS path, pos AS chunk_index, item AS text FROM ({pieces}) AS p WHERE item <> ''"


def _even(slots: str, last: str) -> str:
    return f"list_transform(range(1, {slots} + 1), lambda s: CAST(floor(s / ({slots} + 1)::DOUBLE * {last} + 0.5) AS BIGINT))"


REPRESENTATIVE_SQL = f"""
    WITH ch AS (SELECT *, {X.structure('text')} AS structure, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY path) AS total
        FROM ({shaped_chunks(D.Duck())}) WINDOW w AS (PARTITION BY path ORDER BY chunk_index)),
    a AS (SELECT *, pos < 2 OR pos >= total - 2 AS edge, structure AND NOT (pos < 2 OR pos >= total - 2) AND pos < least(total, 24) AS ne FROM ch),
    b AS (SELECT *, count(*) FILTER (WHERE edge) OVER (PARTITION BY path) AS edges, sum(ne::INT) OVER (PARTITION BY path ORDER BY pos) AS eno,
        sum(structure::INT) OVER (PARTITION BY path ORDER BY pos) AS sno, count(*) FILTER (WHERE structure) OVER (PARTITION BY path) AS stot FROM a),
    c AS (SELECT *, ne AND edges + eno <= 6 AS early FROM b),
    d AS (SELECT *, greatest(0, 6 - edges - count(*) FILTER (WHERE early) OVER (PARTITION BY path)) AS slots FROM c),
    e AS (SELECT *, edge OR early OR (structure AND slots > 0 AND (stot <= slots OR list_contains({_even('slots', '(stot - 1)')}, sno - 1))) AS picked FROM d),
    f AS (SELECT *, greatest(0, 8 - count(*) FILTER (WHERE picked) OVER (PARTITION BY path)) AS fs FROM e),
    g AS (SELECT *, picked OR (fs > 0 AND (total <= fs OR list_contains({_even('fs', '(total - 1)')}, pos))) AS keep FROM f)
    --final
    SELECT path, chunk_index, 2 + CASE WHEN structure THEN 0.5 ELSE 0 END AS rerank FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS pn FROM g WHERE keep) WHERE pn <= 8"""

query("representative_chunks", "path:s, chunk_index:b, rerank:d", REPRESENTATIVE_SQL)(
    lambda spark, sf: SA.representative_chunks(D.frame(spark, sf, shaped_chunks), 8))

query("resample_evenly", "source:s, doc_id:b", """
    SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total
    FROM documents) WHERE total <= 7 OR list_contains(list_transform(range(0, 7), lambda s: CAST(floor((total - 1) * (s / 6::DOUBLE) + 0.5) AS BIGINT)), pos)""")(
    lambda spark, sf: SA.resample_evenly(D.frame(spark, sf, D.documents).select("source", "doc_id"), 7, "source", "doc_id"))

_ACTION_SCORE = f"""CASE WHEN contains(t, '```') THEN 6 ELSE 0 END + CASE WHEN {X.matches('t', K.RE_COMMAND_LINE)} THEN 7 ELSE 0 END
    + {" + ".join(f"CASE WHEN {X.has_any('lower(t)', w)} THEN {p} ELSE 0 END" for p, w in K.ACTION_WORDS)}
    + CASE WHEN {X.matches('t', K.RE_BULLET_LINE)} THEN 2 ELSE 0 END + CASE WHEN {X.matches('t', K.RE_NUMBERED_LINE)} THEN 3 ELSE 0 END
    + CASE WHEN {X.matches('t', K.RE_KEY_VALUE_LINE)} THEN 2 ELSE 0 END + CASE WHEN {X.has_any('t', ['{', '=', '->'])} THEN 1 ELSE 0 END"""
query("actionable_chunks", "path:s, chunk_index:b, actionability:b, action_rank:b", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY actionability DESC, chunk_index) AS action_rank FROM (
    SELECT path, chunk_index, {_ACTION_SCORE} AS actionability FROM (SELECT *, {X.normalize_block('text')} AS t FROM ({shaped_chunks(D.Duck())})))
    WHERE actionability > 0) WHERE action_rank <= 6""")(
    lambda spark, sf: SA.actionable_chunks(D.frame(spark, sf, shaped_chunks), 6))


def _positioned(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy("chunk_index")
    return D.frame(spark, sf_dir, shaped_chunks).withColumn("pos", F.row_number().over(order) - 1)


query("focus_positions", "path:s, pos:b", f"""
    WITH ch AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY chunk_index) - 1 AS pos, {X.normalize_block('text')} AS t FROM ({shaped_chunks(D.Duck())})),
    act AS (SELECT path, pos FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s DESC, chunk_index) AS r FROM (
        SELECT *, {_ACTION_SCORE} AS s FROM ch) WHERE s > 0) WHERE r <= 6),
    smp AS (SELECT path, unnest(list_transform(range(0, 9), lambda s: CAST(floor(last * (s / 8::DOUBLE) + 0.5) AS BIGINT))) AS pos
        FROM (SELECT path, max(pos) AS last FROM ch GROUP BY path)),
    hits AS (SELECT path, pos FROM ch WHERE chunk_index % 10 = 7)
    --final
    SELECT * FROM act UNION SELECT * FROM smp UNION SELECT * FROM hits""")(
    lambda spark, sf: SA.focus_positions(
        _positioned(spark, sf), _positioned(spark, sf).filter("chunk_index % 10 = 7").select("path", "chunk_index"), 20000))
