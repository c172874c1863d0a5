"""Section dedupe, history, overlap, plans and assembled context."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan import constants as K
from quillspan.catalog import derived as D, duck as X
from quillspan.catalog.policy_queries import ANCHOR_SQL, EXACT, INLINE_INTENT_SQL, LOWER, PLAN_INTENT_SQL, STUDY, TYPE_SQL
from quillspan.catalog.registry import query, quote as q
from quillspan.catalog.search_queries import LINES, lexical_sql, ranked_sql
from quillspan.catalog.text_queries import retry_sql
from quillspan.operators import context as CX, planning as PL


def sections(d) -> str:
    """Conversation texts as sections: the paragraphs of a message, some of them repeated."""
    twice = "text || chr(10) || '  ' || chr(10) || text || chr(10) || chr(10) || text || chr(10) || chr(10) || replace(text, 'e', 'E')"
    return f"SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, role, {twice} || chr(10) || chr(10) || '<think>x</think>' AS text FROM {d.table('conversations')}"


_PARAS = f"""
    s AS (SELECT doc_id, {X.sanitize_section('text')} AS t FROM ({sections(D.Duck())})),
    p AS ({D.Duck().unnest('s', "regexp_split_to_array(t, '" + chr(92) + "n" + chr(92) + "s*" + chr(92) + "n')", 'doc_id')}),
    k AS (SELECT doc_id, pos, {X.trimmed('item')} AS paragraph FROM p),
    d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {X.dedup_key('paragraph')} ORDER BY pos) AS n FROM k WHERE paragraph <> '')"""
query("dedupe_paragraphs", "doc_id:b, pos:b, paragraph:s", f"WITH {_PARAS}\n--final\nSELECT doc_id, pos, paragraph FROM d WHERE n <= 1")(
    lambda spark, sf: CX.dedupe_paragraphs(D.frame(spark, sf, sections)))

query("deduplicated_sections", "doc_id:b, section:s", f"""
    WITH {_PARAS}
    --final
    SELECT s.doc_id, coalesce(x, '') AS section FROM s LEFT JOIN (SELECT doc_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY pos) AS x FROM d WHERE n <= 2 GROUP BY doc_id) j
    ON s.doc_id = j.doc_id""")(
    lambda spark, sf: CX.deduplicated_sections(D.frame(spark, sf, sections), 2))


def history(d) -> str:
    """Messages as the history of their conversation's request; some repeat others, differently cased or extended."""
    text = (
        "CASE WHEN turn % 4 = 1 THEN first_text || ' and more ' || text WHEN turn % 4 = 2 THEN 'zz ' || first_text || ' yy ' || text "
        "WHEN turn % 4 = 3 THEN replace(text, 'e', 'E') ELSE text END"
    )
    return (
        f"SELECT conv_id AS request_id, turn, role, {text} AS text FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS first_text "
        f"FROM {d.table('conversations')}) AS h"
    )


def requests(d) -> str:
    """Each conversation as a request whose prompt is its first message."""
    return (
        f"SELECT conv_id AS request_id, text AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n "
        f"FROM {d.table('conversations')}) AS h WHERE n = 1"
    )


_KEYS = f"""
    h AS (SELECT request_id, turn, role, {X.sanitize_section('text')} AS st FROM ({history(D.Duck())})),
    hk AS (SELECT *, {X.dedup_key('st')} AS hkey, {X.simplified('st')} AS clean FROM h),
    pk AS (SELECT request_id, {X.dedup_key(X.sanitize_section('prompt'))} AS pkey FROM ({requests(D.Duck())})),
    ov AS (SELECT hk.request_id, turn FROM hk JOIN pk ON hk.request_id = pk.request_id WHERE hkey <> '' AND pkey <> '' AND (hkey = pkey
        OR (least(length(hkey), length(pkey)) >= 80 AND (contains(hkey, pkey) OR contains(pkey, hkey)))
        OR (length(hkey) >= 120 AND length(pkey) >= 120 AND len(list_filter(range(1, length(hkey) - 118), lambda i: contains(pkey, substr(hkey, i, 120)))) > 0)))"""
query("overlapping_history", "request_id:b, turn:b", f"WITH {_KEYS}\n--final\nSELECT DISTINCT request_id, turn FROM ov")(
    lambda spark, sf: CX.overlapping_history(D.frame(spark, sf, history), D.frame(spark, sf, requests)))

_HIST = f"""{_KEYS},
    rc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY turn DESC) AS age FROM hk) WHERE age <= 8 AND hkey <> ''),
    us AS (SELECT * FROM rc WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.request_id = rc.request_id AND ov.turn = rc.turn)),
    un AS (SELECT *, upper(role) || ': ' || clean AS line FROM (SELECT *, row_number() OVER (PARTITION BY request_id, hkey ORDER BY turn DESC) AS n FROM us) WHERE n = 1),
    cu AS (SELECT *, sum(length(line) + 2) OVER (PARTITION BY request_id ORDER BY turn DESC) AS used, row_number() OVER (PARTITION BY request_id ORDER BY turn DESC) AS rn FROM un),
    fl AS (SELECT *, max((rn > 1 AND used > 2400)::INT) OVER (PARTITION BY request_id ORDER BY turn DESC) AS over_ FROM cu)"""


def _history(spark, sf_dir):
    return CX.select_history(D.frame(spark, sf_dir, history), D.frame(spark, sf_dir, requests))


query("select_history", "request_id:b, turn:b, line:s", f"WITH {_HIST}\n--final\nSELECT request_id, turn, line FROM fl WHERE over_ = 0")(_history)


def _requests_full(spark, sf_dir):
    base = D.frame(spark, sf_dir, requests)
    long = F.concat("prompt", F.lit("\n\n"), "prompt", F.lit("\n\nsecond part "), F.repeat("prompt", 30))
    return base.select("request_id", "prompt", long.alias("local_context"), F.concat(F.lit("web "), "prompt").alias("external_context"),
                       F.lit("[a] b = c").alias("memory_context"), F.lit("").alias("summary"), F.lit("outline").alias("outline"))


_LOCAL = X.trim_budget("lc", K.LOCAL_BUDGET)
query("assemble_context", "request_id:b, developer:s, user_text:s", f"""
    WITH {_HIST},
    hx AS (SELECT request_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS hist FROM fl WHERE over_ = 0 GROUP BY request_id),
    rq AS (SELECT r.request_id, {X.sanitize_section('prompt')} AS p, {X.trimmed("prompt || chr(10) || chr(10) || 'second part ' || repeat(prompt, 30)")} AS lc, hist
        FROM ({requests(D.Duck())}) r LEFT JOIN hx ON r.request_id = hx.request_id)
    --final
    SELECT request_id, 'RELEVANT_MEMORIES:' || chr(10) || '[a] b = c' || chr(10) || chr(10) || 'DOCUMENT_OUTLINE_PLAN:' || chr(10) || 'outline' AS developer,
    'LOCAL_CONTEXT:' || chr(10) || {_LOCAL} || chr(10) || chr(10) || 'EXTERNAL_CONTEXT:' || chr(10) || 'web ' || p
    || CASE WHEN hist IS NULL THEN '' ELSE chr(10) || chr(10) || 'RECENT_CONVERSATION:' || chr(10) || hist END || chr(10) || chr(10) || 'USER_REQUEST:' || chr(10) || p AS user_text FROM rq""")(
    lambda spark, sf: CX.assemble_context(_requests_full(spark, sf), CX.history_context(_history(spark, sf))).withColumnRenamed("user", "user_text"))

_TEMPLATES = ", ".join(
    f"({q(t)}, {o}, {q(title)}, {q(obj)}, {q(qq)}, {q(', '.join(roles))})" for t, o, title, obj, qq, roles in K.SECTION_TEMPLATES)
PLAN_SQL = f"""
    tp(document_type, ord, title, objective, tq, roles) AS (VALUES {_TEMPLATES}),
    an AS ({ANCHOR_SQL}),
    pt AS (SELECT *, {PLAN_INTENT_SQL} AS intent FROM (SELECT *, {TYPE_SQL} AS dt FROM {LOWER})),
    pl AS (SELECT pt.prompt_id, dt AS document_type, intent, ord, title, objective, tq || ' ' || anchors AS query, roles
        FROM pt JOIN an ON pt.prompt_id = an.prompt_id JOIN tp ON tp.document_type = pt.dt)"""


def _plan(spark, sf_dir):
    return PL.plan_prompts(D.frame(spark, sf_dir, D.prompts), PL.default_templates(spark))


query("plan_prompts", "prompt_id:b, document_type:s, intent:s, ord:b, title:s, query:s, roles:s", f"WITH {PLAN_SQL}\n--final\nSELECT * FROM pl")(
    lambda spark, sf: _plan(spark, sf).withColumn("roles", F.array_join("preferred_roles", ", ")))

query("plan_text", "prompt_id:b, plan:s", f"""
    WITH {PLAN_SQL}
    --final
    SELECT prompt_id, 'Document type: ' || any_value(document_type) || chr(10) || 'Intent: ' || any_value(intent) || chr(10)
    || '{PL.PLAN_LEAD}' || chr(10)
    || string_agg(ord || '. ' || title || chr(10) || '   objective: ' || objective || chr(10) || '   preferred_sources: ' || roles, chr(10) ORDER BY ord) AS plan FROM pl GROUP BY prompt_id""")(
    lambda spark, sf: PL.plan_text(_plan(spark, sf)))

_PLANNED = f"""
    WITH {PLAN_SQL}, {lexical_sql(LINES, "SELECT prompt_id || '#' || ord AS query_id, query, intent, roles FROM pl")},
    chunk AS (SELECT * FROM ({LINES})), pair AS (SELECT *, 0::DOUBLE AS semantic FROM lex),
    {ranked_sql(K.SEARCH_WEIGHTS[False], 4, "list_contains(string_split(roles, ', '), source_role)")},
    scoped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank, 9) DESC, round(lexical, 9) DESC, file_name, chunk_index, path) AS prank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY round(rerank, 9) DESC, round(lexical, 9) DESC, file_name, chunk_index) AS fn
        FROM ok WHERE path LIKE 'kb/es/%') WHERE fn <= CASE WHEN intent IN ('document_generation', 'architecture') THEN 10 ELSE 6 END) WHERE prank <= 4),
    both_ AS (SELECT query_id, path, chunk_index, true AS pf, prank AS rank FROM scoped UNION ALL SELECT query_id, path, chunk_index, false, rank FROM hit),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path, chunk_index ORDER BY pf DESC, rank) AS cn FROM both_) WHERE cn = 1),
    merged AS (SELECT * FROM (SELECT query_id, path, chunk_index, pf, row_number() OVER (PARTITION BY query_id ORDER BY pf DESC, rank) AS rank FROM once) WHERE rank <= 4)
    --final
"""


def _earliest(hits: str) -> str:
    """A chunk stays in the earliest section of its prompt."""
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, path, chunk_index ORDER BY section_no, rank) AS seen FROM (
        SELECT *, CAST(split_part(query_id, '#', 1) AS BIGINT) AS prompt_id, CAST(split_part(query_id, '#', 2) AS BIGINT) AS section_no FROM {hits})) WHERE seen = 1"""


query("search_by_plan", "prompt_id:b, section_no:b, path:s, chunk_index:b, rank:b", _PLANNED + _earliest("hit"))(
    lambda spark, sf: PL.search_by_plan(_plan(spark, sf), D.frame(spark, sf, D.line_chunks)))

query("search_by_plan_preferred", "prompt_id:b, section_no:b, path:s, chunk_index:b, rank:b, from_preferred:o",
      _PLANNED + _earliest("(SELECT *, pf AS from_preferred FROM merged)"))(
    lambda spark, sf: PL.search_by_plan(
        _plan(spark, sf), D.frame(spark, sf, D.line_chunks), preferred_paths=D.frame(spark, sf, D.files).where("lang = 'es'").select("path")))

query("retry_sections", "doc_id:b, section:s", f"""
    WITH {_PARAS}, w AS (SELECT s.doc_id, coalesce(x, '') AS t FROM s LEFT JOIN (
        SELECT doc_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY pos) AS x FROM d WHERE n <= 1 GROUP BY doc_id) j ON s.doc_id = j.doc_id)
    --final
    SELECT doc_id, {retry_sql('t', 900)} AS section FROM w""")(
    lambda spark, sf: CX.retry_sections(D.frame(spark, sf, sections), 900))



def _merged(preferred: str, general: str, cut: str) -> str:
    """Rows (prompt_id, path, chunk_index, merged_rank) of two hit lists, preferred ones first, unique, up to ``cut``."""
    both = f"SELECT prompt_id, path, chunk_index, rank, true AS pf FROM {preferred} UNION ALL SELECT prompt_id, path, chunk_index, rank, false FROM {general}"
    once = f"SELECT *, row_number() OVER (PARTITION BY prompt_id, path, chunk_index ORDER BY pf DESC, rank) AS cn FROM ({both})"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY pf DESC, rank) AS merged_rank FROM ({once}) WHERE cn = 1"
    return f"SELECT prompt_id, path, chunk_index, merged_rank FROM ({ranked}) WHERE merged_rank <= {cut}"


_UNION = f"""
    WITH ba AS (SELECT prompt_id, prompt, {INLINE_INTENT_SQL} AS intent, {EXACT} AS exact, {STUDY} AS study FROM {LOWER}),
    va AS (SELECT prompt_id, 'g' AS kind, prompt AS query, intent, CASE WHEN exact THEN 10 ELSE 8 END AS take FROM ba
        UNION ALL SELECT prompt_id, 's', prompt || {q(K.STRUCTURE_QUERY_SUFFIX)}, intent, CASE WHEN exact THEN 5 ELSE 4 END FROM ba WHERE study
        UNION ALL SELECT prompt_id, 'x', prompt || {q(K.EXTRACTION_QUERY_SUFFIX)}, intent, 10 FROM ba WHERE exact),
    {lexical_sql(LINES, "SELECT prompt_id || '#' || kind AS query_id, query, intent FROM va")},
    chunk AS (SELECT * FROM ({LINES})), pair AS (SELECT *, 0::DOUBLE AS semantic FROM lex),
    {ranked_sql(K.SEARCH_WEIGHTS[False], 10, "false")},
    kept AS (SELECT hit.*, va.prompt_id, va.kind FROM hit JOIN va ON hit.query_id = va.prompt_id || '#' || va.kind WHERE rank <= take),
    st AS ({_merged("(SELECT * FROM kept WHERE kind = 's')", "(SELECT * FROM kept WHERE kind = 'g')", "10")}),
    gen AS (SELECT st.prompt_id, path, chunk_index, merged_rank AS rank FROM st JOIN ba ON st.prompt_id = ba.prompt_id WHERE merged_rank <= CASE WHEN exact THEN 10 ELSE 8 END),
    fin AS ({_merged("(SELECT * FROM kept WHERE kind = 'x')", "gen", "8")})
    --final
    SELECT prompt_id, merged_rank, path, chunk_index FROM fin"""

# over whole tables this SQL takes minutes, so tests run it on the smallest tables instead
UNION_SQL = _UNION.replace("--final", "")

query("multi_query_union", "prompt_id:b, merged_rank:b, path:s, chunk_index:b")(
    lambda spark, sf: PL.multi_query_union(D.frame(spark, sf, D.prompts), D.frame(spark, sf, D.line_chunks)))
