"""Conversation tables over messages with questions, refusals and code."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan import constants as K
from quillspan.catalog import derived as D, duck as X
from quillspan.catalog.registry import query
from quillspan.operators import conversation as CV

MSG = D.sql(D.marked_messages)


def messages(spark, sf_dir):
    return D.frame(spark, sf_dir, D.marked_messages)


_TITLE = f"""CASE WHEN t = '' THEN 'New conversation' WHEN len(string_split(t, ' ')) > 8 THEN array_to_string(list_slice(string_split(t, ' '), 1, 8), ' ') || '...' ELSE t END"""
INDEX_SQL = f"""
    WITH ix AS (SELECT conv_id, {_TITLE} AS title, created_at, updated_at, messages FROM (SELECT conv_id, {X.simplified("coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '')")} AS t,
        min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS messages FROM ({MSG}) GROUP BY conv_id))
    --final
"""
query("conversation_index", "conv_id:b, title:s, created_at:s, updated_at:s, messages:b", INDEX_SQL + "SELECT * FROM ix")(
    lambda spark, sf: CV.conversation_index(messages(spark, sf)))

query("append_messages", "conv_id:b, turn:b, role:s, text:s, created_at:s", f"""
    SELECT conv_id, turn, role, text, created_at FROM ({MSG})
    UNION ALL SELECT conv_id, last + row_number() OVER (PARTITION BY conv_id ORDER BY created_at, turn), role, 'again ' || text, created_at
    FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM ({MSG})) WHERE turn < 2""")(
    lambda spark, sf: CV.append_messages(messages(spark, sf), messages(spark, sf).filter("turn < 2").withColumn("seq", F.col("turn")).withColumn(
        "text", F.concat(F.lit("again "), "text")).drop("turn")))

query("rename_conversations", "conv_id:b, title:s, updated_at:s", INDEX_SQL + """
    SELECT conv_id, CASE WHEN conv_id % 3 = 1 THEN 'Named ' || conv_id ELSE title END AS title, CASE WHEN conv_id % 3 > 0 THEN '2025' ELSE updated_at END AS updated_at FROM ix""")(
    lambda spark, sf: CV.rename_conversations(CV.conversation_index(messages(spark, sf)), messages(spark, sf).filter("conv_id % 3 > 0").select("conv_id").distinct().withColumn(
        "title", F.when(F.col("conv_id") % 3 == 1, F.concat(F.lit(" Named "), F.col("conv_id").cast("string"))).otherwise("  ")), "2025"))

query("update_summaries", "conv_id:b, summary:s, updated_at:s", INDEX_SQL + """
    SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'sum ' || conv_id ELSE '' END AS summary, CASE WHEN conv_id % 2 = 0 THEN '2025' ELSE updated_at END AS updated_at FROM ix""")(
    lambda spark, sf: CV.update_summaries(CV.conversation_index(messages(spark, sf)), messages(spark, sf).filter("conv_id % 2 = 0").select("conv_id").distinct().withColumn(
        "summary", F.concat(F.lit("sum "), F.col("conv_id").cast("string"))), "2025"))

query("delete_conversations", "conv_id:b, turn:b", f"SELECT conv_id, turn FROM ({MSG}) WHERE conv_id % 4 <> 1")(
    lambda spark, sf: CV.delete_conversations(messages(spark, sf), messages(spark, sf).filter("conv_id % 4 = 1")))

query("order_conversations", "conv_id:b, updated_at:s, place:b", INDEX_SQL + """
    SELECT conv_id, updated_at, row_number() OVER (ORDER BY updated_at DESC, conv_id) - 1 AS place FROM ix""")(
    lambda spark, sf: CV.order_conversations(CV.conversation_index(messages(spark, sf))))

query("recent_messages", "conv_id:b, turn:b", f"""
    SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM ({MSG})) WHERE n <= 3""")(
    lambda spark, sf: CV.recent_messages(messages(spark, sf), 3))

_NEXT = f"""SELECT *, role = 'user' AND contains(text, '?') AND coalesce(lead(role) OVER w = 'assistant' AND contains(lead(text) OVER w, '{K.REFUSAL_PHRASE.replace("'", "''")}'), false) AS open
    FROM ({MSG}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
query("refused_questions", "conv_id:b, turn:b, text:s", f"SELECT conv_id, turn, text FROM ({_NEXT}) WHERE open")(
    lambda spark, sf: CV.refused_questions(messages(spark, sf)))

query("transcripts", "conv_id:b, part_no:b, start:b, transcript:s", f"""
    SELECT *, coalesce(sum(length(transcript) + 1) OVER (PARTITION BY conv_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
    SELECT conv_id, turn // 4 AS part_no, string_agg(CASE role WHEN 'user' THEN 'USER> ' || text WHEN 'assistant' THEN 'ASSISTANT> ' || text ELSE '[' || role || '] ' || text END || chr(10),
    chr(10) ORDER BY turn) AS transcript FROM ({MSG}) GROUP BY conv_id, turn // 4)""")(
    lambda spark, sf: CV.transcripts(messages(spark, sf), 4))

query("payload_summary", "conv_id:b, summary:s", f"""
    SELECT conv_id, 'messages=' || count(*) || ' | total_chars=' || sum(length(text)) || ' | payload_sha1=' || left(sha1(string_agg(role || chr(10) || text || chr(10) || '---' || chr(10), '' ORDER BY turn)), 12)
    || ' | layout=' || string_agg(role || ':' || length(text), ', ' ORDER BY turn) AS summary FROM ({MSG}) GROUP BY conv_id""")(
    lambda spark, sf: CV.payload_summary(messages(spark, sf)))

_SUM = f"""
    WITH n AS ({_NEXT}),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM n) WHERE age <= 8),
    s AS (SELECT *, {X.simplified('text')} AS st FROM r),
    i AS (SELECT conv_id, turn, 1 AS kind, '- ' || {X.compact('st', 280)} AS line FROM s WHERE role = 'user'
        UNION ALL SELECT conv_id, turn, 2, '- ' || c FROM (SELECT *, {X.compact('st', 320)} AS c FROM s WHERE role = 'assistant') WHERE NOT contains(c, '{K.REFUSAL_PHRASE.replace("'", "''")}')
        UNION ALL SELECT conv_id, turn, 3, '- ' || {X.compact('st', 160)} FROM s WHERE open),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn DESC) AS back FROM i) WHERE (kind = 1 AND back <= 3) OR (kind = 2 AND back <= 2) OR kind = 3),
    g AS (SELECT conv_id, kind, CASE kind WHEN 1 THEN '=== User goals (recent) ===' WHEN 2 THEN '=== Assistant conclusions (recent) ===' ELSE '=== Unresolved questions ===' END
        || chr(10) || string_agg(line, chr(10) ORDER BY turn) AS part FROM k GROUP BY conv_id, kind)
    --final
    SELECT c.conv_id, coalesce(b, 'No persisted summary yet.') AS summary FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN (SELECT conv_id, string_agg(part, chr(10) || chr(10) ORDER BY kind) AS b FROM g GROUP BY conv_id) x ON c.conv_id = x.conv_id"""
query("summarize_sessions", "conv_id:b, summary:s", _SUM)(lambda spark, sf: CV.summarize_sessions(messages(spark, sf)))

_L = D.Duck().unnest(f"({MSG}) AS m", "string_split(text, chr(10))", "conv_id, turn")
query("code_blocks", "conv_id:b, turn:b, block_no:b, language:s, code:s", f"""
    WITH l AS ({_L}),
    f AS (SELECT *, strpos(item, '```') AS fpos, sum((strpos(item, '```') > 0)::INT) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM l),
    g AS (SELECT *, CASE WHEN fpos > 0 THEN n - 1 ELSE n END AS prior FROM f),
    h AS (SELECT *, (prior + CASE WHEN prior % 2 = 1 THEN 1 ELSE 2 END) // 2 AS span FROM g WHERE fpos > 0 OR prior % 2 = 1),
    b AS (SELECT conv_id, turn, span, max(CASE WHEN fpos > 0 AND prior % 2 = 0 THEN {X.trimmed('substr(item, fpos + 3)')} END) AS language,
        {X.trimmed("coalesce(string_agg(CASE WHEN fpos > 0 THEN left(item, fpos - 1) ELSE item END, chr(10) ORDER BY pos) FILTER (WHERE prior % 2 = 1), '')")} AS code
        FROM h GROUP BY conv_id, turn, span)
    --final
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY span) AS block_no, language, code FROM b WHERE code <> ''""")(
    lambda spark, sf: CV.code_blocks(messages(spark, sf)))
