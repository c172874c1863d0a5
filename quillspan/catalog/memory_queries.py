"""Memory table operators over memories derived from user messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan import constants as K
from quillspan.catalog import derived as D, duck as X
from quillspan.catalog.registry import query
from quillspan.functions import labels as LB
from quillspan.operators import memory as M

MEM, PROMPTS = D.sql(D.memories), D.sql(D.prompts)

query("prompt_safe_value", "id:s, safe:o", f"SELECT id, {X.safe_value('value')} AS safe FROM ({MEM})")(
    lambda spark, sf: D.frame(spark, sf, D.memories).select("id", LB.prompt_safe_value(F.col("value")).alias("safe")))

query("prompt_safe_memory", "id:s, safe:o", f"""
    SELECT id, {X.safe_value('value')} AND NOT contains(qk, vk) AND NOT contains(vk, qk) AS safe FROM (
    SELECT m.id, m.value, {X.memory_key('m.value')} AS vk, {X.memory_key('c.text')} AS qk FROM ({MEM}) m JOIN conversations c
    ON m.id = 'm' || c.conv_id || '_' || c.turn)""")(
    lambda spark, sf: D.frame(spark, sf, D.memories).join(spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"), "text"), "id").select(
        "id", LB.prompt_safe_memory(F.col("value"), F.col("text")).alias("safe")))


def _strip(rules: list[str], x: str) -> str:
    cases = " ".join(f"WHEN {X.matches(x, p)} THEN {X.trimmed(X.re_first(x, p, ''))}" for p in rules)
    return f"CASE {cases} ELSE {x} END"


def _value_ctes(name: str, source: str, x: str) -> str:
    """Steps of memory_value over column ``x``: n1 squashed, n2 with its end mark, ``name`` clipped."""
    q = chr(34)
    return f"""
    {name}1 AS (SELECT *, {X.trimmed(X.re_all(X.re_all(x, f"^[{q}'`" + r"\t-\r ]+|[" + q + "'`" + r"\t-\r ]+\z", ''), r'[\t-\r ]+', ' '))} AS n1 FROM {source}),
    {name}2 AS (SELECT *, {X.simplified(f"CASE WHEN n1 = '' OR regexp_matches(n1, '[.!?]" + chr(92) + "z') THEN n1 ELSE n1 || '.' END")} AS n2 FROM {name}1),
    {name}3 AS (SELECT *, {X.compact('n2', 220)} AS {name} FROM {name}2)"""


_EXTRACT = f"""
    WITH b AS (SELECT conv_id, turn, {X.trimmed('prompt')} AS t, lower({X.trimmed('prompt')}) AS lp FROM ({PROMPTS})),
    r AS (SELECT conv_id, turn, {_strip(K.RE_REMEMBER, 't')} AS x FROM b WHERE {X.starts_any('lp', K.REMEMBER_PREFIXES)}),
    {_value_ctes('note', 'r', 'x')},
    l AS (SELECT conv_id, turn, {_strip(K.RE_PREFER, 't')} AS x FROM b WHERE {X.starts_any('lp', K.PREFER_PREFIXES)} OR contains(lp, 'from now on')),
    {_value_ctes('pref', 'l', 'x')},
    found AS (SELECT conv_id, turn, {X.memory_key('left(note, 48)')} AS key, note AS value, 'explicit-memory' AS category, 1.0 AS confidence FROM note3 WHERE {X.safe_value('note')}
        UNION ALL SELECT conv_id, turn, 'preference-' || {X.memory_key('left(pref, 40)')}, pref, 'preference', 0.95 FROM pref3 WHERE {X.safe_value('pref')}
        UNION ALL SELECT conv_id, turn, 'platform_version', regexp_extract(t, '{K.RE_PLATFORM}', 1), 'environment', 0.9 FROM b WHERE {X.matches('t', K.RE_PLATFORM)})
    --final
"""


def _extracted(spark, sf_dir):
    return M.extract_memories(D.frame(spark, sf_dir, D.prompts), "prompt")


query("extract_memories", "conv_id:b, turn:b, key:s, value:s, category:s, confidence:d", _EXTRACT + "SELECT * FROM found")(_extracted)


def _split(spark, sf_dir):
    """Stored memories of the first turns, later ones arriving in message order; some bring the id of a stored one."""
    rows = D.frame(spark, sf_dir, D.memories).withColumn("key", F.when(F.col("seq") % 5 == 0, "").otherwise(F.col("key")))
    first = F.concat(F.regexp_extract("id", "^[^_]*_", 0), F.lit("0"))
    later = rows.filter("seq % 100 >= 2").withColumn("id", F.when(F.col("seq") % 7 == 3, first).otherwise(F.col("id")))
    return rows.filter("seq % 100 < 2").drop("seq"), later


query("upsert_memories", "key:s, category:s, value:s, created_at:s, updated_at:s, confidence:d, pinned:o", f"""
    WITH m AS (SELECT * REPLACE (CASE WHEN seq % 5 = 0 THEN '' ELSE key END AS key,
        CASE WHEN seq % 100 >= 2 AND seq % 7 = 3 THEN split_part(id, '_', 1) || '_0' ELSE id END AS id) FROM ({MEM})),
    st AS (SELECT * FROM m WHERE seq % 100 < 2), inc AS (SELECT * FROM m WHERE seq % 100 >= 2),
    kk AS (SELECT key, category, min(id) AS key_id FROM st WHERE key <> '' GROUP BY 1, 2),
    a AS (SELECT inc.*, key_id, st.id AS known FROM inc LEFT JOIN kk ON inc.key = kk.key AND inc.category = kk.category LEFT JOIN st ON st.id = inc.id),
    nk AS (SELECT key, category, arg_min(id, seq) AS new_id FROM a WHERE key_id IS NULL AND known IS NULL AND key <> '' GROUP BY 1, 2),
    r AS (SELECT 0 AS late, id AS slot, * FROM st UNION ALL BY NAME SELECT 1 AS late, coalesce(key_id, known, new_id, a.id) AS slot, a.* EXCLUDE (key_id, known)
        FROM a LEFT JOIN nk ON a.key = nk.key AND a.category = nk.category),
    o AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY late, seq, id) AS n FROM r),
    f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY slot ORDER BY n DESC) = 1),
    t AS (SELECT o.slot, max(o.n) FILTER (WHERE o.key = '' OR o.key <> f.key OR o.category <> f.category) AS turn FROM o JOIN f ON o.slot = f.slot GROUP BY 1),
    c AS (SELECT o.slot, arg_min(o.created_at, o.n) AS created FROM o JOIN t ON o.slot = t.slot WHERE o.n > coalesce(turn, 0) GROUP BY 1)
    --final
    SELECT key, category, value, coalesce(created, created_at) AS created_at, updated_at, confidence, pinned FROM f LEFT JOIN c ON f.slot = c.slot""")(
    lambda spark, sf: M.upsert_memories(*_split(spark, sf)))

query("delete_memories", "id:s, value:s", f"SELECT id, value FROM ({MEM}) WHERE seq % 3 <> 0")(
    lambda spark, sf: M.delete_memories(D.frame(spark, sf, D.memories), D.frame(spark, sf, D.memories).filter("seq % 3 = 0").select(
        F.concat(F.lit(" "), "id").alias("id"))))

query("edit_memories", "id:s, key:s, value:s, pinned:o, updated_at:s, created_at:s", f"""
    SELECT id, key, CASE WHEN seq % 2 = 0 AND seq % 3 <> 0 THEN 'new ' || {X.simplified('key')} ELSE value END AS value, CASE WHEN seq % 2 = 0 AND seq % 3 <> 0 THEN true ELSE pinned END AS pinned,
    CASE WHEN seq % 2 = 0 AND seq % 3 <> 0 THEN '2025' ELSE updated_at END AS updated_at, created_at FROM (SELECT * FROM ({MEM}))""")(
    lambda spark, sf: M.edit_memories(
        D.frame(spark, sf, D.memories), D.frame(spark, sf, D.memories).filter("seq % 2 = 0").select(
            "id", F.when(F.col("seq") % 3 == 0, "  ").otherwise(F.concat(F.lit(" new  "), "key")).alias("value"), F.lit(True).alias("pinned")), "2025"))

query("order_memories", "id:s, pinned:o, updated_at:s, place:b", f"""
    SELECT id, pinned, updated_at, row_number() OVER (ORDER BY pinned DESC, updated_at DESC, id) - 1 AS place FROM ({MEM})""")(
    lambda spark, sf: M.order_memories(D.frame(spark, sf, D.memories)))

_QUERIES = D.sql(D.queries)
_TERMS = f"list_filter({X.token_list('lower(query)', 'a-z0-9._-')}, lambda t: length(t) >= 4)"
_SCORED = f"""
    WITH mem AS (SELECT *, CASE WHEN pinned THEN 8 ELSE 0 END + CASE WHEN confidence >= 0.95 THEN 4 WHEN confidence >= 0.8 THEN 2 ELSE 0 END AS base FROM ({MEM})),
    qs AS (SELECT query_id, query, list_distinct({_TERMS}) AS terms FROM ({_QUERIES})),
    qt AS (SELECT query_id, unnest(terms) AS t FROM qs),
    pt AS (SELECT query_id, id, CASE WHEN lower(key) = t THEN 40 WHEN contains(lower(key), t) THEN 24 ELSE 0 END + CASE WHEN lower(category) = t THEN 20
        WHEN contains(lower(category), t) THEN 12 ELSE 0 END + CASE WHEN contains(lower(value), t) THEN 10 ELSE 0 END AS p FROM mem CROSS JOIN qt),
    ms AS (SELECT query_id, id, sum(p) + 3 * count(*) AS pts FROM pt WHERE p > 0 GROUP BY query_id, id)"""

query("memory_scores", "query_id:b, id:s, score:b", _SCORED + """
    --final
    SELECT query_id, ms.id, pts + base AS score FROM ms JOIN mem ON ms.id = mem.id""")(
    lambda spark, sf: M.memory_scores(D.frame(spark, sf, D.memories), D.frame(spark, sf, D.queries)))

_RANKED = _SCORED + f""",
    al AS (SELECT q.query_id, q.query, mem.*, CASE WHEN len(terms) = 0 THEN pinned::INT ELSE coalesce(pts, 0) + base END AS score FROM mem CROSS JOIN qs q
        LEFT JOIN ms ON ms.query_id = q.query_id AND ms.id = mem.id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score + CASE WHEN pinned THEN 50 ELSE 0 END DESC, pinned DESC, updated_at DESC, id) AS pr
        FROM al WHERE score > 0 OR pinned),
    sk AS (SELECT *, {X.memory_key('query')} AS qk, {X.memory_key('value')} AS vk FROM rk WHERE pr <= 12),
    fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pr) AS rank FROM sk WHERE {X.safe_value('value')} AND NOT contains(qk, vk) AND NOT contains(vk, qk))
    --final
"""
query("relevant_memories", "query_id:b, rank:b, id:s, score:b", _RANKED + "SELECT query_id, rank, id, score FROM fin WHERE rank <= 6")(
    lambda spark, sf: M.relevant_memories(D.frame(spark, sf, D.memories), D.frame(spark, sf, D.queries)))

query("memory_context", "query_id:b, memory_context:s", _RANKED + """
    SELECT query_id, string_agg('[' || category || '] ' || CASE WHEN key = '' THEN 'note' ELSE key END || ' = ' || value, chr(10) ORDER BY rank) AS memory_context
    FROM fin WHERE rank <= 6 GROUP BY query_id""")(
    lambda spark, sf: M.memory_context(M.relevant_memories(D.frame(spark, sf, D.memories), D.frame(spark, sf, D.queries))))

_ABOUT = f"""SELECT *, 'Stored as a ' || category || ' memory' || CASE WHEN {X.trimmed('key')} = '' THEN '' ELSE ' under key ''' || {X.trimmed('key')} || '''' END
    || ' for reuse when later prompts match this topic.' || CASE WHEN pv = '' THEN '' ELSE ' Value preview: ' || pv END AS about
    FROM (SELECT *, {X.compact('sv', 96)} AS pv FROM (SELECT *, {X.simplified('value')} AS sv FROM ({MEM})))"""

query("memory_description", "id:s, about:s", f"SELECT id, about FROM ({_ABOUT})")(
    lambda spark, sf: D.frame(spark, sf, D.memories).select(
        "id", LB.memory_description(F.col("category"), F.col("key"), F.col("value")).alias("about")))

query("memory_cards", "id:s, card:s", f"""
    SELECT id, CAST(to_json(struct_pack(id := id, category := category, key := key, value := value, updated_at := updated_at, created_at := created_at,
    confidence := confidence::DOUBLE, pinned := pinned, description := about)) AS VARCHAR) AS card FROM ({_ABOUT})""")(
    lambda spark, sf: M.memory_cards(D.frame(spark, sf, D.memories).withColumn("confidence", F.col("confidence").cast("double"))))
