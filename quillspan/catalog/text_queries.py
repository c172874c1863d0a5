"""Text functions over documents and texts derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan import constants as K
from quillspan.catalog import derived as D, duck as X
from quillspan.catalog.registry import query
from quillspan.functions import lines as L, scoring as S, terms as TM, text as T


def _over(template, columns):
    """Query function: doc_id plus the columns built from the text, over a derived table."""
    def run(spark, sf_dir):
        built = columns(F.col("text"))
        return D.frame(spark, sf_dir, template).select("doc_id", *[c.alias(n) for n, c in built.items()])

    return run


query("clean_text", "doc_id:b, cleaned:s", f"SELECT doc_id, {X.clean('text')} AS cleaned FROM ({D.sql(D.dirty)})")(
    _over(D.dirty, lambda C: dict(cleaned=T.clean_text(C))))

query("normalize_block", "doc_id:b, block:s",
      f"SELECT doc_id, {X.normalize_block('text')} AS block FROM ({D.sql(D.shaped)})")(
    _over(D.shaped, lambda C: dict(block=T.normalize_block(C))))

query("compact_preview", "doc_id:b, p60:s, p520:s", f"""
    SELECT doc_id, {X.preview('t', 60)} AS p60, {X.preview('t', 520)} AS p520
    FROM (SELECT doc_id, {X.normalize_block('text')} AS t FROM ({D.sql(D.shaped)}))""")(
    _over(D.shaped, lambda C: dict(p60=T.compact_preview(C, 60), p520=T.compact_preview(C, 520))))

query("simplified", "doc_id:b, simple:s, c96:s", f"""
    SELECT doc_id, t AS simple, {X.compact('t', 96)} AS c96
    FROM (SELECT doc_id, {X.simplified('text')} AS t FROM ({D.sql(D.dirty)}))""")(
    _over(D.dirty, lambda C: dict(simple=T.simplified(C), c96=T.compact(C, 96))))

query("count_words", "doc_id:b, words:b", f"SELECT doc_id, {X.words('text')} AS words FROM documents")(
    _over(D.documents, lambda C: dict(words=T.count_words(C))))

query("count_lines", "doc_id:b, n_lines:b", f"SELECT doc_id, {X.lines('text')} AS n_lines FROM documents")(
    _over(D.documents, lambda C: dict(n_lines=T.count_lines(C))))

query("fingerprint", "doc_id:b, fp:s", f"SELECT doc_id, sha1({X.simplified('text')}) AS fp FROM documents")(
    _over(D.documents, lambda C: dict(fp=T.fingerprint(C))))

query("content_hash", "doc_id:b, digest:s", "SELECT doc_id, sha1(text) AS digest FROM documents")(
    _over(D.documents, lambda C: dict(digest=T.content_hash(F.encode(C, "UTF-8")))))

query("sanitize_for_embedding", "doc_id:b, t:s", f"""
    SELECT doc_id, {X.trimmed(X.re_all(X.re_all(X.re_all(X.unix('text'), r'[\x00-\x08\x0B\x0C\x0E-\x1F\x{A0}]', ' '),
                                                r'[ \t]{2,}', ' '), chr(10) + '{4,}', chr(10) * 3))} AS t
    FROM ({D.sql(D.dirty)})""")(_over(D.dirty, lambda C: dict(t=T.sanitize_for_embedding(C))))

_OTHER = r"[\p{L}\p{N}" + X._WS + r"{}\[\]()<>:=/\\|@#%&*_+\-;,.!?" + '"]'


def tokens_sql(x: str) -> str:
    """Token estimate of a text."""
    runs, nl = X.words(x), X.count_of(x, chr(10))
    dense = X.count_re(x, r'[{}\[\]()<>:=/\\|@#%&*_+\-;,.!?"]')
    space = f"{X.count_re(x, '[' + X._WS + ']')} - {nl}"
    return (
        f"CASE WHEN {X.trimmed(x)} = '' THEN 0 ELSE greatest(1, CAST(ceil(({X.alnum(x)} + {runs} + 3 * ({nl}) + {space} + 4 * {dense} "
        f"+ 2 * length({X.re_all(x, _OTHER, '')})) / 4.0) AS BIGINT)) END"
    )


query("estimate_tokens", "doc_id:b, tokens:b", f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM ({D.sql(D.shaped)})")(
    _over(D.shaped, lambda C: dict(tokens=T.estimate_tokens(C))))

query("clip_for_embedding", "doc_id:b, clipped:s")(_over(D.shaped, lambda C: dict(clipped=T.clip_for_embedding(C))))

_LINES = D.sql(D.shaped)


def _line_rows(spark, sf_dir):
    from quillspan.operators.blocks import explode_lines

    return explode_lines(D.frame(spark, sf_dir, D.shaped))


_LINE_SQL = f"""
    WITH raw AS ({D.Duck().unnest(f'({_LINES}) AS s', "string_split(text, chr(10))", 'doc_id')}),
    line AS (SELECT doc_id, pos, item AS raw, {X.trimmed('item')} AS line FROM raw)
    --final
"""


@query("line_predicates", "doc_id:b, pos:b, heading:o, bullet:o, code:o, marker:o, fence:o, lead:o", _LINE_SQL + f"""
    SELECT doc_id, pos, {X.is_heading('line')} AS heading, {X.is_bullet('line')} AS bullet, {X.is_code('raw', 'line')} AS code,
    {X.is_marker('line')} AS marker, {X.is_fence('line')} AS fence, {X.is_lead('line')} AS lead FROM line""")
def line_predicates(spark, sf_dir):
    line, raw = F.col("line"), F.col("raw")
    return _line_rows(spark, sf_dir).select(
        "doc_id", "pos", L.is_heading(line).alias("heading"), L.is_bullet(line).alias("bullet"),
        L.is_code_like(raw).alias("code"), L.is_page_marker(line).alias("marker"), L.is_fence(line).alias("fence"),
        L.is_procedural_lead(line).alias("lead"))


@query("contents_lines", "doc_id:b, pos:b, contents:o, okey:s, stripped:s, top:o", _LINE_SQL + f"""
    SELECT doc_id, pos, {X.is_contents('line')} AS contents, {X.outline_key('line')} AS okey,
    {X.strip_page('line')} AS stripped, {X.matches('line', K.RE_TOP_HEADING)} AS top FROM line""")
def contents_lines(spark, sf_dir):
    line = F.col("line")
    return _line_rows(spark, sf_dir).select(
        "doc_id", "pos", L.looks_like_contents_entry(line).alias("contents"), L.normalize_outline_key(line).alias("okey"),
        L.strip_trailing_page_number(line).alias("stripped"), L.is_top_level_heading(line).alias("top"))


query("actionability", "doc_id:b, score:b", f"""
    SELECT doc_id, CASE WHEN contains(t, '```') THEN 6 ELSE 0 END + CASE WHEN {X.matches('t', K.RE_COMMAND_LINE)} THEN 7 ELSE 0 END
    + {" + ".join(f"CASE WHEN {X.has_any('lower(t)', w)} THEN {p} ELSE 0 END" for p, w in K.ACTION_WORDS)}
    + CASE WHEN {X.matches('t', K.RE_BULLET_LINE)} THEN 2 ELSE 0 END + CASE WHEN {X.matches('t', K.RE_NUMBERED_LINE)} THEN 3 ELSE 0 END
    + CASE WHEN {X.matches('t', K.RE_KEY_VALUE_LINE)} THEN 2 ELSE 0 END
    + CASE WHEN {X.has_any('t', ['{', '=', '->'])} THEN 1 ELSE 0 END AS score
    FROM (SELECT doc_id, {X.normalize_block('text')} AS t FROM ({D.sql(D.shaped)}))""")(
    _over(D.shaped, lambda C: dict(score=L.actionability(C))))

query("looks_like_structure", "doc_id:b, structure:o",
      f"SELECT doc_id, {X.structure('text')} AS structure FROM ({D.sql(D.shaped)})")(
    _over(D.shaped, lambda C: dict(structure=L.looks_like_structure(C))))

query("balanced_trim", "doc_id:b, t:s", f"""
    SELECT doc_id, {X.balanced('t', '700')} AS t FROM (SELECT doc_id, {X.trimmed('text')} AS t FROM documents)""")(
    _over(D.documents, lambda C: dict(t=T.balanced_trim(C, 700))))

query("trim_for_budget", "doc_id:b, t:s, tiny:s", f"""
    SELECT doc_id, {X.trim_budget('t', 900)} AS t, {X.trimmed('left(t, 40)')} AS tiny
    FROM (SELECT doc_id, {X.trimmed('text')} AS t FROM documents)""")(
    _over(D.documents, lambda C: dict(t=T.trim_for_budget(C, 900), tiny=T.trim_for_budget(C, 40))))



def retry_sql(x: str, limit: int) -> str:
    """A trimmed text cut for a retry, ``limit`` characters at most."""
    usable = limit - len(K.RETRY_TRIM_MARKER)
    head = usable * 11 // 20
    joined = f"{X.trimmed(f'left({x}, {head})')} || '{K.RETRY_TRIM_MARKER}' || {X.trimmed(f'right({x}, {usable - head})')}"
    return f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE {X.trimmed(f'left({joined}, {limit})')} END"


query("compact_for_retry", "doc_id:b, t:s", f"""
    SELECT doc_id, {retry_sql('t', 900)} AS t FROM (SELECT doc_id, {X.trimmed('text')} AS t FROM documents)""")(
    _over(D.documents, lambda C: dict(t=T.compact_for_retry(C, 900))))

query("dedup_key", "conv_id:b, turn:b, k:s", f"SELECT conv_id, turn, {X.dedup_key('text')} AS k FROM ({D.sql(D.tagged)})")(
    lambda spark, sf: D.frame(spark, sf, D.tagged).select("conv_id", "turn", T.dedup_key(F.col("text")).alias("k")))

query("sanitize_section", "conv_id:b, turn:b, t:s",
      f"SELECT conv_id, turn, {X.sanitize_section('text')} AS t FROM ({D.sql(D.tagged)})")(
    lambda spark, sf: D.frame(spark, sf, D.tagged).select("conv_id", "turn", T.sanitize_section(F.col("text")).alias("t")))

query("looks_code_like", "conv_id:b, turn:b, code:o", f"""
    SELECT conv_id, turn, {X.trimmed('text')} <> '' AND (signals >= 2 OR punct >= 6 OR (signals >= 1 AND indented >= 1)) AS code
    FROM (SELECT conv_id, turn, text, {" + ".join(f"CAST(contains(lower(text), '{s}') AS INT)" for s in K.CODE_SIGNALS)} AS signals,
    length(text) - length({X.re_all('text', '[{};()#]', '')}) AS punct,
    len(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '    ') OR starts_with(l, chr(9)))) AS indented
    FROM ({D.sql(D.marked_messages)}))""")(
    lambda spark, sf: D.frame(spark, sf, D.marked_messages).select("conv_id", "turn", T.looks_code_like(F.col("text")).alias("code")))


def _fenced(d) -> str:
    """Message texts with inline break tags beside fences and, in every third, an open fence."""
    return (
        f"SELECT conv_id, turn, text || chr(13) || chr(10) || '```sql<br/>' || text || '<br>```' || chr(10) || 'x' "
        f"|| chr(10) || chr(10) || chr(10) || chr(10) || CASE WHEN (conv_id + turn) % 3 = 0 THEN '```py' || chr(10) || 'y' ELSE 'z' END AS text "
        f"FROM {d.table('conversations')}"
    )


_H1 = X.re_all(X.re_all(f"replace({X.unix('text')}, chr(0), '')", r"(?i)```([A-Za-z0-9_+\-]*)<br\s*/?>", "```\\1\n"),
               r"(?i)<br\s*/?>```", "\n```")
_H2 = "CASE WHEN fences % 2 = 1 THEN CASE WHEN ends_with(t, chr(10)) THEN t || '```' || chr(10) ELSE t || chr(10) || '```' || chr(10) END ELSE t END"
_H3 = X.re_all(X.re_all(X.re_all("u", "\n{3,}", "\n\n"), "([^\n])\n(```[A-Za-z0-9_+#\\-]*\n)", "\\1\n\n\\2"), "(\n```\n)([^\n])", "\\1\n\\2")
query("answer_hygiene", "conv_id:b, turn:b, t:s", f"""
    SELECT conv_id, turn, {X.trimmed(_H3)} AS t FROM (SELECT conv_id, turn, {_H2} AS u FROM (
    SELECT conv_id, turn, t, len(list_filter(string_split(t, chr(10)), lambda l: starts_with({X.trimmed('l')}, '```'))) AS fences
    FROM (SELECT conv_id, turn, {_H1.replace("replace(" + X.unix('text') + ", chr(0), '')", X.unix('text'))} AS t FROM ({_fenced(D.Duck())}))))""")(
    lambda spark, sf: D.frame(spark, sf, _fenced).select("conv_id", "turn", T.answer_hygiene(F.col("text")).alias("t")))


def _packets(d) -> str:
    return (
        f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '=== DOCUMENT_STUDY_PACKET: x' || text || '--- Source: a --- Source: b' "
        f"WHEN doc_id % 3 = 1 THEN 'FULL_DOCUMENT_TEXT:' || text ELSE text || '   ' END AS text FROM {d.table('documents')}"
    )


query("marker_summary", "doc_id:b, summary:s", f"""
    SELECT doc_id, CASE WHEN {X.trimmed('text')} = '' THEN 'chars=0 | sha1=<empty>' ELSE 'chars=' || length(text) || ' | sha1=' || left(sha1(text), 12)
    || {" || ".join(f"' | {n}=' || {X.count_of('text', m)}" for n, m in K.PACKET_MARKERS.items())} END AS summary
    FROM ({_packets(D.Duck())})""")(
    lambda spark, sf: D.frame(spark, sf, _packets).select("doc_id", T.marker_summary(F.col("text")).alias("summary")))

query("normalize_loop_line", "doc_id:b, t:s", f"SELECT doc_id, {X.loop_line('text')} AS t FROM documents")(
    _over(D.documents, lambda C: dict(t=T.normalize_loop_line(C))))

query("query_terms", "query_id:b, terms:s", f"""
    SELECT query_id, array_to_string({X.ordered_distinct('t')}, ' ') AS terms
    FROM (SELECT prompt_id AS query_id, {X.query_terms('prompt')} AS t FROM ({D.sql(D.prompts)}))""")(
    lambda spark, sf: D.frame(spark, sf, D.prompts).select(
        F.col("prompt_id").alias("query_id"), F.array_join(TM.query_terms(F.col("prompt")), " ").alias("terms")))

_RAW = X.token_list("lower(text)", "a-z0-9.+_-")
_SYN = X.synonym_map(K.EMBED_SYNONYMS)


def embed_tokens_sql(rows: str, mark: str = "") -> str:
    """CTEs up to ``tok{mark}(doc_id, token)`` of the rows (doc_id, text)."""
    return f"""
    raw{mark} AS (SELECT doc_id, {_RAW} AS items FROM {rows}),
    one{mark} AS (SELECT doc_id, idx, items[idx] AS t, items[idx + 1] AS nxt FROM (SELECT *, unnest(range(1, len(items) + 1)) AS idx FROM raw{mark})),
    tok{mark} AS (SELECT doc_id, unnest(list_concat(list_concat([t], coalesce(({_SYN})[t], [])),
        list_concat(CASE WHEN length(t) >= 5 THEN list_transform(range(1, length(t) - 1), lambda j: substr(t, j, 3)) ELSE [] END,
        CASE WHEN length(nxt) >= 2 THEN [t || '_' || nxt] ELSE [] END))) AS token FROM one{mark} WHERE length(t) >= 2)"""


EMBED_TOKENS_SQL = embed_tokens_sql("documents")

query("embedding_tokens", "doc_id:b, token:s, freq:b", f"""
    WITH {EMBED_TOKENS_SQL}
    --final
    SELECT doc_id, token, count(*) AS freq FROM tok GROUP BY ALL""")(
    lambda spark, sf: _frequencies(spark, sf))


def _frequencies(spark, sf_dir):
    from quillspan.operators.embed import token_frequencies

    return token_frequencies(D.frame(spark, sf_dir, D.documents), ["doc_id"])


query("lexical_score", "doc_id:b, score:d", f"""
    WITH q AS (SELECT item_id, text AS query, {X.query_terms('text')} AS tl FROM benchmark),
    u AS (SELECT item_id, query, list_distinct(tl) AS terms FROM q),
    j AS (SELECT doc_id, lower(d.text) AS body, 'doc_' || doc_id AS name, trim(lower(query)) AS query, terms
        FROM documents d JOIN u ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = u.item_id),
    t AS (SELECT doc_id, body, name, query, len(terms) AS n, unnest(terms) AS term FROM j),
    c AS (SELECT *, {X.occurrences('body', 'term')} AS b, {X.occurrences('name', 'term')} AS f FROM t)
    --final
    SELECT doc_id, sum(CASE WHEN b > 0 THEN 0.95 + least(1.25, 0.16 * (b - 1)) ELSE 0 END::DOUBLE
        + CASE WHEN f > 0 THEN 0.55 + least(0.75, 0.18 * (f - 1)) ELSE 0 END::DOUBLE)
        + 1.8::DOUBLE * count(*) FILTER (WHERE b > 0 OR f > 0) / max(n)
        + CASE WHEN contains(any_value(body), any_value(query)) THEN 1.2 ELSE 0 END::DOUBLE
        + CASE WHEN contains(any_value(name), any_value(query)) THEN 0.75 ELSE 0 END::DOUBLE AS score FROM c GROUP BY doc_id""")(
    lambda spark, sf: _lexical(spark, sf))


def _probed(spark, sf_dir, template):
    """Every document with the number of its query, and the benchmark texts as queries by number."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = D.frame(spark, sf_dir, template).crossJoin(items.agg((F.max("item_id") + 1).alias("n")))  # one row
    return docs.withColumn("probe", F.col("doc_id") % F.col("n")), items.select(F.col("item_id").alias("probe"), F.col("text").alias("query"))


def _lexical(spark, sf_dir):
    docs, probes = _probed(spark, sf_dir, D.documents)
    return docs.join(probes, "probe").withColumn("terms", TM.query_terms(F.col("query"))).filter(F.size("terms") > 0).select(
        "doc_id", S.lexical_score(F.col("text"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.col("terms"),
                                  F.col("query")).alias("score"))


_POS = "list_filter(list_transform(terms, lambda t: strpos(low, t) - 1), lambda p: p >= 0)"


def _window_sql(anchor: str, before: int, after: int) -> str:
    start = f"greatest(0, {anchor} - {before})"
    end = f"least(length(norm), {anchor} + {after})"
    prev = f"({X.last_nl('norm', start)})"
    s = f"CASE WHEN {prev} >= 0 AND {start} - {prev} <= 120 THEN {prev} + 1 ELSE {start} END"
    nxt = f"CASE WHEN contains(substr(norm, {end} + 1), chr(10)) THEN {end} + strpos(substr(norm, {end} + 1), chr(10)) - 1 ELSE -1 END"
    e = f"CASE WHEN ({nxt}) >= 0 AND ({nxt}) - {end} <= 180 THEN ({nxt}) ELSE {end} END"
    return X.trimmed(f"substr(norm, ({s}) + 1, greatest(0, ({e}) - ({s})))")


def excerpt_sql(rows: str, keys: str) -> str:
    """CTEs up to ``exc(keys, excerpt)`` of ``rows`` (keys, text, terms)."""
    later = f"head || '{K.EXCERPT_LATER_MARKER}' || tail"
    body = X.normalize_block(f"CASE WHEN len(pos) >= 2 AND hi - lo > 280 AND tail <> '' AND tail <> head THEN {later} ELSE head END")
    return f"""exj AS (SELECT {keys}, {X.normalize_block('text')} AS norm, terms FROM ({rows})),
    exp_ AS (SELECT {keys}, norm, {_POS} AS pos FROM (SELECT *, lower(norm) AS low FROM exj)),
    exm AS (SELECT {keys}, norm, pos, list_min(pos) AS lo, list_max(pos) AS hi FROM exp_),
    exw AS (SELECT {keys}, norm, pos, lo, hi, {_window_sql('lo', 140, 420)} AS head, {_window_sql('hi', 110, 260)} AS tail FROM exm),
    exb AS (SELECT {keys}, norm, pos, {body} AS ex FROM exw),
    exc AS (SELECT {keys}, CASE WHEN norm = '' THEN '' WHEN len(pos) = 0 THEN {X.preview('norm', 520)} ELSE {X.preview('ex', 720)} END AS excerpt FROM exb)"""


_EXCERPT_ROWS = f"""SELECT doc_id, d.text, terms FROM ({D.sql(D.shaped)}) d JOIN (SELECT item_id, {X.ordered_distinct(X.query_terms('text'))} AS terms FROM benchmark) b
        ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id"""

query("excerpt", "doc_id:b, excerpt:s", f"WITH {excerpt_sql(_EXCERPT_ROWS, 'doc_id')}\n--final\nSELECT doc_id, excerpt FROM exc")(
    lambda spark, sf: _excerpts(spark, sf))


def _excerpts(spark, sf_dir):
    docs, probes = _probed(spark, sf_dir, D.shaped)
    probes = probes.select("probe", TM.query_terms(F.col("query")).alias("terms"))
    return docs.join(probes, "probe").select("doc_id", S.excerpt(F.col("text"), F.col("terms")).alias("excerpt"))


query("keep_chunk", "path:s, chunk_index:b", f"""
    SELECT path, chunk_index FROM (SELECT *, {X.simplified('text')} AS simple FROM ({D.sql(D.line_chunks)}))
    WHERE {X.keep_chunk('text', 'simple')}""")(
    lambda spark, sf: D.frame(spark, sf, D.line_chunks).filter(L.keep_chunk(F.col("text"))).select("path", "chunk_index"))
