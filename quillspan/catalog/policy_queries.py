"""Redaction, prompt rules and memory-string functions over prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan import constants as K
from quillspan.catalog import derived as D, duck as X
from quillspan.catalog.registry import query
from quillspan.functions import labels as LB, policy as P, terms as TM

PROMPTS = D.sql(D.prompts)

def _over(columns):
    """Query function: prompt_id plus the columns built from the prompt."""
    def run(spark, sf_dir):
        built = columns(F.col("prompt"))
        return D.frame(spark, sf_dir, D.prompts).select("prompt_id", *[c.alias(n) for n, c in built.items()])

    return run


query("redact", "prompt_id:b, t:s", f"SELECT prompt_id, {X.redact('prompt')} AS t FROM ({PROMPTS})")(_over(lambda C: dict(t=P.redact(C))))

query("redact_documents", "doc_id:b, t:s, sensitive:o", f"""
    SELECT doc_id, t, t <> {X.ascii_squash('text')} AS sensitive FROM (SELECT doc_id, text, {X.redact('text')} AS t FROM documents)""")(
    lambda spark, sf: D.frame(spark, sf, D.documents).select(
        "doc_id", P.redact(F.col("text")).alias("t"), P.looks_sensitive(F.col("text")).alias("sensitive")))

query("looks_sensitive", "prompt_id:b, sensitive:o",
      f"SELECT prompt_id, {X.redact('prompt')} <> {X.ascii_squash('prompt')} AS sensitive FROM ({PROMPTS})")(
    _over(lambda C: dict(sensitive=P.looks_sensitive(C))))

_KEYWORDS = (
    f"list_filter({X.token_list('r', 'a-z0-9.+_-')}, lambda w: length(w) >= 3 AND w <> '{K.KEYWORD_DROP}' "
    f"AND NOT {X.one_of('w', K.KEYWORD_STOP_WORDS)})"
)
SEARCH_QUERY_SQL = f"""
    SELECT prompt_id, array_to_string(list_slice({X.ordered_distinct('k')}, 1, 12), ' ') AS sq
    FROM (SELECT prompt_id, {_KEYWORDS} AS k FROM (SELECT prompt_id, lower({X.redact('prompt')}) AS r FROM ({PROMPTS})))"""
query("search_query", "prompt_id:b, sq:s", SEARCH_QUERY_SQL)(_over(lambda C: dict(sq=P.search_query(C))))

_EXTERNAL = (
    f"(lp <> '' AND ({X.matches('lp', K.RE_EXPLICIT_SEARCH)} OR (({X.has_any('lp', K.PUBLIC_SIGNALS)} OR "
    f"{X.matches('lp', K.RE_IDENTITY_QUESTION)}) AND NOT {X.has_any('lp', K.LOCAL_SIGNALS)})))"
)
query("wants_external_search", "prompt_id:b, ext:o", f"""
    SELECT prompt_id, {_EXTERNAL} AS ext FROM (SELECT prompt_id, {X.trimmed('lower(prompt)')} AS lp FROM ({PROMPTS}))""")(
    _over(lambda C: dict(ext=P.wants_external_search(C))))

EXACT = (
    f"(({X.has_any('lp', K.EXTRACTION_VERBS)} AND {X.has_any('lp', K.EXTRACTION_TARGETS)}) OR {X.has_any('lp', K.EXTRACTION_PHRASES)})"
)
STUDY = f"({EXACT} OR {X.has_any('lp', K.STUDY_WORDS)})"
_STRUCT = X.has_any("lp", K.STRUCTURED_DOC_WORDS)
_CASUAL = X.one_of(X.trimmed("lp"), K.CASUAL_PROMPTS)
LOWER = f"(SELECT prompt_id, prompt, lower(prompt) AS lp FROM ({PROMPTS}))"
query("prompt_flags", "prompt_id:b, structured:o, exact:o, study:o, casual:o, grounded:o", f"""
    SELECT prompt_id, {_STRUCT} AS structured, {EXACT} AS exact, {STUDY} AS study, {_CASUAL} AS casual,
    NOT {_CASUAL} AND ({X.has_any('lp', K.GROUNDING_SIGNALS)} OR {_STRUCT}) AS grounded FROM {LOWER}""")(
    lambda spark, sf: D.frame(spark, sf, D.prompts).select("prompt_id", P.prompt_flags(F.col("prompt")).alias("f")).select(
        "prompt_id", F.col("f.structured_document").alias("structured"), F.col("f.exact_extraction").alias("exact"),
        F.col("f.document_study").alias("study"), F.col("f.casual").alias("casual"),
        F.col("f.needs_grounding").alias("grounded")))

TYPE_SQL = (
    f"CASE WHEN NOT {X.has_any('lp', K.DOC_WORDS)} THEN NULL WHEN {X.has_any('lp', ['mop', 'method of procedure'])} THEN 'MOP' "
    f"WHEN {X.has_any('lp', ['runbook', 'playbook'])} THEN 'Runbook' ELSE 'Guide' END"
)
PLAN_INTENT_SQL = (
    f"CASE WHEN dt IN ('MOP', 'Runbook') THEN 'document_generation' WHEN dt = 'Guide' AND {X.has_any('lp', K.ARCHITECTURE_WORDS)} "
    f"THEN 'architecture' WHEN dt = 'Guide' THEN 'document_generation' WHEN {X.has_any('lp', K.TROUBLE_WORDS)} THEN 'troubleshooting' "
    f"WHEN {X.has_any('lp', K.ARCHITECTURE_WORDS)} THEN 'architecture' WHEN {X.has_any('lp', K.IMPLEMENTATION_WORDS)} THEN 'implementation' "
    f"ELSE 'general' END"
)
INLINE_INTENT_SQL = (
    f"CASE WHEN {X.has_any('lp', K.INLINE_TROUBLE_WORDS)} THEN 'troubleshooting' WHEN {STUDY} THEN 'document_generation' "
    f"WHEN {X.has_any('lp', K.INLINE_ARCHITECTURE_WORDS)} THEN 'architecture' "
    f"WHEN {X.has_any('lp', K.INLINE_IMPLEMENTATION_WORDS)} THEN 'implementation' ELSE 'general' END"
)
query("retrieval_intent", "prompt_id:b, doc_type:s, planner:s, inline:s", f"""
    SELECT prompt_id, dt AS doc_type, {PLAN_INTENT_SQL} AS planner, {INLINE_INTENT_SQL} AS inline
    FROM (SELECT *, {TYPE_SQL} AS dt FROM {LOWER})""")(
    _over(lambda C: dict(doc_type=P.document_type(C), planner=P.planner_intent(C), inline=P.inline_intent(C))))

_TP = D.sql(D.transform_prompts)
query("transform_prompt", "prompt_id:b, active:o, instruction:s, source:s", f"""
    WITH a AS (SELECT prompt_id, {X.trimmed('prompt')} AS t FROM ({_TP})),
    b AS (SELECT prompt_id, t, regexp_extract(t, '\\n\\s*\\n') AS gap FROM a),
    c AS (SELECT prompt_id, t, gap, {X.trimmed("CASE WHEN gap = '' THEN t ELSE left(t, strpos(t, gap) - 1) END")} AS f,
        {X.trimmed("CASE WHEN gap = '' THEN '' ELSE substr(t, strpos(t, gap) + length(gap)) END")} AS r FROM b),
    d AS (SELECT *, length(t) >= 500 AND gap <> '' AND f <> '' AND length(r) >= 350 AND length(f) <= 600 AND length(r) >= greatest(450, 2 * length(f))
        AND ({X.has_any('lower(f)', K.TRANSFORM_VERBS)} OR {X.has_any('lower(f)', K.TRANSFORM_CUES)}) AS active FROM c)
    --final
    SELECT prompt_id, active, CASE WHEN active THEN f ELSE '' END AS instruction, CASE WHEN active THEN r ELSE '' END AS source FROM d""")(
    lambda spark, sf: D.frame(spark, sf, D.transform_prompts).select("prompt_id", P.transform_prompt(F.col("prompt")).alias("t")).select(
        "prompt_id", "t.active", "t.instruction", "t.source"))

_ANCHORS = (
    f"list_filter({X.token_list('lp', 'a-z0-9.+_-')}, lambda w: length(w) >= 3 AND NOT {X.one_of('w', K.ANCHOR_STOP_WORDS)})"
)
_KEEP = f"({X.one_of('w', K.ANCHOR_KEEP)} OR " + " OR ".join(f"contains(w, '{p}')" for p in K.ANCHOR_KEEP_PARTS) + ")"
ANCHOR_SQL = f"""SELECT prompt_id, array_to_string(list_filter(a, lambda w, n: n <= {K.ANCHOR_CAP} OR {_KEEP}), ' ') AS anchors
    FROM (SELECT prompt_id, {X.ordered_distinct('a0')} AS a FROM (SELECT prompt_id, {_ANCHORS} AS a0 FROM {LOWER}))"""
query("anchor_terms", "prompt_id:b, anchors:s", ANCHOR_SQL)(_over(lambda C: dict(anchors=F.array_join(TM.anchor_terms(C), " "))))

query("memory_key_value", "prompt_id:b, k:s, v:s", f"""
    SELECT prompt_id, {X.memory_key('prompt')} AS k, {X.compact('s', 220)} AS v FROM (SELECT *, {X.simplified('z')} AS s FROM (
    SELECT *, CASE WHEN y = '' OR {X.matches('y', '[.!?]' + chr(92) + 'z')} THEN y ELSE y || '.' END AS z FROM (SELECT prompt_id, prompt,
    {X.trimmed(X.re_all(X.re_all('prompt', "^[" + chr(34) + "'`" + r"\t-\r ]+|[" + chr(34) + "'`" + r"\t-\r ]+\z", ''), r'[\t-\r ]+', ' '))} AS y FROM ({PROMPTS}))))""")(
    _over(lambda C: dict(k=LB.memory_key(C), v=LB.memory_value(C))))

query("privacy_preview", "prompt_id:b, preview:s", f"""
    WITH s AS ({SEARCH_QUERY_SQL}),
    p AS (SELECT prompt_id, prompt, {X.trimmed('lower(prompt)')} AS lp, {X.redact('prompt')} <> {X.ascii_squash('prompt')} AS sens FROM ({PROMPTS}))
    --final
    SELECT p.prompt_id, 'Original prompt:' || chr(10) || prompt || chr(10) || 'Sensitive input detected: ' || CASE WHEN sens THEN 'yes' ELSE 'no' END
    || 'External search allowed in UI: ' || CASE WHEN p.prompt_id % 2 = 0 THEN 'yes' ELSE 'no' END || 'External search recommended by policy: '
    || CASE WHEN {_EXTERNAL} THEN 'yes' ELSE 'no' END || chr(10) || 'Sanitized external query:' || chr(10)
    || CASE WHEN sq = '' THEN '<empty>' ELSE sq END AS preview FROM p JOIN s ON p.prompt_id = s.prompt_id""")(
    _over(lambda C: dict(preview=P.privacy_preview(C, F.col("prompt_id") % 2 == 0, P.wants_external_search(C), P.search_query(C)))))

query("redacted_export", "prompt_id:b, line:s, sq:s", f"""
    WITH s AS ({SEARCH_QUERY_SQL})
    --final
    SELECT p.prompt_id, '{{"role":' || to_json(role) || ',"content":' || to_json({X.redact('prompt')}) || '}}' AS line, sq
    FROM ({PROMPTS}) p JOIN s ON p.prompt_id = s.prompt_id""")(
    lambda spark, sf: D.frame(spark, sf, D.prompts).select(
        "prompt_id", F.to_json(F.struct("role", P.redact(F.col("prompt")).alias("content"))).alias("line"), P.search_query(F.col("prompt")).alias("sq")))


def _failures(d) -> str:
    """Messages as failure texts: one failure phrase in turn, in front."""
    phrases = ["Model Not Found: ", "unknown model ", "prompt is too long ", "input length exceeds ", "Internal Server Error ",
               "wsarecv: ", "timeout "]
    cases = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(phrases[:-1]))
    return f"SELECT conv_id, turn, CASE (conv_id + turn) % 7 {cases} ELSE '{phrases[-1]}' END || text AS text FROM {d.table('conversations')}"


query("failure_class", "conv_id:b, turn:b, cls:s", f"""
    SELECT conv_id, turn, CASE WHEN {X.has_any('lower(text)', K.PERMANENT_FAILURES)} THEN 'permanent'
    WHEN {X.has_any('lower(text)', K.CONTEXT_FAILURES)} THEN 'context-length' WHEN {X.has_any('lower(text)', K.RUNNER_FAILURES)} THEN 'runner-crash'
    ELSE 'other' END AS cls FROM ({_failures(D.Duck())})""")(
    lambda spark, sf: D.frame(spark, sf, _failures).select("conv_id", "turn", P.failure_class(F.col("text")).alias("cls")))


def diagnostics(d) -> str:
    """Events as diagnostic entries."""
    forms = ["'Ollama request ' || props", "'ollama embedding response ' || props", "'Index ready ' || props", "'note ' || event_type"]
    cases = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms[:-1]))
    return (
        f"SELECT event_id, ts, CASE WHEN event_id % 5 = 0 THEN 'reasoning' ELSE 'backend' END AS category, user_id, "
        f"CASE event_id % 4 {cases} ELSE {forms[-1]} END AS message FROM {d.table('events')}"
    )


query("verbose_filter", "event_id:b, is_verbose:o", f"""
    SELECT event_id, category <> 'reasoning' AND {X.starts_any('lower(' + X.trimmed('message') + ')', K.VERBOSE_PREFIXES)} AS is_verbose
    FROM ({D.sql(diagnostics)})""")(
    lambda spark, sf: D.frame(spark, sf, diagnostics).select(
        "event_id", P.is_verbose_diagnostic(F.col("category"), F.col("message")).alias("is_verbose")))
