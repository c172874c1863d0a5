"""Names, labels, budgets and other row-wise functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan import constants as K
from quillspan.catalog import derived as D, duck as X
from quillspan.catalog.registry import query, quote as q
from quillspan.functions import budgets as B, labels as LB, text as T

_EXT = "lower(split_part(file_name, '.', -1))"
_TYPE = "CASE " + " ".join(f"WHEN {X.one_of(_EXT, v)} THEN {q(k)}" for k, v in K.SUFFIX_TYPES.items()) + " ELSE 'misc' END"

query("source_type", "doc_id:b, kind:s", f"SELECT doc_id, {_TYPE} AS kind FROM ({D.sql(D.files)})")(
    lambda spark, sf: D.frame(spark, sf, D.files).select("doc_id", LB.source_type(F.col("file_name")).alias("kind")))

ROLE_SQL = f"""CASE WHEN kind = 'log' OR {X.has_any('probe', K.ROLE_LOG_WORDS)} THEN 'log' WHEN kind = 'config' THEN 'config'
    WHEN kind = 'code' THEN 'code' WHEN {X.has_any('probe', K.ROLE_SCENARIO_WORDS)} THEN 'scenario'
    WHEN {X.has_any('probe', K.ROLE_PROCEDURE_WORDS)} THEN 'procedure' WHEN {X.has_any('probe', K.ROLE_REFERENCE_WORDS)} THEN 'reference'
    WHEN kind = 'doc' THEN 'reference' ELSE kind END"""


def _worded(d) -> str:
    """Files whose text starts with a role word in turn."""
    words = ["design", "mop", "guide", "alarm", "none", "workflow"]
    cases = " ".join(f"WHEN {i} THEN '{w} '" for i, w in enumerate(words[:-1]))
    return (
        f"SELECT doc_id, file_name, path, CASE doc_id % 6 {cases} ELSE '{words[-1]} ' END || text AS text FROM ({D.files(d)}) AS f"
    )


query("source_role", "doc_id:b, role:s", f"""
    SELECT doc_id, {ROLE_SQL} AS role FROM (SELECT doc_id, {_TYPE} AS kind,
    lower(file_name || ' ' || path || ' ' || left(text, {K.ROLE_HEAD_CHARS})) AS probe FROM ({_worded(D.Duck())}))""")(
    lambda spark, sf: D.frame(spark, sf, _worded).select("doc_id", LB.source_role(
        F.col("file_name"), F.col("path"), LB.source_type(F.col("file_name")), F.col("text")).alias("role")))

query("conversation_title", "conv_id:b, turn:b, title:s", f"""
    SELECT conv_id, turn, CASE WHEN t = '' THEN 'New conversation' WHEN len(string_split(t, ' ')) > 8
    THEN array_to_string(list_slice(string_split(t, ' '), 1, 8), ' ') || '...' ELSE t END AS title
    FROM (SELECT conv_id, turn, {X.simplified('text')} AS t FROM conversations)""")(
    lambda spark, sf: spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", LB.conversation_title(F.col("text")).alias("title")))

_SAN = X.re_all(X.re_all(X.re_all(X.trimmed("{x}"), "[^A-Za-z0-9._-]+", "_"), "_{2,}", "_"), r"^[_.]+|[_.]+\z", "")


def _sanitize_sql(x: str) -> str:
    inner = _SAN.replace("{x}", x)
    return f"CASE WHEN {inner} = '' THEN 'item' ELSE {inner} END"


query("path_labels", "doc_id:b, safe:s, grp:s, gid:s, lone:s", f"""
    SELECT doc_id, {_sanitize_sql('text')} AS safe, lang || '/' || source AS grp,
    sha1(lang || '|' || lang || '/' || source) AS gid,
    source || '_' || left(sha1('/abs/kb/' || lang || '/' || source), 10) || '/' || file_name AS lone FROM ({D.sql(D.files)})""")(
    lambda spark, sf: D.frame(spark, sf, D.files).select(
        "doc_id", LB.sanitize_label(F.col("text")).alias("safe"),
        LB.group_label(F.col("relative_path")).alias("grp"),
        LB.group_id(F.col("lang"), LB.group_label(F.col("relative_path"))).alias("gid"),
        LB.standalone_path(F.concat(F.lit("/abs/"), F.col("path"))).alias("lone")))

query("path_inside_root", "doc_id:b, inside:o", f"""
    SELECT doc_id, starts_with(path, 'kb/en/src1/') OR path = 'kb/en/src1' AS inside FROM ({D.sql(D.files)})""")(
    lambda spark, sf: D.frame(spark, sf, D.files).select(
        "doc_id", LB.path_inside_root(F.col("path"), F.lit("kb/en/src1")).alias("inside")))

query("split_paths", "doc_id:b, items:s, n:b", f"""
    SELECT doc_id, array_to_string(p, '|') AS items, len(p) AS n FROM (SELECT doc_id,
    list_filter(list_transform(regexp_split_to_array(text, '[;,' || chr(10) || ']'), lambda v: {X.trimmed('v')}), lambda v: v <> '') AS p FROM documents)""")(
    lambda spark, sf: D.frame(spark, sf, D.documents).withColumn("p", LB.split_paths(F.col("text"))).select(
        "doc_id", F.array_join("p", "|").alias("items"), F.size("p").alias("n")))

_SIZE = "n * n * n * 7"
query("format_bytes", "doc_id:b, shown:s", f"""
    SELECT doc_id, CASE WHEN v < 1024 THEN format('{{:.0f}} B', v) WHEN v < 1048576 THEN CASE WHEN v / 1024 >= 10 THEN format('{{:.0f}} KB', v / 1024) ELSE format('{{:.1f}} KB', v / 1024) END
    WHEN v < 1073741824 THEN CASE WHEN v / 1048576 >= 10 THEN format('{{:.0f}} MB', v / 1048576) ELSE format('{{:.1f}} MB', v / 1048576) END
    WHEN v < 1099511627776 THEN CASE WHEN v / 1073741824 >= 10 THEN format('{{:.0f}} GB', v / 1073741824) ELSE format('{{:.1f}} GB', v / 1073741824) END
    ELSE CASE WHEN v / 1099511627776 >= 10 THEN format('{{:.0f}} TB', v / 1099511627776) ELSE format('{{:.1f}} TB', v / 1099511627776) END END AS shown
    FROM (SELECT doc_id, ({_SIZE.replace('n', 'n_chars')})::DOUBLE AS v FROM documents)""")(
    lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", LB.format_bytes(F.col("n_chars") * F.col("n_chars") * F.col("n_chars") * 7).alias("shown")))


def _profile_sql(i: int, names: str = "kind") -> str:
    dense = [(1000, 380, 1300, 90), (1050, 420, 1350, 90), (1200, 520, 1500, 110)]
    wide = [(2100, 780, 2850, 220), (2200, 900, 3000, 220), (2400, 1100, 3200, 360)]
    def pick(t):
        return f"CASE WHEN kind IN ('code', 'config') THEN {t[0][i]} WHEN kind = 'log' THEN {t[1][i]} ELSE {t[2][i]} END"
    large, xlarge = ((120, 80, 180, 20), (300, 140, 500, 60)), ((80, 60, 120, 15), (300, 140, 450, 50))
    return (
        f"CASE WHEN sem THEN {pick(dense)} ELSE {pick(wide)} END + CASE WHEN size >= 1048576 THEN CASE WHEN sem THEN {large[0][i]} ELSE {large[1][i]} END ELSE 0 END"
        f" + CASE WHEN size >= 4194304 OR blocks >= 450 THEN CASE WHEN sem THEN {xlarge[0][i]} ELSE {xlarge[1][i]} END ELSE 0 END"
    )


query("chunking_profile", "doc_id:b, target:b, minimum:b, hard:b, overlap:b, label:s", f"""
    SELECT doc_id, {_profile_sql(0)} AS target, {_profile_sql(1)} AS minimum, {_profile_sql(2)} AS hard, {_profile_sql(3)} AS overlap,
    CASE WHEN kind IN ('code', 'config') THEN 'code' WHEN kind = 'log' THEN 'log' ELSE 'doc' END
    || CASE WHEN NOT sem THEN '-wide-lexical' WHEN kind IN ('doc', 'misc') THEN '-balanced-semantic' ELSE '-compact-semantic' END
    || CASE WHEN size >= 1048576 THEN '-large' ELSE '' END || CASE WHEN size >= 4194304 OR blocks >= 450 THEN '-xlarge' ELSE '' END AS label
    FROM (SELECT doc_id, {_TYPE} AS kind, size_bytes AS size, doc_id % 500 AS blocks, doc_id % 2 = 0 AS sem FROM ({D.sql(D.files)}))""")(
    lambda spark, sf: D.frame(spark, sf, D.files).select("doc_id", B.chunking_profile(
        LB.source_type(F.col("file_name")), F.col("size_bytes"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 500).alias("p"))
    .select("doc_id", F.col("p.target_chars").alias("target"), F.col("p.minimum_chars").alias("minimum"),
            F.col("p.hard_chars").alias("hard"), F.col("p.overlap_chars").alias("overlap"), F.col("p.label").alias("label")))

_LOGS = "(log10(greatest({v}, {floor})::DOUBLE) - log10({low}::DOUBLE)) / (log10({high}::DOUBLE) - log10({low}::DOUBLE))"


def scale_sql(chars: str, chunks: str) -> str:
    a = _LOGS.format(v=chars, floor=1000, low=50000, high=5000000)
    b = _LOGS.format(v=chunks, floor=1, low=150, high=15000)
    return f"greatest(0::DOUBLE, least(1::DOUBLE, greatest({a}, {b})))"


_SIZED = "SELECT doc_id, n_chars * 150 AS chars, n_chars // 5 AS chunks, 10000 + (doc_id % 10) * 5000 AS max_chars FROM documents"


def _sized(spark, sf):
    n = F.col("n_chars")
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", (n * 150).alias("chars"), F.floor(n / 5).alias("chunks"), (10000 + (F.col("doc_id") % 10) * 5000).alias("max_chars"))


query("doc_scale", "doc_id:b, scale:d", f"SELECT doc_id, {scale_sql('chars', 'chunks')} AS scale FROM ({_SIZED})")(
    lambda spark, sf: _sized(spark, sf).select("doc_id", B.doc_scale(F.col("chars"), F.col("chunks")).alias("scale")))

query("packet_profile", "doc_id:b, lines:b, budget:b, preview:b, coverage:b, lo:b, hi:b, anchors:b, full_text:o, inline:b", f"""
    WITH s AS (SELECT *, {scale_sql('chars', 'chunks')} AS scale, chars >= 180000 OR chunks >= 500 AS medium,
        chars >= 500000 OR chunks >= 1800 AS large, chars >= 1500000 OR chunks >= 6000 AS huge,
        chars >= 5000000 OR chunks >= 20000 AS massive, greatest(12000, max_chars) AS budget FROM ({_SIZED})),
    p AS (SELECT *, CASE WHEN NOT medium THEN least(9000, greatest(2200, budget // 5)) WHEN NOT huge THEN least(6000, greatest(2000, budget // 9))
        WHEN NOT massive THEN least(1600, budget // 36) ELSE 0 END AS p0,
        greatest(72, least(160, 80 + {X.half_up('scale * 56')})) AS a0 FROM s)
    --final
    SELECT doc_id, greatest(120, least(360, 180 + {X.half_up('scale * 80')})) AS lines, budget,
    least(budget, greatest(p0, CASE WHEN large THEN budget // 5 ELSE budget // 3 END)) AS preview,
    greatest(2800, budget - p0 - 900) AS coverage,
    CASE WHEN NOT medium THEN 800 WHEN NOT large THEN 700 WHEN massive THEN 220 WHEN huge THEN 280 ELSE 300 END AS lo,
    CASE WHEN NOT medium THEN 4000 WHEN NOT large THEN 3200 WHEN massive THEN 900 WHEN huge THEN 1500 ELSE 3000 END AS hi,
    CASE WHEN massive THEN 160 WHEN huge THEN greatest(a0, 128) WHEN large THEN greatest(a0, 96) ELSE a0 END AS anchors,
    NOT large AS full_text, least(budget, 56000) AS inline FROM p""")(
    lambda spark, sf: _sized(spark, sf).select("doc_id", B.packet_profile(
        F.col("chars"), F.col("chunks"), F.lit(180), F.col("max_chars")).alias("p")).select(
        "doc_id", F.col("p.outline_line_limit").alias("lines"), F.col("p.max_chars").alias("budget"),
        F.col("p.preview_budget").alias("preview"), F.col("p.coverage_budget").alias("coverage"),
        F.col("p.min_section_chars").alias("lo"), F.col("p.max_section_chars").alias("hi"),
        F.col("p.anchor_cap").alias("anchors"), F.col("p.include_full_preview").alias("full_text"),
        F.col("p.inline_threshold").alias("inline")))


def tokens_sql(ctx: str, study: str, profile: str) -> str:
    c = f"greatest(4096, {ctx})"
    room = f"greatest(2200, {c} - {X.bound(4096, f'{c} // 4', 8192)} - {X.bound(1800, f'{c} // 10', 3200)} - {X.bound(600, f'{c} // 24', 1200)})"
    ratio = f"CASE {profile} WHEN 'cpu' THEN 0.43::DOUBLE WHEN 'gpu' THEN 0.62::DOUBLE ELSE 0.5::DOUBLE END"
    a = X.bound(2200, X.half_up(f"{room} * ({ratio})"), f"greatest(2200, {c} * 2 // 3)")
    room2 = f"greatest(900, {c} - {X.bound(1024, f'{c} // 10', 2048)} - {X.bound(1000, f'{c} // 14', 1800)} - {X.bound(300, f'{c} // 30', 700)})"
    ratio2 = f"CASE {profile} WHEN 'cpu' THEN 0.22::DOUBLE WHEN 'gpu' THEN 0.32::DOUBLE ELSE 0.26::DOUBLE END"
    b = X.bound(900, X.half_up(f"{room2} * ({ratio2})"), f"greatest(900, {c} // 3)")
    return f"CASE WHEN {study} THEN {a} ELSE {b} END"


def chars_sql(ctx: str, study: str, profile: str) -> str:
    return X.half_up(f"({tokens_sql(ctx, study, profile)}) * {K.CHARS_PER_TOKEN}::DOUBLE")


_CTX = "SELECT doc_id, 2048 + n_chars * 3 AS ctx, doc_id % 2 = 0 AS study, CASE doc_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'cpu' ELSE 'gpu' END AS prof, n_chars FROM documents"


def _ctx(spark, sf):
    i = F.col("doc_id")
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        i, (2048 + F.col("n_chars") * 3).alias("ctx"), (i % 2 == 0).alias("study"),
        F.when(i % 3 == 0, "auto").when(i % 3 == 1, "cpu").otherwise("gpu").alias("prof"), "n_chars")


query("context_budget", "doc_id:b, tokens:b, chars:b",
      f"SELECT doc_id, {tokens_sql('ctx', 'study', 'prof')} AS tokens, {chars_sql('ctx', 'study', 'prof')} AS chars FROM ({_CTX})")(
    lambda spark, sf: _ctx(spark, sf).select(
        "doc_id", B.context_tokens(F.col("ctx"), F.col("study"), F.col("prof")).alias("tokens"),
        B.context_chars(F.col("ctx"), F.col("study"), F.col("prof")).alias("chars")))

query("request_window", "doc_id:b, window_tokens:b, fallback:b", f"""
    SELECT doc_id, greatest(8192, least(ctx, (8192 * pow(2, greatest(0, ceil(log2(need / 8192.0)))))::BIGINT)) AS window_tokens,
    CASE WHEN f >= base THEN least(greatest(12288, base - 4096), base) ELSE least(f, base) END AS fallback
    FROM (SELECT doc_id, ctx, least(greatest(1024, n_chars * 20 // 4) + 3000, ctx) AS need, greatest(8192, ctx) AS base,
    greatest(12288, least(24576, greatest(8192, ctx) * 3 // 4)) AS f FROM ({_CTX}))""")(
    lambda spark, sf: _ctx(spark, sf).select(
        "doc_id", B.request_window(F.col("n_chars") * 20, F.col("ctx")).alias("window_tokens"),
        B.fallback_window(F.col("ctx")).alias("fallback")))

_ZERO_CASES = ["canceled", "binary-skipped", "read-failed", "pdf:load-failed", "pdf:text", "docx:load-failed", "docx:text", "direct"]


def _zero(d) -> str:
    cases = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_ZERO_CASES[:-1]))
    return (
        f"SELECT doc_id, CASE doc_id % 8 {cases} ELSE 'direct' END AS extractor, doc_id % 8 IN (4, 6, 7) AS ok, (doc_id % 5) * 10 AS chars, "
        f"doc_id % 3 AS words, doc_id % 4 AS blocks, doc_id % 6 AS candidates, doc_id % 7 AS filtered, doc_id % 2 AS duplicates "
        f"FROM {d.table('documents')}"
    )


_FALLBACK = """CASE WHEN extractor = 'canceled' THEN 'canceled' WHEN extractor = 'binary-skipped' THEN 'binary-or-unsupported'
    WHEN extractor = 'read-failed' THEN 'unreadable' WHEN extractor = 'pdf:load-failed' THEN 'pdf-extraction-failed'
    WHEN starts_with(extractor, 'pdf:') AND chars <= 0 THEN 'pdf-no-text' WHEN extractor = 'docx:load-failed' THEN 'docx-extraction-failed'
    WHEN starts_with(extractor, 'docx:') AND chars <= 0 THEN 'docx-no-text' WHEN chars <= 0 OR words <= 0 THEN 'no-usable-text'
    ELSE 'nothing-survived' END"""
query("zero_chunk_reason", "doc_id:b, reason:s", f"""
    SELECT doc_id, CASE WHEN NOT ok OR chars <= 0 THEN {_FALLBACK} WHEN blocks <= 0 THEN 'no-blocks' WHEN candidates <= 0 THEN 'no-candidates'
    WHEN filtered + duplicates >= candidates AND filtered > 0 AND duplicates > 0 THEN 'all-filtered-or-duplicate'
    WHEN filtered + duplicates >= candidates AND filtered > 0 THEN 'all-filtered'
    WHEN filtered + duplicates >= candidates AND duplicates > 0 THEN 'all-duplicate' ELSE {_FALLBACK} END AS reason FROM ({_zero(D.Duck())})""")(
    lambda spark, sf: D.frame(spark, sf, _zero).select("doc_id", LB.zero_chunk_reason(
        *[F.col(c) for c in ("ok", "extractor", "chars", "words", "blocks", "candidates", "filtered", "duplicates")]).alias("reason")))
