"""Stream guards: batch twins over stored messages, and the streams themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspan import constants as K
from quillspan.catalog import derived as D, duck as X
from quillspan.catalog.ingest_queries import single_chunk_sql
from quillspan.catalog.memory_queries import _EXTRACT as EXTRACT_SQL
from quillspan.catalog.policy_queries import diagnostics
from quillspan.catalog.registry import query
from quillspan.functions import text as T
from quillspan.session import scratch_path
from quillspan.streaming import batch as BT

KEY = ["conv_id", "turn"]
LOOPED, TAGGED = D.sql(D.looped), D.sql(D.tagged)

_LOOP = f"""
    WITH l AS ({D.Duck().unnest(f'({LOOPED}) AS m', "string_split(text, chr(10))", 'conv_id, turn, len(string_split(text, chr(10))) AS n')}),
    u AS (SELECT conv_id, turn, pos, {X.loop_line(X.trimmed('item'))} AS norm FROM l WHERE pos < n - 1),
    v AS (SELECT *, CASE WHEN lag(norm) OVER (PARTITION BY conv_id, turn ORDER BY pos) = norm THEN 0 ELSE 1 END AS fresh FROM u WHERE length(norm) >= 6),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM v),
    s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, run ORDER BY pos) AS streak FROM r),
    hit AS (SELECT conv_id, turn, min(pos) AS pos, arg_min(norm, pos) AS norm FROM s WHERE streak >= 5 GROUP BY conv_id, turn)
    --final
"""
query("loop_lines", "conv_id:b, turn:b, pos:b, norm:s, streak:b", _LOOP + "SELECT conv_id, turn, pos, norm, streak FROM s")(
    lambda spark, sf: BT.loop_lines(D.frame(spark, sf, D.looped), KEY))

query("repetition_verdicts", "conv_id:b, turn:b, pos:b, norm:s", _LOOP + "SELECT * FROM hit")(
    lambda spark, sf: BT.repetition_verdicts(D.frame(spark, sf, D.looped), KEY))

query("truncate_repeats", "conv_id:b, turn:b, text:s, removed:b", _LOOP.replace("--final", f""",
    t AS (SELECT l.conv_id, l.turn, l.pos, item, hit.norm = {X.loop_line(X.trimmed('item'))} AS same FROM l JOIN hit ON l.conv_id = hit.conv_id AND l.turn = hit.turn AND l.pos <= hit.pos),
    w AS (SELECT *, pos > 0 AND bool_and(same) OVER (PARTITION BY conv_id, turn ORDER BY pos DESC) AS gone FROM t)
    --final""") + """
    SELECT conv_id, turn, string_agg(item, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text, count(*) FILTER (WHERE gone) AS removed FROM w GROUP BY conv_id, turn""")(
    lambda spark, sf: BT.truncate_repeats(D.frame(spark, sf, D.looped), KEY))


def notes(d) -> str:
    """Messages as hidden notes of their conversation; in two of three conversations each comes four times, in one of them
    with a longer form in between."""
    return (
        f"SELECT conv_id, turn * 10 + n AS pos, CASE WHEN conv_id % 3 = 1 AND n % 2 = 1 THEN text || repeat(' x', 100) ELSE text END AS text, "
        f"(turn * 10 + n) * 4000 AS elapsed FROM {d.table('conversations')} AS c, (VALUES (0), (1), (2), (3)) AS o(n) WHERE n = 0 OR conv_id % 3 < 2"
    )


_STALL = f"""WITH n AS (SELECT conv_id, pos, {X.trimmed('text')} AS note, elapsed FROM ({notes(D.Duck())})),
    a AS (SELECT *, {X.loop_line('note')} AS norm, sum(length(note)) OVER (PARTITION BY conv_id ORDER BY pos) AS chars FROM n WHERE note <> ''),
    b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, norm ORDER BY pos) AS freq, CASE WHEN lag(norm) OVER (PARTITION BY conv_id ORDER BY pos) = norm THEN 0 ELSE 1 END AS fresh FROM a),
    c AS (SELECT *, max(freq) OVER (PARTITION BY conv_id ORDER BY pos) AS dominant, sum(fresh) OVER (PARTITION BY conv_id ORDER BY pos) AS run,
        list(norm) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS recent FROM b),
    d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY pos) AS streak, len(recent) AS recent_n, len(list_distinct(recent)) AS recent_unique FROM c)"""
_STALL_VERDICT = """CASE WHEN (streak >= 3 AND chars >= 500) OR (dominant >= 4 AND chars >= 900) OR (recent_n >= 6 AND recent_unique <= 2 AND chars >= 900) THEN 'repetition' WHEN elapsed >= 180000 AND chars >= 4000 THEN 'stall' ELSE 'none' END"""

query("stall_verdicts", "conv_id:b, pos:b, chars:b, streak:b, dominant:b, recent_n:b, recent_unique:b, verdict:s", f"""
    {_STALL}
    --final
    SELECT conv_id, pos, chars, streak, dominant, recent_n, recent_unique, {_STALL_VERDICT} AS verdict FROM d""")(
    lambda spark, sf: BT.stall_verdicts(D.frame(spark, sf, notes), ["conv_id"], elapsed="elapsed"))

_SPANS = "|".join(f"{a}(?s:.*?)(?:{b}|\\z)" for a, b in K.HIDDEN_TAGS)


def _untag(x: str) -> str:
    return X.drop_tags(x)


def _deltas(spark, sf_dir) -> DataFrame:
    """Tagged messages cut into pieces of eleven characters, so tags span pieces."""
    m = D.frame(spark, sf_dir, D.tagged)
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 11))
    return m.select(*KEY, F.explode(starts).alias("seq"), "text", F.floor((F.length("text") - 1) / 11).alias("final")).select(
        *KEY, "seq", F.substring(F.col("text"), (F.col("seq") * 11 + 1).cast("int"), F.lit(11)).alias("delta"),
        (F.col("seq") == F.col("final")).alias("done"))


_SPLIT = f"""
    SELECT conv_id, turn, {_untag(X.re_all('text', _SPANS, ''))} AS visible,
    array_to_string(list_filter(list_transform(regexp_extract_all(text, {X.q(_SPANS)}), lambda n: {X.trimmed(_untag('n'))}), lambda n: n <> ''), chr(10)) AS hidden FROM ({TAGGED})"""
query("split_tagged", "conv_id:b, turn:b, visible:s, hidden:s", _SPLIT)(
    lambda spark, sf: BT.split_tagged(_deltas(spark, sf), KEY, "seq"))

query("phase_gaps", "user_id:b, event_id:b, gap_ms:b", """
    SELECT user_id, event_id, gap_ms FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) // 1000 AS gap_ms FROM events) WHERE gap_ms > 300000""")(
    lambda spark, sf: BT.phase_gaps(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], K.PHASE_TIMEOUT_MS["inactivity"]))

query("throughput_ema", "backend:s, ema:d, samples:b", f"""
    SELECT backend, list_reduce(list(x ORDER BY ts), lambda acc, x: {K.EMA_WEIGHT}::DOUBLE * x + {1 - K.EMA_WEIGHT}::DOUBLE * acc) AS ema, count(*) AS samples
    FROM (SELECT event_type AS backend, ts, value::DOUBLE AS x FROM events WHERE value > 0) GROUP BY backend""")(
    lambda spark, sf: BT.throughput_ema(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("backend"), "ts", F.col("value").alias("rate"))))

query("eta_ms", "conv_id:b, turn:b, eta:b", """
    SELECT conv_id, turn, least(120000, floor(length(text) * 40 / 3.2::DOUBLE / r * 1000)) AS eta FROM (SELECT *, (turn + 1) * 3 / ((conv_id % 7 + 1) * 1000000 / 1e9) / 200 AS r FROM conversations)""")(
    lambda spark, sf: spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", BT.eta_ms(F.length("text") * 40, BT.eval_rate((F.col("turn") + 1) * 3, (F.col("conv_id") % 7 + 1) * 1000000) / 200).alias("eta")))


def rounds(d) -> str:
    """Messages as answer rounds of their conversation; most end for length, one in five is blank."""
    return (
        f"SELECT conv_id, turn AS round_no, CASE WHEN (conv_id + turn) % 5 = 4 THEN ' ' ELSE text END AS text, CASE WHEN (conv_id * 3 + turn) % 4 = 3 THEN 'stop' ELSE 'Length' END AS done_reason "
        f"FROM {d.table('conversations')}"
    )


query("stitch_rounds", "conv_id:b, answer:s, rounds:b, tail:s", f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round_no) AS n, lower(done_reason) = 'length' AND {X.trimmed('text')} <> '' AS go FROM ({rounds(D.Duck())})),
    s AS (SELECT *, coalesce(bool_and(go) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS live FROM r WHERE n <= 7)
    --final
    SELECT conv_id, answer, rounds, right(answer, 3000) AS tail FROM (SELECT conv_id, string_agg(text, '' ORDER BY n) AS answer, count(*) AS rounds FROM s WHERE live GROUP BY conv_id)""")(
    lambda spark, sf: BT.stitch_rounds(D.frame(spark, sf, rounds), ["conv_id"]))

query("diagnostic_ring", "category:s, event_id:b", f"""
    SELECT category, event_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ts DESC, event_id DESC) AS n FROM ({D.sql(diagnostics)})) WHERE n <= 400""")(
    lambda spark, sf: BT.diagnostic_ring(D.frame(spark, sf, diagnostics), ["category"], [F.desc("ts"), F.desc("event_id")]))


def _streamed(spark, sf_dir: str, source, job, name: str) -> DataFrame:
    """Run ``job`` over a file stream of the derived rows and read its Parquet result.

    Rows are dealt out by a hash of all their columns, so the rows of a key lie in all files and micro-batches, out of order.
    """
    from quillspan.streaming import jobs

    rows, out = scratch_path(spark, f"{name}-in"), scratch_path(spark, f"{name}-out")
    frame = source(spark, sf_dir)
    frame.repartition(6, F.xxhash64(*frame.columns)).write.parquet(rows)
    jobs.use_rocksdb(spark)
    result = job(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(rows))
    jobs.run_available(result, out, scratch_path(spark, f"{name}-checkpoint"))
    return spark.read.schema(result.schema).parquet(out)


def _sessions(key: list[str] = KEY):
    return F.concat_ws("-", *[F.col(k).cast("string") for k in key]).alias("session_id")


def _loop_deltas(spark, sf_dir):
    return D.frame(spark, sf_dir, D.looped).select(_sessions(), F.posexplode(F.split("text", "(?<=\n)")).alias("seq", "delta")).withColumn(
        "seq", F.col("seq").cast("long"))


query("repetition_guard_stream", "session_id:s, norm:s", _LOOP + "SELECT conv_id || '-' || turn AS session_id, norm FROM hit")(
    lambda spark, sf: _streamed(spark, sf, _loop_deltas, _jobs().repetition_guard, "repetition"))


def _jobs():
    from quillspan.streaming import jobs

    return jobs


query("split_tagged_stream", "session_id:s, visible:s, hidden:s", f"""
    SELECT conv_id || '-' || turn AS session_id, visible, hidden FROM ({_SPLIT})""")(
    lambda spark, sf: _joined_pieces(_streamed(
        spark, sf, lambda s, d: _deltas(s, d).select(_sessions(), F.col("seq").cast("long").alias("seq"), "delta", "done"),
        _jobs().split_tagged_output, "tags")))


def _joined_pieces(pieces: DataFrame) -> DataFrame:
    def text(kind: str, sep: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "text")))), lambda r: r["text"]), sep)

    return pieces.groupBy("session_id").agg(text("visible", "").alias("visible"), text("hidden", "\n").alias("hidden"))


def _numbered(key: str, *order: str):
    """Place of a row in its key, from 0."""
    from pyspark.sql import Window

    return (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long").alias("seq")


query("stall_guard_stream", "session_id:s, seq:b, verdict:s", f"""
    {_STALL}, o AS (SELECT conv_id, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS seq FROM ({notes(D.Duck())}))
    --final
    SELECT CAST(d.conv_id AS VARCHAR) AS session_id, seq, {_STALL_VERDICT} AS verdict FROM d JOIN o ON d.conv_id = o.conv_id AND d.pos = o.pos""")(
    lambda spark, sf: _streamed(spark, sf, lambda s, d: D.frame(s, d, notes).select(
        F.col("conv_id").cast("string").alias("session_id"), _numbered("conv_id", "pos"), F.col("text").alias("note"),
        F.col("elapsed").cast("long").alias("elapsed_ms")), _jobs().stall_guard, "stall"))

_THOUGHTS = f"""
    WITH RECURSIVE p AS (SELECT conv_id || '-' || turn AS session_id, n AS seq, substr(text, n * 11 + 1, 11) AS delta, n = last AS done
        FROM (SELECT conv_id, turn, text, (length(text) - 1) // 11 AS last, unnest(range(0, (length(text) - 1) // 11 + 1)) AS n FROM conversations)),
    r AS (SELECT session_id, -1::BIGINT AS seq, '' AS kept, '' AS text FROM p WHERE seq = 0 UNION ALL
        SELECT session_id, seq, CASE WHEN full_ THEN '' ELSE t END AS kept, CASE WHEN full_ THEN t ELSE '' END AS text FROM (
        SELECT p.session_id, p.seq, r.kept || delta AS t, done OR length(r.kept || delta) >= 140 OR contains(r.kept || delta, chr(10))
            OR right(delta, 1) IN ('.', ':') AS full_ FROM r JOIN p ON p.session_id = r.session_id AND p.seq = r.seq + 1))
    --final
    SELECT session_id, seq, text FROM r WHERE text <> ''"""


def _thoughts(spark, sf_dir: str) -> DataFrame:
    """Messages as hidden text in pieces of eleven characters, apart from an empty answer."""
    last = F.floor((F.length("text") - 1) / 11)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where(F.length("text") > 0)
    return rows.select(_sessions(), F.explode(F.sequence(F.lit(0), last)).alias("seq"), "text", last.alias("last")).select(
        "session_id", F.col("seq").cast("long").alias("seq"), F.lit("").alias("delta"), (F.col("seq") == F.col("last")).alias("done"),
        F.substring("text", (F.col("seq") * 11 + 1).cast("int"), F.lit(11)).alias("thought"))


query("coalesce_thoughts_stream", "session_id:s, seq:b, text:s", _THOUGHTS)(
    lambda spark, sf: _streamed(spark, sf, _thoughts, _jobs().split_tagged_output, "thoughts"))

query("throughput_ema_stream", "backend:s, ema:d", f"""
    SELECT backend, list_reduce(list(x ORDER BY ts, event_id), lambda acc, x: {K.EMA_WEIGHT}::DOUBLE * x + {1 - K.EMA_WEIGHT}::DOUBLE * acc) AS ema
    FROM (SELECT event_type || '-' || user_id AS backend, ts, event_id, value::DOUBLE AS x FROM events WHERE value > 0) GROUP BY backend""")(
    lambda spark, sf: _streamed(spark, sf, lambda s, d: s.read.parquet(f"{d}/events.parquet").withColumn(
        "backend", F.concat_ws("-", "event_type", F.col("user_id").cast("string"))).select(
        "backend", _numbered("backend", "ts", "event_id"), F.col("value").cast("double").alias("rate")), _jobs().throughput_ema, "ema")
    .groupBy("backend").agg(F.max_by("ema", "seq").alias("ema")))

_BREAKER = f"""
    WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, (epoch_us(ts) // 1000) AS at,
        event_type <> 'error' AS ok, event_id % 10 = 0 AS permanent FROM events),
    r AS (SELECT user_id, -1::BIGINT AS seq, true AS allowed, 0::BIGINT AS failures, 0::BIGINT AS paused FROM e WHERE seq = 0 UNION ALL
        SELECT e.user_id, e.seq, r.paused <= e.at, CASE WHEN r.paused > e.at THEN r.failures WHEN ok THEN 0 ELSE r.failures + 1 END,
        CASE WHEN r.paused > e.at THEN r.paused WHEN ok THEN 0 WHEN permanent OR r.failures + 1 >= {K.FAILURES_BEFORE_PAUSE} THEN e.at + {K.FAILURE_PAUSE_MS} ELSE r.paused END
        FROM r JOIN e ON e.user_id = r.user_id AND e.seq = r.seq + 1)
    --final
    SELECT user_id AS backend, seq, allowed, failures FROM r WHERE seq >= 0"""

query("failure_breaker_stream", "backend:s, seq:b, allowed:o, failures:b", _BREAKER)(
    lambda spark, sf: _streamed(spark, sf, lambda s, d: s.read.parquet(f"{d}/events.parquet").select(
        F.col("user_id").cast("string").alias("backend"), _numbered("user_id", "ts", "event_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_id") % 10 == 0, "model not found").otherwise("timeout").alias("message")), _jobs().failure_breaker, "breaker"))

_HOUR = 3_600_000
LIMITS = {"headers": 6 * _HOUR, "first_token": 8 * _HOUR, "inactivity": 12 * _HOUR, "total": 24 * _HOUR}
_TIMEOUTS = f"""
    WITH a AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t_ms, event_type, max((epoch_us(ts) // 1000)) OVER () - 2 * {_HOUR} AS seen FROM events),
    b AS (SELECT *, sum((event_type = 'signup')::INT) OVER w AS run, lead(t_ms) OVER w AS next_at FROM a WHERE t_ms <= seen WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, event_id)),
    c AS (SELECT *, CASE event_type WHEN 'signup' THEN 'headers' WHEN 'view' THEN 'first_token' ELSE 'inactivity' END AS phase FROM b WHERE run > 0),
    d AS (SELECT *, t_ms + CASE phase {' '.join(f"WHEN '{p}' THEN {ms}" for p, ms in LIMITS.items())} END AS due FROM c),
    e AS (SELECT user_id, run, min(t_ms) AS started, any_value(seen) AS seen, min(t_ms) FILTER (WHERE event_type = 'purchase') AS done,
        min(due) FILTER (WHERE event_type <> 'purchase' AND due < least(coalesce(next_at, seen), seen)) AS silent,
        arg_min(phase, due) FILTER (WHERE event_type <> 'purchase' AND due < least(coalesce(next_at, seen), seen)) AS phase FROM d GROUP BY user_id, run),
    f AS (SELECT *, lead(started) OVER (PARTITION BY user_id ORDER BY run) AS restarted, started + {LIMITS['total']} AS late FROM e),
    g AS (SELECT user_id, started, restarted, unnest([{{'t_ms': done, 'n': 0, 'what': 'done'}}, {{'t_ms': silent, 'n': 1, 'what': 'timeout:' || phase}},
        {{'t_ms': CASE WHEN late < seen THEN late END, 'n': 2, 'what': 'timeout:total'}}]) AS x FROM f)
    --final
    SELECT user_id AS session_id, started, arg_min(x.t_ms, [x.t_ms, x.n]) AS ended, arg_min(x.what, [x.t_ms, x.n]) AS outcome FROM g
    WHERE x.t_ms IS NOT NULL AND (restarted IS NULL OR x.t_ms < restarted) GROUP BY user_id, started"""


def _timeouts(spark, sf_dir: str) -> DataFrame:
    """Events of users as requests, in three parts by time but for half an hour's disorder across their borders."""
    from quillspan.streaming import jobs

    rows, out = scratch_path(spark, "timeouts-in"), scratch_path(spark, "timeouts-out")
    ts = F.col("ts").cast("timestamp")
    event = F.create_map(*(F.lit(x) for pair in (("signup", "start"), ("view", "headers"), ("purchase", "done")) for x in pair))[F.col("event_type")]
    frame = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("session_id"), ts.alias("ts"), F.coalesce(event, F.lit("token")).alias("event"),
        F.floor((F.dayofmonth(ts + F.expr("make_dt_interval(0, 0, event_id % 30)")) - 1) / 11).alias("file"))
    jobs.use_rocksdb(spark)
    checkpoint, result = scratch_path(spark, "timeouts-checkpoint"), None
    for number in range(3):  # a run for each part goes on where the run before it stopped
        frame.where(F.col("file") == number).drop("file").write.mode("append").parquet(rows)
        stream = spark.readStream.schema(frame.drop("file").schema).parquet(rows)
        result = jobs.phase_timeouts(stream.withWatermark("ts", "2 hours"), LIMITS)
        jobs.run_available(result, out, checkpoint)
    return spark.read.schema(result.schema).parquet(out)


query("phase_timeouts_stream", "session_id:b, started:b, ended:b, outcome:s", _TIMEOUTS)(_timeouts)


def _auto_memories(spark, sf_dir: str) -> DataFrame:
    from quillspan.streaming import jobs

    rows, out = scratch_path(spark, "memory-in"), scratch_path(spark, "memory-out")
    D.frame(spark, sf_dir, D.prompts).select("conv_id", "turn", "role", F.col("prompt").alias("text")).write.parquet(rows)
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(rows)
    jobs.auto_memory(stream, out, scratch_path(spark, "memory-checkpoint"), "2025")
    # the table versions are numbered from zero by batch; the last one holds all memories
    files = spark.read.option("recursiveFileLookup", "true").parquet(out).select(F.input_file_name().alias("file")).distinct()
    last = files.agg(F.max(F.regexp_extract("file", r"/v([0-9]+)/", 1).cast("int"))).first()[0]
    return spark.read.parquet(f"{out}/v{last or 0}")


query("auto_memory_stream", "key:s, category:s, value:s", EXTRACT_SQL + """
    SELECT key, category, arg_max(value, f.conv_id * 1000 + f.turn) AS value FROM found f JOIN conversations c ON f.conv_id = c.conv_id AND f.turn = c.turn
    WHERE role = 'user' GROUP BY key, category""")(_auto_memories)


def spoken_lines(d) -> str:
    """Lines of messages as files: a line of the same place in a later turn replaces that of an earlier one; the last turn of
    every seventh conversation removes its files."""
    lines = d.unnest(f"{d.table('conversations')}", d.split("text", "chr(10)"), "conv_id, turn")
    return (
        f"SELECT conv_id, turn, 'chat/' || {d.text('conv_id')} || '/' || {d.text('pos')} || '.txt' AS path, {d.text('pos')} || '.txt' AS file_name, "
        f"turn * 1000 AS modified_ms, CASE WHEN conv_id % 7 = 0 AND turn = max(turn) OVER (PARTITION BY conv_id) THEN NULL ELSE item END AS text "
        f"FROM ({lines}) AS l"
    )


def _ingest(spark, sf_dir: str) -> DataFrame:
    """All turns as a file stream in several micro-batches, in no order; the live chunks at its end."""
    from quillspan.plans.store import ChunkStore, replacing_ingest

    rows = scratch_path(spark, "ingest-in")
    frame = D.frame(spark, sf_dir, spoken_lines).select(
        "path", "file_name", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size_bytes"),
        F.col("modified_ms").cast("long").alias("modified_ms"), F.lit("direct").alias("extractor"), T.clean_text(F.col("text")).alias("text"))
    frame.repartition(3, F.xxhash64("path", "modified_ms")).write.parquet(rows)
    store = ChunkStore.create(spark, scratch_path(spark, "ingest-store"), 8)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(rows)
    replacing_ingest(stream, store, scratch_path(spark, "ingest-checkpoint"))
    return store.chunks()


query("incremental_ingest", "path:s, chunk_index:b, modified_ms:b, fingerprint:s, text:s", f"""
    WITH s AS ({spoken_lines(D.Duck())}),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY modified_ms DESC) AS age FROM s) WHERE age = 1),
    {single_chunk_sql('SELECT * FROM n')}
    --final
    SELECT path, 0 AS chunk_index, modified_ms, fp AS fingerprint, body AS text FROM ck""")(_ingest)
