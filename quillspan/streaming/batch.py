"""Batch twins of the stream guards, as windows over stored messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspan import constants as K
from quillspan.functions import text as T


def loop_lines(messages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, pos, line, norm, streak): usable lines with the length of the run of equal lines ending there.

    The text after the last newline is not a complete line yet and is left out.
    """
    parts = F.split(F.col(text), "\n")
    lines = (
        messages.select(*key, F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("pos", "line"))
        .withColumn("norm", T.normalize_loop_line(T.trimmed(F.col("line"))))
        .filter(F.length("norm") >= K.LOOP_MIN_CHARS)
    )
    return _streaks(lines, key, "norm")


def _streaks(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy("pos")
    fresh = F.coalesce(F.lag(value).over(order) != F.col(value), F.lit(True)).cast("int")
    rows = rows.withColumn("_run", fresh).withColumn(
        "_run", F.sum("_run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("streak", F.row_number().over(Window.partitionBy(*key, "_run").orderBy("pos"))).drop("_run")


def repetition_verdicts(messages: DataFrame, key: list[str], text: str = "text",
                        streak: int = K.LOOP_STREAK) -> DataFrame:
    """(key, pos, norm): the first line that completes a run of ``streak`` equal lines, if any."""
    hits = loop_lines(messages, key, text).filter(F.col("streak") >= streak)
    return hits.groupBy(*key).agg(F.min(F.struct("pos", "norm")).alias("h")).select(*key, "h.pos", "h.norm")


def truncate_repeats(messages: DataFrame, key: list[str], text: str = "text",
                     streak: int = K.LOOP_STREAK) -> DataFrame:
    """(key, text, removed): messages that triggered, cut at the trigger and without the trailing repeats.

    Trailing lines equal to the line of the run go; the first line of a text always stays.
    """
    verdicts = repetition_verdicts(messages, key, text, streak)
    up = Window.partitionBy(*key).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    lines = messages.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("line_pos", "line")).join(
        verdicts.withColumnRenamed("pos", "hit_pos"), key)
    lines = lines.filter(F.col("line_pos") <= F.col("hit_pos")).withColumnRenamed("line_pos", "pos")
    same = T.normalize_loop_line(T.trimmed(F.col("line"))) == F.col("norm")
    lines = lines.withColumn("tail", F.min(same.cast("int")).over(up) == 1)
    drop = F.col("tail") & (F.col("pos") > 0)
    return lines.groupBy(*key).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(~drop, F.struct("pos", "line")))), lambda r: r["line"]), "\n").alias("text"),
        F.count_if(drop).alias("removed"))


def stall_verdicts(notes: DataFrame, key: list[str], order_by: str = "pos", text: str = "text",
                   elapsed: str | None = None) -> DataFrame:
    """Per note: characters so far, repeat streak, dominant repeat count, distinct among the last eight, verdict.

    notes: key, order, text[, elapsed ms].  Blank notes are skipped.
    """
    order = Window.partitionBy(*key).orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        notes.select(*key, F.col(order_by).alias("pos"), T.trimmed(F.col(text)).alias("note"),
                     (F.col(elapsed) if elapsed else F.lit(0)).cast("long").alias("elapsed_ms"))
        .filter("note != ''").withColumn("norm", T.normalize_loop_line(F.col("note")))
        .withColumn("chars", F.sum(F.length("note")).over(so_far))
    )
    seen = rows.filter("norm != ''")
    same = Window.partitionBy(*key, "norm").orderBy("pos")
    seen = _streaks(seen.withColumn("freq", F.row_number().over(same)), key, "norm")
    seen = (
        seen.withColumn("dominant", F.max("freq").over(so_far))
        .withColumn("recent", F.collect_list("norm").over(order.rowsBetween(-7, 0)))
        .withColumn("recent_n", F.size("recent")).withColumn("recent_unique", F.size(F.array_distinct("recent")))
    )
    last = {"streak": "int", "dominant": "int", "recent_n": "int", "recent_unique": "int"}
    out = rows.join(seen.select(*key, "pos", *last), [*key, "pos"], "left")
    for name, kind in last.items():
        out = out.withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(so_far), F.lit(0)).cast(kind))
    looped = (
        ((F.col("streak") >= 3) & (F.col("chars") >= 500)) | ((F.col("dominant") >= 4) & (F.col("chars") >= 900))
        | ((F.col("recent_n") >= 6) & (F.col("recent_unique") <= 2) & (F.col("chars") >= 900))
    )
    slow = (F.col("elapsed_ms") >= 180000) & (F.col("chars") >= 4000)
    return out.withColumn("verdict", F.when(looped, "repetition").when(slow, "stall").otherwise("none")).select(
        *key, "pos", "chars", "streak", "dominant", "recent_n", "recent_unique", "verdict")


def split_tagged(rows: DataFrame, key: list[str], order: str, delta: str = "delta") -> DataFrame:
    """(key, visible, hidden): joined deltas split by the hidden tag pairs.

    An unclosed tag hides the rest.  Deltas are joined first, so tags may span them.
    """
    whole = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(delta).alias("d")))), lambda r: r["d"]), "")
    spans = "|".join(f"{a}(?s:.*?)(?:{b}|\\z)" for a, b in K.HIDDEN_TAGS)
    notes = F.filter(F.transform(
        F.regexp_extract_all("whole", F.lit(f"({spans})"), 1),
        lambda n: T.trimmed(_strip_tags(n))), lambda n: n != "")
    return rows.groupBy(*key).agg(whole.alias("whole")).select(
        *key, _strip_tags(F.regexp_replace("whole", spans, "")).alias("visible"),
        F.array_join(notes, "\n").alias("hidden"))


def _strip_tags(c: Column) -> Column:
    for literal in [*T.hidden_tag_literals(), K.END_TAG]:
        c = F.replace(c, F.lit(literal), F.lit(""))
    return c


def phase_gaps(events: DataFrame, key: list[str], limit_ms: int, ts: str = "ts") -> DataFrame:
    """(key, ts, gap_ms): events that follow their predecessor by more than ``limit_ms``."""
    order = Window.partitionBy(*key).orderBy(ts)
    stamp = F.col(ts).cast("timestamp")
    gap = F.floor((F.unix_micros(stamp) - F.unix_micros(F.lag(stamp).over(order))) / 1000)
    return events.withColumn("gap_ms", gap).filter(F.col("gap_ms") > limit_ms)


def throughput_ema(samples: DataFrame, key: str = "backend", ts: str = "ts", value: str = "rate",
                   weight: float = K.EMA_WEIGHT, slice_seconds: int = 3600) -> DataFrame:
    """(key, ema, samples): exponential average of positive samples in time order, seeded by the first.

    The recurrence is linear, so each (key, time slice) is summed on its own and the
    slice results, few per key, are folded in order.  A hot key is spread by slice.
    """
    slot = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / slice_seconds)
    rows = samples.filter(F.col(value) > 0).select(key, slot.alias("slot"), F.col(ts).alias("ts"), F.col(value).alias("x"))
    newest = Window.partitionBy(key, "slot").orderBy(F.desc("ts"))
    keep = 1.0 - weight
    parts = (
        rows.withColumn("age", F.row_number().over(newest) - 1)
        .groupBy(key, "slot").agg(
            F.sum(F.col("x") * weight * F.pow(F.lit(keep), F.col("age"))).alias("s"),
            F.count(F.lit(1)).alias("n"), F.min_by("x", "ts").alias("first"))
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", "s", "n", "first"))).alias("p"),
                          F.sum("n").alias("samples"))
    )
    ema = F.aggregate("p", F.element_at("p", 1)["first"],
                      lambda acc, r: r["s"] + F.pow(F.lit(keep), r["n"]) * acc)
    return parts.select(key, ema.alias("ema"), "samples")


def eval_rate(count: Column, nanos: Column) -> Column:
    """Tokens per second of one reply; null unless both figures are positive."""
    return F.when((count > 0) & (nanos > 0), count / (nanos / F.lit(1e9)))


def eta_ms(chars: Column, rate: Column) -> Column:
    seconds = chars / F.lit(K.CHARS_PER_TOKEN) / rate
    return F.when(rate > 0, F.least(F.lit(K.ETA_CAP_MS), F.floor(seconds * 1000)).cast("int"))


def stitch_rounds(rounds: DataFrame, key: list[str], order: str = "round_no",
                  limit: int = K.MAX_CONTINUATIONS) -> DataFrame:
    """(key, answer, tail, rounds): answer rounds joined while each ended for length with visible text.

    At most ``limit`` continuations; the tail is what the next round would be given.
    """
    by = Window.partitionBy(*key).orderBy(order)
    goes_on = (F.lower("done_reason") == "length") & ~T.is_blank(F.col("text"))
    rows = (
        rounds.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= limit + 1)
        .withColumn("stopped", F.coalesce(F.sum((~goes_on).cast("int")).over(
            by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .filter("stopped = 0")
    )
    answer = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("n", F.col("text").alias("t")))), lambda r: r["t"]), "")
    return rows.groupBy(*key).agg(answer.alias("answer"), F.count(F.lit(1)).alias("rounds")).withColumn(
        "tail", F.right("answer", F.lit(K.CONTINUATION_TAIL)))


def diagnostic_ring(entries: DataFrame, key: list[str], order: list[Column], n: int = K.DIAGNOSTIC_LINES) -> DataFrame:
    """The newest ``n`` entries per key; the group limit keeps at most ``n`` per task before the exchange."""
    newest = Window.partitionBy(*key).orderBy(*order) if key else None
    if newest is None:
        return entries.orderBy(*order).limit(n)
    return entries.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n)
