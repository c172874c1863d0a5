"""Stateful stream operators on transformWithState, and foreachBatch jobs.

State is keyed by session, request or backend, and rows are taken in the order of
their numbers or times, whatever files and micro-batches bring them.  With ``ttl_ms``
state expires after that time without input, which bounds state for a stream that
never ends; expiry needs processing time, and a stream run to its end with
``availableNow`` leaves it out, since processing-time state keeps such a run alive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspan import constants as K
from quillspan.session import cut_lineage
from quillspan.streaming.rules import Breaker, Ema, Loop, Request, Split, Stall


#: Numbers whose waiting rows share one state entry.
SLOT = 1024


@dataclass
class Turn:
    """Where a key stands: its rule, the number that comes next, and the earliest event time in each slot of waiting rows.

    ``stored`` are the slots in the state, ``open`` holds those that were read or changed, ``touched`` are to be written back.
    """

    rule: object
    next: int = 0
    due: int | None = None
    slots: dict[int, int] = field(default_factory=dict)
    stored: frozenset[int] = frozenset()
    open: dict[int, dict[int, list]] = field(default_factory=dict)
    touched: set[int] = field(default_factory=set)


class InOrder(StatefulProcessor):
    """Hands the rows of a key to a rule in the order of ``seq``, 0, 1, 2, ..., however they arrive.

    The rule and the number that comes next are one state value.  A row ahead of its turn waits in a map by slots of
    ``SLOT`` numbers, which are read and written whole, so that a batch costs a few state calls and not some for each row;
    a row that comes again is left out.  With ``gap_ms`` rows carry the event time ``ts``, and once the watermark is that
    far past a waiting row the numbers missing before it are given up, so what waits stays bounded; without it gaps wait
    on.  With ``ttl_ms`` state expires after that time without input.
    """

    rule: type = Loop
    fields: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    def __init__(self, ttl_ms: int | None = None, gap_ms: int | None = None) -> None:
        self.ttl_ms, self.gap_ms = ttl_ms, gap_ms
        self.held = (*self.fields, *(("at_ms",) if gap_ms is not None else ()))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("rule", "json string, due long", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "slot long", "rows string", self.ttl_ms)

    def step(self, rule, seq: int, row: dict) -> Iterator[dict]:
        """What the rule says to one row."""
        raise NotImplementedError

    def _load(self) -> Turn:
        kept = self.value.get()
        if kept is None:
            return Turn(self.rule())
        held = json.loads(kept[0])
        slots = {int(k): v for k, v in held["slots"].items()}
        return Turn(self.rule(**held["rule"]), held["next"], kept[1], slots, frozenset(slots))

    def _slot(self, turn: Turn, number: int) -> dict[int, list]:
        """The waiting rows of a slot by their numbers."""
        if number not in turn.open:
            kept = self.waiting.getValue((number,)) if number in turn.stored else None
            turn.open[number] = {int(k): v for k, v in json.loads(kept[0]).items()} if kept else {}
        return turn.open[number]

    def _take(self, turn: Turn, row: list, out: list[tuple]) -> None:
        """The rule sees the row whose turn it is."""
        for found in self.step(turn.rule, turn.next, dict(zip(self.held, row))):
            out.append((turn.next, *(found[c] for c in self.columns)))
        turn.next += 1

    def _drain(self, turn: Turn, out: list[tuple]) -> None:
        """Take the waiting rows whose turn has come."""
        while (number := turn.next // SLOT) in turn.slots or number in turn.open:
            row = self._slot(turn, number).pop(turn.next, None)
            if row is None:
                return
            turn.touched.add(number)
            self._take(turn, row, out)

    def _measure(self, turn: Turn, number: int) -> None:
        """Note a slot's earliest event time, or that it is empty."""
        rows = turn.open[number]
        if rows:
            turn.slots[number] = min(row[-1] for row in rows.values()) if self.gap_ms is not None else 0
        else:
            turn.slots.pop(number, None)

    def _finish(self, turn: Turn, out: list[tuple], key) -> list[Row]:
        for number in sorted(turn.touched):
            self._measure(turn, number)
            if turn.open[number]:
                self.waiting.updateValue((number,), (json.dumps(turn.open[number]),))
            elif number in turn.stored:
                self.waiting.removeKey((number,))
        due = turn.due
        if self.gap_ms is not None:
            first = min(turn.slots.values(), default=None)
            wanted = None if first is None else first + self.gap_ms
            if wanted != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                if wanted is not None:
                    self.handle.registerTimer(wanted)
                due = wanted
        self.value.update((json.dumps({"rule": asdict(turn.rule), "next": turn.next, "slots": turn.slots}), due))
        named = Row("key", "seq", *self.columns)
        return [named(key[0], *row) for row in out]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        turn, out = self._load(), []
        came = [(row["seq"], [_plain(row[f]) for f in self.held]) for row in rows]
        for seq, row in sorted(came, key=lambda r: r[0]):
            if seq == turn.next:
                self._take(turn, row, out)
                self._drain(turn, out)
            elif seq > turn.next:
                self._slot(turn, seq // SLOT)[seq] = row
                turn.touched.add(seq // SLOT)
        yield from self._finish(turn, out, key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        turn, out = self._load(), []
        turn.due = None
        limit = timerValues.getCurrentWatermarkInMs() - self.gap_ms
        while turn.slots and min(turn.slots.values()) <= limit:
            first = min(turn.slots)
            turn.next = min(self._slot(turn, first))  # the numbers before the first waiting one are given up
            self._drain(turn, out)
            for number in range(first, turn.next // SLOT + 1):
                if number in turn.open:
                    self._measure(turn, number)
        yield from self._finish(turn, out, key)

    def close(self) -> None:
        pass


def _plain(value):
    """A cell as JSON holds it."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


class RepetitionGuard(InOrder):
    """Fires once per session when five usable lines in a row are equal."""

    rule, fields, columns = Loop, ("delta",), ("norm",)

    def step(self, rule: Loop, seq: int, row: dict) -> Iterator[dict]:
        norm = rule.observe(row["delta"])
        if norm is not None:
            yield {"norm": norm}


class StallGuard(InOrder):
    """Verdict per hidden note of a session."""

    rule, fields, columns = Stall, ("note", "elapsed_ms"), ("verdict",)

    def step(self, rule: Stall, seq: int, row: dict) -> Iterator[dict]:
        verdict = rule.observe(row["note"], int(row["elapsed_ms"]))
        if verdict:
            yield {"verdict": verdict}


class TagSplitter(InOrder):
    """Visible and hidden pieces of a session, flushed at natural breaks."""

    rule, fields, columns = Split, ("delta", "done", "thought"), ("kind", "text")

    def step(self, rule: Split, seq: int, row: dict) -> Iterator[dict]:
        for kind, text in rule.observe(row["delta"], bool(row["done"]), row["thought"]):
            yield {"kind": kind, "text": text}


class FailureBreaker(InOrder):
    """Whether each call of a backend is allowed, by the failures before it."""

    rule, fields, columns = Breaker, ("at", "ok", "message"), ("allowed", "failures")

    def step(self, rule: Breaker, seq: int, row: dict) -> Iterator[dict]:
        allowed = rule.observe(row["at"], bool(row["ok"]), row["message"])
        yield {"allowed": allowed, "failures": rule.failures}


class ThroughputEma(InOrder):
    """Exponential average of positive token rates per backend, after each sample."""

    rule, fields, columns = Ema, ("rate",), ("ema",)

    def step(self, rule: Ema, seq: int, row: dict) -> Iterator[dict]:
        rule.observe(row["rate"])
        if rule.value is not None:
            yield {"ema": rule.value}


class PhaseTimeouts(StatefulProcessor):
    """Outcome of each request of a session by event time: done, or the limit that ran out first.

    Events wait until the watermark has passed them and are then taken in order of time, so late files change nothing.  A
    request starts with ``start`` and has two deadlines: silence in its phase, and its total time.  Whichever comes first
    ends it, as ``done`` does; events outside a request count for nothing.
    """

    def __init__(self, limits: dict[str, int] | None = None) -> None:
        self.limits = limits or K.PHASE_TIMEOUT_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("request", "json string")
        self.waiting = handle.getListState("waiting", "ts long, event string")

    def _request(self) -> Request:
        return Request(**json.loads(self.value.get()[0])) if self.value.exists() else Request()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        stamps = [int(at) for at in frame["at_ms"]]
        self.waiting.appendList(list(zip(stamps, frame["event"])))
        self.handle.registerTimer(min(stamps))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, request, out = timerValues.getCurrentWatermarkInMs(), self._request(), []
        held = sorted(self.waiting.get())
        for ts, event in held:
            if ts <= passed:
                out += request.observe(ts, event, self.limits)
        out += request.expire(passed, self.limits)
        rest = [(ts, event) for ts, event in held if ts > passed]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        deadline = request.deadline(self.limits)
        following = [ts for ts, _ in rest[:1]] + ([deadline[0]] if deadline else [])
        if following:
            self.handle.registerTimer(min(following))
        self.value.update((json.dumps(asdict(request)),))
        yield pd.DataFrame(
            [{"session_id": key[0], "started": a, "ended": b, "outcome": what} for a, b, what in out],
            columns=["session_id", "started", "ended", "outcome"])

    def close(self) -> None:
        pass


def _run(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def _in_order(stream: DataFrame, key: str, kind: type, columns: str, ttl_ms: int | None, gap_ms: int | None) -> DataFrame:
    """``key``, seq and ``columns`` of the rule ``kind``; rows hold ``key``, a dense ``seq`` and the rule's fields."""
    if ttl_ms and gap_ms is not None:
        raise ValueError("state expires by processing time (ttl_ms) or gaps by event time (gap_ms), not both")
    mode = "ProcessingTime" if ttl_ms else "EventTime" if gap_ms is not None else "None"
    named = stream.schema[key].dataType.simpleString()
    if gap_ms is not None:
        stream = stream.withColumn("at_ms", F.unix_millis("ts"))
    out = stream.groupBy(key).transformWithState(  # rows, not frames: a key has few rows in a batch
        statefulProcessor=kind(ttl_ms, gap_ms), outputStructType=f"key {named}, seq long, {columns}", outputMode="Append", timeMode=mode)
    return out.withColumnRenamed("key", key)


def repetition_guard(stream: DataFrame, ttl_ms: int | None = None, gap_ms: int | None = None) -> DataFrame:
    """(session_id, seq, delta[, ts]) → (session_id, seq, norm) where a loop was detected."""
    return _in_order(stream, "session_id", RepetitionGuard, "norm string", ttl_ms, gap_ms)


def stall_guard(stream: DataFrame, ttl_ms: int | None = None, gap_ms: int | None = None) -> DataFrame:
    """(session_id, seq, note, elapsed_ms[, ts]) → (session_id, seq, verdict)."""
    return _in_order(stream, "session_id", StallGuard, "verdict string", ttl_ms, gap_ms)


def split_tagged_output(stream: DataFrame, ttl_ms: int | None = None, gap_ms: int | None = None) -> DataFrame:
    """(session_id, seq, delta, done[, thought, ts]) → (session_id, seq, kind, text).

    ``thought`` is hidden text that the model sends apart from the answer; it comes out as pieces of kind ``thought``.
    """
    if "thought" not in stream.columns:
        stream = stream.withColumn("thought", F.lit(None).cast("string"))
    return _in_order(stream, "session_id", TagSplitter, "kind string, text string", ttl_ms, gap_ms)


def failure_breaker(stream: DataFrame, ttl_ms: int | None = None, gap_ms: int | None = None) -> DataFrame:
    """(backend, seq, at, ok, message[, ts]) → (backend, seq, allowed, failures); ``at`` is the time of the call."""
    return _in_order(stream, "backend", FailureBreaker, "allowed boolean, failures int", ttl_ms, gap_ms)


def throughput_ema(stream: DataFrame, ttl_ms: int | None = None, gap_ms: int | None = None) -> DataFrame:
    """(backend, seq, rate[, ts]) → (backend, seq, ema) after each sample."""
    return _in_order(stream, "backend", ThroughputEma, "ema double", ttl_ms, gap_ms)


def phase_timeouts(stream: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(session_id, ts, event), with a watermark on ts → (session_id, started, ended, outcome), times in milliseconds."""
    named = stream.schema["session_id"].dataType.simpleString()
    stream = stream.withColumn("at_ms", F.unix_millis("ts"))
    return _run(stream, "session_id", PhaseTimeouts(limits), f"session_id {named}, started long, ended long, outcome string", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into a Parquet table and stop."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def auto_memory(messages: DataFrame, path: str, checkpoint: str, now: str) -> None:
    """Extract memories of arriving user messages and upsert them into a versioned table.

    messages: streaming conv_id, turn, role, text.  Version n+1 is written from
    version n, so a replayed batch rewrites the same version.
    """
    from quillspan.operators.memory import extract_memories, upsert_memories

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fields = "id string, key string, value string, category string, created_at string, updated_at string, " \
                 "confidence double, pinned boolean"
        before = spark.read.schema(fields).parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], fields)
        found = extract_memories(batch.filter("role = 'user'")).select(
            F.sha1(F.encode(F.concat_ws("|", "category", "key"), "UTF-8")).alias("id"), "key", "value", "category",
            F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), "confidence", F.lit(False).alias("pinned"),
            F.struct("conv_id", "turn").alias("seq"))
        upsert_memories(before, cut_lineage(found, "memories-found")).write.mode("overwrite").parquet(f"{path}/v{number}")

    query = (
        messages.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
