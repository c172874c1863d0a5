from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

from quillspan import constants as K
from quillspan.streaming import jobs, rules


def run(spark, tmp_path, parts, schema, job, watermark=None):
    """The rows that ``job`` gives for a stream with one file and micro-batch for each of ``parts``."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    jobs.use_rocksdb(spark)
    result = None
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema.replace("ts string", "ts timestamp")).parquet(source)
        result = job(stream.withWatermark("ts", watermark) if watermark else stream)
        jobs.run_available(result, out, check)
    return spark.read.schema(result.schema).parquet(out).collect()


def test_rows_out_of_turn_wait_and_copies_are_left_out(spark, tmp_path):
    rates = [(b, n, float(5 + n + 3 * (b == "y"))) for b in ("x", "y") for n in range(30)]
    source = random.Random(2)
    source.shuffle(rates)
    parts = [rates[:20] + rates[:5], rates[15:45], rates[40:]]
    got = run(spark, tmp_path, parts, "backend string, seq long, rate double", jobs.throughput_ema)
    want = {}
    for b in ("x", "y"):
        ema = rules.Ema()
        for n in range(30):
            ema.observe(float(5 + n + 3 * (b == "y")))
            want[(b, n)] = ema.value
    assert len(got) == 60 and {(r.backend, r.seq): pytest.approx(r.ema) for r in got} == want


def test_a_gap_is_given_up_once_the_watermark_is_past_it(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    parts = [
        [("a", 0, 1.0, at(0)), ("a", 2, 3.0, at(2)), ("a", 3, 5.0, at(3))],  # number 1 never comes
        [("b", 0, 1.0, at(30))],
        [("b", 1, 1.0, at(300))],
    ]
    got = run(spark, tmp_path, parts, "backend string, seq long, rate double, ts timestamp",
              lambda s: jobs.throughput_ema(s, gap_ms=60_000), "5 seconds")
    ema = rules.Ema()
    values = [ema.observe(x) or ema.value for x in (1.0, 3.0, 5.0)]
    assert sorted((r.backend, r.seq) for r in got) == [("a", 0), ("a", 2), ("a", 3), ("b", 0), ("b", 1)]
    assert [r.ema for r in sorted(got, key=lambda r: (r.backend, r.seq)) if r.backend == "a"] == pytest.approx(values)


def test_requests_end_by_silence_total_or_done():
    limits = {"headers": 10, "first_token": 10, "inactivity": 10, "total": 25}
    r = rules.Request()
    out = []
    for ts, event in [(0, "start"), (5, "headers"), (9, "token"), (18, "token"), (24, "token"), (26, "token"), (30, "start"), (33, "done"), (34, "token"), (40, "start")]:
        out += r.observe(ts, event, limits)
    out += r.expire(51, limits)
    assert out == [(0, 25, "timeout:total"), (30, 33, "done"), (40, 50, "timeout:headers")]
    assert rules.Request().expire(10**9, K.PHASE_TIMEOUT_MS) == []


def test_thoughts_are_flushed_in_pieces():
    split = rules.Split()
    out = [split.observe("", False, t) for t in ("a" * 139, "b", "more\n", "end", ".")] + [split.observe("", True, "x")]
    assert out == [[], [("thought", "a" * 139 + "b")], [("thought", "more\n")], [], [("thought", "end.")], [("thought", "x")]]


def test_expiry_and_gaps_exclude_each_other(spark):
    with pytest.raises(ValueError):
        jobs.throughput_ema(spark.range(1).selectExpr("'x' AS backend", "id AS seq", "1.0D AS rate"), 5, 5)


def test_rows_ahead_wait_in_slots_that_are_read_and_written_whole(monkeypatch):
    calls = []
    monkeypatch.setattr(jobs, "SLOT", 4)

    class State:
        def __init__(self):
            self.rows = {}

        def get(self):
            return self.rows.get(0)

        def update(self, value):
            self.rows[0] = value

        def getValue(self, key):
            calls.append("read")
            return self.rows.get(key)

        def updateValue(self, key, value):
            calls.append("write")
            self.rows[key] = value

        def removeKey(self, key):
            calls.append("remove")
            del self.rows[key]

    guard = jobs.ThroughputEma()
    guard.value, guard.waiting = State(), State()
    batch = lambda numbers: iter([Row(seq=n, rate=float(n + 1)) for n in numbers])
    ahead = [n for n in range(1, 40) if n not in (9, 21)]
    assert list(guard.handleInputRows(("k",), batch(ahead), None)) == []
    assert calls == ["write"] * 10  # not one for each of 37 rows
    calls.clear()
    got = list(guard.handleInputRows(("k",), batch([9, 0]), None))
    assert [r.seq for r in got] == list(range(21)) and calls.count("read") <= 6
    got = list(guard.handleInputRows(("k",), batch([21, 5]), None))
    assert [r.seq for r in got] == list(range(21, 40)) and guard.waiting.rows == {}
    ema = rules.Ema()
    for n in range(40):
        ema.observe(float(n + 1))
    assert got[-1].ema == pytest.approx(ema.value)
