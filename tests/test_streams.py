"""Streams that go by event time, stop and go on, and what their state writes."""

import math
import random
import time
from collections import Counter, deque
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.plans.stream_queries import timed_chunks
from sigspark.streaming import live
from sigspark.streaming.run import drained, recorded
from sigspark.streaming.stateful import Capturer, Ring, chunks_in, packed_chunks

START = datetime(2024, 1, 1)


def chunk(stream, seq, at, loud=False):
    level = 3.0 if loud else 0.1
    return stream, seq, START + timedelta(seconds=at), [level], [0.0], 20.0 if loud else -20.0


def events(spark, rows, t, late="1 second"):
    chunks = spark.createDataFrame(rows, "stream_id long, seq long, ts timestamp, i array<double>, q array<double>, power_db double")
    out = drained(live.triggered(recorded(chunks), t, late))
    return sorted((r.stream_id, (r.ts - START).total_seconds(), r.kind) for r in out.collect())


def test_silent_stream_times_out(spark):
    """Stream 1 falls silent at 3 s, and stream 2 takes the watermark on to 30 s."""
    t = live.Trigger(floor_chunks=2, above_db=10, pretrigger=0, window=1, timeout=4.0, rest=1.0)
    rows = [chunk(1, n, n) for n in range(4)] + [chunk(2, n, 3 * n) for n in range(11)]
    out = events(spark, rows, t)
    assert [e[1:] for e in out if e[0] == 1] == [(1.0, "floor")] + [(s, "timeout") for s in (5.0, 10.0, 15.0, 20.0, 25.0)]
    assert [e[1:] for e in out if e[0] == 2] == [(3.0, "floor")] + [(s, "timeout") for s in (7.0, 12.0, 17.0, 22.0, 27.0)]


def test_timeouts_in_any_time_zone(spark):
    """Events come by true time, not by the clock of the session, against which the watermark stood before."""
    t = live.Trigger(floor_chunks=2, above_db=10, pretrigger=0, window=1, timeout=4.0, rest=1.0)
    rows = [chunk(1, n, n) for n in range(4)] + [chunk(2, n, 3 * n) for n in range(11)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        out = events(spark, rows, t)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [e[1] for e in out if e[0] == 1 and e[2] == "timeout"] == [5.0, 10.0, 15.0, 20.0, 25.0]


def test_a_call_gives_one_frame_of_one_row_or_none():
    capturer = Capturer(live.Trigger(), False)
    event = (7, "timeout", -20.0, -12.0, None, None, None, None)
    assert list(capturer.frame((1,), [])) == []
    (out,) = capturer.frame((1,), [event, event])
    assert len(out) == 1 and [e["seq"] for e in out.events[0]] == [7, 7]


def test_timed_chunks_are_numbered_once(spark):
    """Their times come with them, not by a join of the table with itself."""
    plan = timed_chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Join" not in plan


def test_cooldown_in_seconds_at_any_chunk_length(spark):
    t = live.Trigger(floor_chunks=2, above_db=10, pretrigger=0, window=1, rest=1.0)
    for step in (0.25, 0.5, 1.0):
        n = int(6 / step)
        rows = [chunk(1, k, -10 + k) for k in range(2)] + [chunk(1, 2 + k, k * step, True) for k in range(n)]
        assert [e[1] for e in events(spark, rows, t) if e[2] == "capture"] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_capture_in_parts_over_many_batches(spark):
    """Chunks come in files of any order: rings, readings and parts of captures wait in the state."""
    t = live.Trigger(floor_chunks=5, above_db=10, pretrigger=2, window=6, timeout=1000.0)
    rows = [chunk(1, n, n, n in (8, 20)) for n in range(30)]
    shuffled = [rows[(k * 7) % 30] for k in range(30)]
    chunks = spark.createDataFrame(shuffled, "stream_id long, seq long, ts timestamp, i array<double>, q array<double>, power_db double")
    out = drained(live.triggered(recorded(chunks, 10, 1), t, "1 hour")).collect()
    captures = {r.seq: [round(v, 1) for v in r.i] for r in out if r.kind == "capture"}
    assert captures == {8: [0.1, 0.1, 3.0, 0.1, 0.1, 0.1], 20: [0.1, 0.1, 3.0, 0.1, 0.1, 0.1]}
    assert [r.seq for r in out if r.kind == "floor"] == [4]


def test_one_shot_and_no_seconds_without_ts(spark):
    t = live.Trigger(floor_chunks=2, above_db=10, pretrigger=0, window=1, timeout=4.0, one_shot=True)
    assert [e[1:] for e in events(spark, [chunk(1, n, n) for n in range(30)], t)] == [(1.0, "floor"), (5.0, "timeout")]
    chunks = spark.createDataFrame([], live.CHUNKS)
    with pytest.raises(ValueError, match="needs the column ts"):
        live.triggered(recorded(chunks), t)


def test_drained_streams_leave_only_their_result(spark):
    from sigspark.streaming import run

    top = run.working_folder(spark).rsplit("/", 1)[0].removeprefix("file:")
    before = set(Path(top).iterdir()) if Path(top).exists() else set()
    kept = recorded(spark.range(5))
    out = drained(recorded(spark.range(10)).filter("id > 3"))
    assert out.count() == 6 and len(set(Path(top).iterdir()) - before) == 2  # the result, and a stream that isn't drained yet
    assert drained(kept).count() == 5


def test_idle_stream_ends(spark, tmp_path):
    """No chunk for a while by the clock: what was being captured is padded."""
    t = live.Trigger(floor_chunks=2, above_db=10, pretrigger=0, window=4, idle=500)
    rows = [chunk(1, n, n, n == 3) for n in range(4)]
    chunks = spark.createDataFrame(rows, "stream_id long, seq long, ts timestamp, i array<double>, q array<double>, power_db double").drop("ts")
    stream = live.triggered(recorded(chunks), t)
    query = stream.writeStream.format("memory").queryName("idle_events").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(processingTime="1 second").start()
    for _ in range(30):
        query.awaitTermination(1)
        if spark.table("idle_events").filter("kind = 'capture'").count():
            break
    query.stop()
    (r,) = spark.table("idle_events").filter("kind = 'capture'").collect()
    assert r.i == [3.0, 0.0, 0.0, 0.0]


def test_batches_write_what_is_new(spark, tmp_path):
    """With a thousand chunks waiting behind a gap, a batch of ten more writes about as many state rows as it has chunks."""
    frames = [(1, n, [float(n)] * 4, [0.0] * 4) for n in range(1, 601)]
    parts = [spark.createDataFrame(p, "stream_id long, seq long, i array<double>, q array<double>") for p in (frames[:500], frames[500:510], frames[510:520])]
    folder = str(tmp_path / "in")
    written = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(part.schema).parquet(folder)
        query = live.rechunked(stream, 7).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        written.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]))
    assert written[0] >= 500 and max(written[1:]) < 40


def test_calibration_is_told_once_a_round(spark):
    """Two streams, each of which finds its floor anew after a capture."""
    told = []
    listener = live.CalibrationListener(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    try:
        rows = [(s, n, [0.1], [0.0], 10.0 * s if n in (2, 5) else -20.0 - s - (n > 2)) for s in (1, 2) for n in range(6)]
        chunks = spark.createDataFrame(rows, "stream_id long, seq long, i array<double>, q array<double>, power_db double")
        t = live.Trigger(floor_chunks=2, above_db=10, pretrigger=0, window=1, recalibrate=True)
        events = drained(live.observed_calibration(live.triggered(recorded(chunks), t))).collect()
        for _ in range(100):
            if len(told) >= 4:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(told) == sorted((r.stream_id, r.floor, r.trigger) for r in events if r.kind == "floor")
    assert sorted(told) == [(1, -22.0, -12.0), (1, -21.0, -11.0), (2, -23.0, -13.0), (2, -22.0, -12.0)]


def test_summary_on_a_stream_equals_the_batch(spark):
    from sigspark.operators.metrics import event_summary

    rows = [(START + timedelta(minutes=n), "ab"[n % 2], "xyz"[n % 7 % 3], n % 3 == 0 if n % 11 else None, n / 400, None if n % 5 == 0 else float(n)) for n in range(400)]
    df = spark.createDataFrame(rows, "ts timestamp, condition string, prediction string, alert boolean, non_noise_confidence double, snr_db double")
    out = drained(live.streamed_event_summary(recorded(df), "1 hour", "2 hours"))
    last = max(r.start for r in out.collect())
    assert last == START + timedelta(hours=3)  # the watermark stands at 4:39
    want = event_summary(df.withColumn("start", F.date_trunc("hour", "ts")).filter(F.col("start") <= F.lit(last)), "start", "condition")
    cells = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(d.columns))) for r in d.collect())
    assert cells(out) == cells(want)


class State:
    """A handle whose states live in Python, with how often they are called and how many rows they are given."""

    def __init__(self):
        self.calls, self.rows = Counter(), 0

    def state(self, name, value):
        return Kept(self, name, value)

    def getValueState(self, name, schema):  # noqa: N802
        return self.state(name, None)

    def getListState(self, name, schema):  # noqa: N802
        return self.state(name, [])

    def getMapState(self, name, key, value):  # noqa: N802
        return self.state(name, {})


class Kept:
    def __init__(self, top, name, value):
        self.top, self.name, self.value = top, name, value

    def told(self, rows=0):
        self.top.calls[self.name] += 1
        self.top.rows += rows

    def get(self):
        self.told()
        return self.value

    def update(self, value):
        self.told(1)
        self.value = value

    put = lambda self, rows: (self.told(len(rows)), setattr(self, "value", rows))
    appendList = lambda self, rows: (self.told(len(rows)), setattr(self, "value", self.value + rows))  # noqa: E731, N815

    def updateValue(self, key, value):  # noqa: N802
        self.told(1)
        self.value[key] = value


CHUNKS = "stream_id long, seq long, i array<double>, q array<double>, power_db double"


def test_chunks_come_packed_and_whole(spark):
    """A stream's chunks of a batch are few rows, and none is lost or changed: empty ones, large ones, and ones with no power too."""
    rows = [(s, n, [s + 0.5 * n] * (n % 3), [-1.0 * n] * (n % 3), None if n == 5 else float(n)) for n in range(300) for s in (3, 1, 2)]
    rows += [(4, n, [float(n)] * 3000, [0.0] * 3000, 1.0) for n in range(2)]
    packed = packed_chunks(spark.createDataFrame(rows, CHUNKS).coalesce(1)).collect()
    assert len(packed) < 20 and sum(r.stream_id == 4 for r in packed) == 2
    out = [(r.stream_id, seq, i.tolist(), q.tolist(), None if math.isnan(db) else db) for r in packed for seq, i, q, db, _ in chunks_in([r])]
    assert sorted(out, key=lambda r: r[:2]) == sorted(rows, key=lambda r: r[:2])
    with pytest.raises(Exception, match="needs a number and samples"):
        packed_chunks(spark.createDataFrame([(1, 0, None, [0.0], 0.0)], CHUNKS)).collect()


def test_a_call_needs_few_calls_of_the_state(spark):
    """Seventy chunks of a stream at once: its numbers are read and written once, and its ring is written once."""
    rows = [(1, n, [1.0], [1.0], 30.0 if n in (25, 40) else 0.0) for n in range(70)]
    state, capturer = State(), Capturer(live.Trigger(floor_chunks=20, above_db=4.0, pretrigger=2, window=5, cooldown=3), False)
    capturer.init(state)
    (out,) = capturer.handleInputRows((1,), iter(packed_chunks(spark.createDataFrame(rows, CHUNKS).coalesce(1)).collect()), None)
    assert [(e["kind"], e["seq"]) for e in out.events] == [("floor", 19), ("capture", 25), ("capture", 40)]
    assert state.calls == {"capture_value": 2, "ring": 1}


def test_ring_over_batches_of_any_size():
    """It holds the last chunks, across batches and resets, and writes about twice what is new at most."""
    draw = random.Random(7)
    for most in (1, 2, 5):
        state, held, pushed, listed, size = State(), deque(maxlen=most), 0, 0, 0
        ring = Ring(state, most)
        for batch in range(200):
            ring.load(listed, size)
            if draw.random() < 0.1:
                held.clear()
                ring.load(ring.listed, 0)
            for n in range(draw.randrange(4)):
                x = np.array([batch, n], float)
                ring.push((x, -x))
                held.append((x, -x))
                pushed += 1
            assert [(i.tolist(), q.tolist()) for i, q in ring.chunks()] == [(i.tolist(), q.tolist()) for i, q in held]
            ring.save()
            listed, size = ring.listed, ring.size
            assert len(ring.kept.value) == listed <= 2 * most
        assert state.rows <= 2 * pushed
