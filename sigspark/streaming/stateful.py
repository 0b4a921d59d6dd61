"""Stateful stream operators on keyed lists, maps and timers: exact chunks, energy-triggered and fixed captures.

State is kept in pieces: numbers in one value, chunks that wait for missing ones in a map, a ring of the last chunks and what is
being captured in lists. A batch writes what is new, whatever is held. Samples are kept as bytes.

Calls of the state's handle and rows are dear, bytes aren't: chunks without event time come to a stream's state packed, many to a row.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: State on disk, uploaded by its changes.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
SAMPLES = "payload binary"
NONE = -1


@dataclass(frozen=True)
class Trigger:
    """``timeout_chunks``, ``timeout``: chunks, and seconds of event time, after which waiting for a trigger ends. ``cooldown``, ``rest``:
    chunks, and seconds of event time, after a capture or a timeout in which triggers are dropped. ``recalibrate``: then the floor is
    found anew. ``most_held``: chunks that may wait for missing ones before these are given up.
    ``idle``: milliseconds without a chunk after which a stream counts as ended (None: only an empty chunk ends it)."""

    floor_chunks: int = 20
    above_db: float = 8.0
    absolute_db: float | None = None
    pretrigger: int = 2
    window: int = 1024
    cooldown: int = 0
    one_shot: bool = False
    timeout_chunks: int | None = None
    recalibrate: bool = False
    most_held: int = 1000
    idle: int | None = None
    timeout: float | None = None
    rest: float = 0.0


def level(floor: float, t: Trigger) -> float:
    return t.absolute_db if t.absolute_db is not None else floor + t.above_db


def power_of(i: np.ndarray, q: np.ndarray) -> float:
    return float(10 * np.log10(np.mean(i * i + q * q) + 1e-12)) if len(i) else -120.0


def packed(i: np.ndarray, q: np.ndarray) -> bytes:
    return np.concatenate([np.asarray(i, "<f8"), np.asarray(q, "<f8")]).tobytes()


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(payload, "<f8")
    return both[: len(both) // 2], both[len(both) // 2 :]


def whole(x: float | None) -> int | None:
    return None if x is None or x != x else int(x)


def packed_chunks(chunks: DataFrame, most: int = 1 << 14) -> DataFrame:
    """The chunks of a stream that lie in a batch as rows of ``most`` bytes or one chunk: their numbers, sizes, samples (all of i, then
    of q) and powers, each as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(np.argsort(batch.column("stream_id").dictionary_encode("encode").indices.to_numpy(), kind="stable")))
            ids, seq, i, q = (batch.column(c) for c in ("stream_id", "seq", "i", "q"))
            if seq.null_count or i.null_count or q.null_count:
                raise ValueError("a chunk needs a number and samples; without samples, empty arrays")
            stream, seq = ids.dictionary_encode("encode").indices.to_numpy(), seq.to_numpy(zero_copy_only=False).astype("<i8")
            sizes = np.stack([pc.list_value_length(x).to_numpy(zero_copy_only=False).astype("<i8") for x in (i, q)])
            ends = np.concatenate([np.zeros((2, 1), int), sizes.cumsum(axis=1)], axis=1)
            i, q = (x.flatten().to_numpy(zero_copy_only=False).astype("<f8") for x in (i, q))
            powers = batch.column("power_db").to_numpy(zero_copy_only=False).astype("<f8") if "power_db" in batch.schema.names else None
            size = 8 * sizes.sum(axis=0) + 32
            first = np.append(True, stream[1:] != stream[:-1])
            upto = size.cumsum()
            piece = (upto - 1 - np.maximum.accumulate(np.where(first, upto - size, 0))) // most
            at = np.flatnonzero(first | np.append(True, piece[1:] != piece[:-1]))
            cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(seq)], strict=True))
            columns = [
                [seq[a:b].tobytes() for a, b in cuts], [sizes[:, a:b].tobytes() for a, b in cuts],
                [i[ends[0, a] : ends[0, b]].tobytes() + q[ends[1, a] : ends[1, b]].tobytes() for a, b in cuts],
                [None if powers is None else powers[a:b].tobytes() for a, b in cuts],
            ]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, pa.binary()) for c in columns)], names=["stream_id", *PACKED])

    rows = chunks.select(*[c for c in ("stream_id", "seq", "i", "q", "power_db") if c in chunks.columns])
    return rows.mapInArrow(run, ", ".join([f"stream_id {dict(rows.dtypes)['stream_id']}", *(f"{c} binary" for c in PACKED)]))


PACKED = ("seqs", "sizes", "samples", "powers")


def chunks_in(rows: Iterator[Row]) -> Iterator[tuple]:
    """(seq, i, q, power_db, ts) of packed chunks; they have no times."""
    for r in rows:
        seqs, samples = np.frombuffer(r.seqs, "<i8").tolist(), np.frombuffer(r.samples, "<f8")
        powers = np.frombuffer(r.powers, "<f8").tolist() if r.powers is not None else [None] * len(seqs)
        ends = [0, *np.frombuffer(r.sizes, "<i8").cumsum().tolist()]
        n = len(seqs)
        for k, (seq, db) in enumerate(zip(seqs, powers, strict=True)):
            yield seq, samples[ends[k] : ends[k + 1]], samples[ends[n + k] : ends[n + k + 1]], db, None


def timed_chunks_in(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(seq, i, q, power_db, ts) of frames; ``ts`` in microseconds."""
    for part in rows:
        for seq, i, q, db, ts in zip(*(part[c].tolist() for c in ("seq", "i", "q", "power_db", "us")), strict=True):
            yield seq, np.asarray(i, float), np.asarray(q, float), db, whole(ts)


class InOrder:
    """Chunks of a stream by number. They are given out in order; late and repeated ones are dropped. When over ``most`` wait for a
    missing one, that is given up. Its numbers are kept by the processor, with its own."""

    NUMBERS = "expected long, late long, held long"

    def __init__(self, handle: StatefulProcessorHandle, most: int):
        self.most = most
        self.held = handle.getMapState("held", "seq long", f"{SAMPLES}, power_db double, ts long")

    def load(self, expected: int, late: int, held: int) -> None:
        self.numbers = (expected, late, held)

    def ready(self, chunks: Iterator[tuple]) -> Iterator[tuple]:
        """(seq, i, q, power_db, ts) in order; ``numbers`` holds for what was taken when all are."""
        expected, late, held = self.numbers
        new: dict[int, tuple] = {}
        for seq, *chunk in chunks:
            if seq < expected or seq in new or (held and self.held.containsKey((seq,))):
                late += 1
            else:
                new[seq] = chunk
        while new or held:
            if expected in new:
                yield expected, *new.pop(expected)
            elif held and self.held.containsKey((expected,)):
                payload, db, ts = self.held.getValue((expected,))
                self.held.removeKey((expected,))
                held -= 1
                yield expected, *unpacked(payload), db, ts
            elif len(new) + held <= self.most:
                break
            else:
                expected = min([*new, *(k[0] for k in self.held.keys())] if held else new)
                continue
            expected += 1
        for seq, (i, q, db, ts) in new.items():
            self.held.updateValue((seq,), (packed(i, q), None if db is None else float(db), ts))
        self.numbers = (expected, late, held + len(new))


class Rechunker(StatefulProcessor):
    """Chunks of ``size`` samples. What doesn't fill one is appended to the state, and read when a chunk is full."""

    def __init__(self, size: int, most_held: int):
        self.size, self.most_held = size, most_held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.order = InOrder(handle, self.most_held)
        self.count = handle.getValueState("count", f"out long, rest long, {InOrder.NUMBERS}")
        self.rest = handle.getListState("rest", SAMPLES)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        out, rest, *numbers = self.count.get() or (0, 0, 0, 0, 0)
        self.order.load(*numbers)
        parts = [(i, q) for _, i, q, _, _ in self.order.ready(chunks_in(rows))]
        total = rest + sum(len(i) for i, _ in parts)
        if total < self.size:
            if parts:
                self.rest.appendList([(packed(i, q),) for i, q in parts])
            self.count.update((out, total, *self.order.numbers))
            return
        parts = [*(unpacked(p) for (p,) in self.rest.get()), *parts] if rest else parts
        i, q = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
        n = total // self.size
        if total > n * self.size:
            self.rest.put([(packed(i[n * self.size :], q[n * self.size :]),)])
        elif rest:
            self.rest.clear()
        self.count.update((out + n, total - n * self.size, *self.order.numbers))
        i, q = (x[: n * self.size].reshape(n, self.size) for x in (i, q))
        for k in range(n):
            yield Row(stream_id=key[0], seq=out + k, i=i[k], q=q[k], power_db=power_of(i[k], q[k]))

    def close(self) -> None:
        pass


class Ring:
    """The last ``most`` chunks, at the end of a list. A batch appends what is new; when the list is twice as long as the ring, or nothing
    in it counts any more, it is written anew."""

    def __init__(self, handle: StatefulProcessorHandle, most: int):
        self.most, self.kept = most, handle.getListState("ring", SAMPLES)

    def load(self, listed: int, size: int) -> None:
        """``listed``: chunks in the list, of which with those to come the last ``size`` count."""
        self.listed, self.size, self.new = listed, size, deque(maxlen=self.most)

    def push(self, chunk: tuple[np.ndarray, np.ndarray]) -> None:
        if self.most:
            self.new.append(chunk)
            self.size = min(self.most, self.size + 1)

    def chunks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        old = self.size - len(self.new)
        return [*([unpacked(p) for (p,) in self.kept.get()][-old:] if old else []), *self.new]

    def save(self) -> None:
        if self.new:
            fits = len(self.new) < self.size and self.listed + len(self.new) <= 2 * self.most
            rows = [(packed(*c),) for c in (self.new if fits else self.chunks())]
            self.kept.appendList(rows) if fits else self.kept.put(rows)
            self.listed = len(rows) + (self.listed if fits else 0)


class Capturer(StatefulProcessor):
    """A stream's trigger: the floor's readings, a ring of chunks, the capture that is being filled, and a timer for the wait's end."""

    VALUE = "floor double, readings long, cap_seq long, cap_db double, cap_size long, cap_ts long, quiet long, quiet_ts long, wait_ts long, waited long, done boolean, listed long, ringed long, timer long, last_ts long, " + InOrder.NUMBERS

    def __init__(self, t: Trigger, timed: bool, discard: int = 0):
        self.t, self.timed, self.discard = t, timed, discard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.order = InOrder(handle, self.t.most_held)
        self.value = handle.getValueState("capture_value", self.VALUE)
        self.readings = handle.getListState("readings", "power_db double")
        self.parts = handle.getListState("parts", SAMPLES)
        self.ring = Ring(handle, self.t.pretrigger)

    def load(self) -> None:
        v = self.value.get() or (None, 0, NONE, 0.0, 0, None, NONE, None, None, 0, False, 0, 0, None, None, 0, 0, 0)
        self.floor, self.known, self.cap_seq, self.cap_db, self.cap_size, self.cap_ts, self.quiet, self.quiet_ts, self.wait_ts, self.waited, self.done, listed, ringed, self.timer, self.last_ts, *numbers = v
        self.ring.load(listed, ringed)
        self.order.load(*numbers)
        self.new_readings: list[float] = []
        self.new_parts: list[tuple] = []
        self.stored = self.cap_seq != NONE

    def save(self) -> None:
        if self.new_readings:
            self.readings.appendList([(p,) for p in self.new_readings])
        if self.new_parts:
            rows = [(packed(*p),) for p in self.new_parts]
            self.parts.appendList(rows) if self.stored else self.parts.put(rows)
        self.ring.save()
        due = self.due() if self.timed else None
        timer = None if due is None else -(-due // 1000)  # in milliseconds
        if timer != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.value.update((self.floor, self.known, self.cap_seq, self.cap_db, self.cap_size, self.cap_ts, self.quiet, self.quiet_ts, self.wait_ts, self.waited, self.done, self.ring.listed, self.ring.size, timer, self.last_ts, *self.order.numbers))

    def due(self) -> int | None:
        """When waiting ends, in microseconds of event time; None while nothing is waited for."""
        if self.t.timeout is None or self.floor is None or self.cap_seq != NONE or self.done or self.wait_ts is None:
            return None
        return self.wait_ts + round(self.t.timeout * 1e6)

    def event(self, kind: str, seq: int, db: float | None, ts: int | None, i=None, q=None) -> tuple:
        return seq, kind, self.floor, level(self.floor, self.t), db, i, q, ts

    def round_over(self, seq: int, ts: int | None) -> None:
        """After a capture or a timeout: a cool-down, and the floor anew if it is to be."""
        self.quiet, self.waited, self.cap_seq, self.cap_size = seq + 1 + self.t.cooldown, 0, NONE, 0
        if ts is not None:
            self.quiet_ts = self.wait_ts = ts + round(self.t.rest * 1e6)
        self.done = self.t.one_shot
        if self.t.recalibrate:
            self.floor, self.known, self.new_readings = None, 0, []
            self.readings.clear()
            self.ring.load(self.ring.listed, 0)

    def finished(self, seq: int, ts: int | None, ended: bool = False) -> Iterator[tuple]:
        """The capture, when it is full, or padded with zeros when the stream ends."""
        if self.cap_seq != NONE and (ended or self.cap_size >= self.t.window):
            parts = [*(unpacked(p) for (p,) in self.parts.get()), *self.new_parts] if self.stored else self.new_parts
            short = [np.zeros(self.t.window - self.cap_size)] if self.cap_size < self.t.window else []
            i, q = (np.concatenate([*(p[c] for p in parts), *short])[: self.t.window] for c in (0, 1))
            yield self.event("capture", self.cap_seq, self.cap_db, self.cap_ts, i, q)
            if self.stored:
                self.parts.clear()
            self.new_parts, self.stored = [], False
            self.round_over(seq, ts)

    def timed_out(self, seq: int, now: int, included: bool) -> Iterator[tuple]:
        """Waits that ended before ``now``, or at it."""
        while (due := self.due()) is not None and (due < now or (included and due == now)):
            yield self.event("timeout", seq, None, due)
            self.round_over(seq, due)

    def take(self, seq: int, i: np.ndarray, q: np.ndarray, db: float, ts: int | None) -> Iterator[tuple]:
        if not len(i):
            yield from self.finished(seq, ts, ended=True)
            return
        if ts is not None:
            yield from self.timed_out(seq - 1, ts, included=False)
            self.last_ts = ts
        awake = seq >= self.quiet and (self.quiet_ts is None or ts is None or ts >= self.quiet_ts)
        if self.floor is None:
            if awake and not self.done:
                self.new_readings.append(float(db))
                self.known += 1
                if self.known == self.t.floor_chunks:
                    before = [p for (p,) in self.readings.get()] if self.known > len(self.new_readings) else []
                    self.floor, self.wait_ts = float(np.median([*before, *self.new_readings])), ts
                    if before:
                        self.readings.clear()
                    self.new_readings = []
                    yield self.event("floor", seq, float(db), ts)
            return
        if self.cap_seq != NONE:
            self.new_parts.append((i, q))
            self.cap_size += len(i)
        elif not self.done and awake:
            if db >= level(self.floor, self.t):
                self.new_parts = [*self.ring.chunks(), (i, q)]
                self.cap_seq, self.cap_db, self.cap_ts, self.cap_size = seq, float(db), ts, sum(len(p[0]) for p in self.new_parts)
            else:
                self.waited += 1
        yield from self.finished(seq, ts)
        if self.floor is not None and self.t.timeout_chunks is not None and self.cap_seq == NONE and self.waited >= self.t.timeout_chunks:
            yield self.event("timeout", seq, float(db), ts)
            self.round_over(seq, ts)
        if self.floor is not None:
            self.ring.push((i, q))

    def frame(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        """One row for all events of a call, none without events: frames are dear, and there is one for each key."""
        if out:
            yield pd.DataFrame({"stream_id": [key[0]], "events": [[dict(zip(EVENT, e, strict=True)) for e in out]]})

    def given(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame | Row]:
        """The events as the mode takes them: timed chunks come and go in frames, others in rows."""
        if self.timed:
            yield from self.frame(key, out)
        elif out:
            yield Row(stream_id=key[0], events=[dict(zip(EVENT, e, strict=True)) for e in out])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame | Row], timerValues: TimerValues) -> Iterator[pd.DataFrame | Row]:  # noqa: N802, N803
        self.load()
        ready = (c for c in self.order.ready(timed_chunks_in(rows) if self.timed else chunks_in(rows)) if c[0] >= self.discard)
        out = [e for c in ready for e in self.take(*c)]
        if self.t.idle is not None and not self.timed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.t.idle)
        self.save()
        yield from self.given(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame | Row]:  # noqa: N802, N803
        self.load()
        seq = self.order.numbers[0] - 1
        if self.timed:
            self.timer = None  # it is gone
            out = list(self.timed_out(seq, timerValues.getCurrentWatermarkInMs() * 1000, included=True))
        else:
            out = list(self.finished(seq + 1, None, ended=True))
        self.save()
        yield from self.given(key, out)

    def close(self) -> None:
        pass


EVENT = {"seq": "long", "kind": "string", "floor": "double", "trigger": "double", "power_db": "double", "i": "array<double>", "q": "array<double>", "ts": "long"}
EVENTS = f"stream_id long, events array<struct<{', '.join(f'{c}: {kind}' for c, kind in EVENT.items())}>>"


def with_state(chunks: DataFrame, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """Keyed by stream; the session keeps the state of queries that start from now on in RocksDB, which lists and maps need."""
    for key, value in STATE.items():
        chunks.sparkSession.conf.set(key, value)
    if mode == "EventTime":  # in frames, and not packed, as each chunk's own time decides whether it is too late
        return chunks.groupBy("stream_id").transformWithStateInPandas(processor, schema, "append", mode)
    return packed_chunks(chunks).groupBy("stream_id").transformWithState(processor, schema, "append", mode)


def rechunked(frames: DataFrame, size: int, most_held: int = 1000) -> DataFrame:
    """Exact chunks of ``size`` samples across frame borders; the remainder waits in the state. Frames in gaps wait for what is
    missing, ``most_held`` of them at most; then the gap is passed over."""
    return with_state(frames, Rechunker(size, most_held), "stream_id long, seq long, i array<double>, q array<double>, power_db double", "None")


def triggered(chunks: DataFrame, t: Trigger = Trigger(), late: str = "10 seconds") -> DataFrame:
    """Events of each stream: ``floor`` once it is known, then a ``capture`` for each trigger, or a ``timeout``.

    The floor is the median power of the first chunks; a chunk of at least floor + above_db (or the
    absolute level) starts a capture of the chunks before it, itself, and those after it, until the
    window is full. During a cool-down, counted in chunks or in event time, triggers are dropped; a one-shot stream
    stops after its first capture or timeout. A chunk without samples, or being idle, ends a stream: what was being
    captured is padded with zeros. State is a ring, one window and the chunks that wait for missing ones.

    Chunks with ``ts`` go by event time, and events have it too: a wait that is over by the next chunk's time, or by the watermark
    (``late`` behind the latest chunk of any stream) where a stream has fallen silent, ends in a timeout at its exact end.
    """
    timed = "ts" in chunks.columns
    if not timed and (t.timeout is not None or t.rest):
        raise ValueError("a timeout or a cool-down in seconds needs the column ts")
    rows = chunks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts")) if timed else chunks
    mode = "EventTime" if timed else "None" if t.idle is None else "ProcessingTime"
    events = with_state(rows, Capturer(t, timed), EVENTS, mode).select("stream_id", F.inline("events"))
    return events.withColumn("ts", F.timestamp_micros("ts")) if timed else events.drop("ts")


def fixed_captures(chunks: DataFrame, samples: int, discard: int = 0, most_held: int = 1000) -> DataFrame:
    """One capture of each stream, ``samples`` long, from behind the first ``discard`` chunks; padded with zeros when the stream ends before."""
    first = Trigger(floor_chunks=1, absolute_db=-math.inf, pretrigger=0, window=samples, one_shot=True, most_held=most_held)
    rows = chunks.select("stream_id", "seq", "i", "q", "power_db")
    return with_state(rows, Fixed(first, False, discard), EVENTS, "None").select("stream_id", F.inline("events")).select("stream_id", "seq", "i", "q")


class Fixed(Capturer):
    """No floor is looked for: the first chunk starts the capture."""

    def load(self) -> None:
        super().load()
        self.floor = 0.0
