"""Captures longer than a row, as blocks and as byte ranges of files, against whole arrays."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigspark.functions import features as ft
from sigspark.operators import blocks as blk
from sigspark.plans import tables
from sigspark.sources import ranges as rng
from sigspark.streaming.run import drained

LENGTHS = {1: 1000, 2: 37, 3: 128, 4: 1}


@pytest.fixture(scope="module")
def signals():
    random = np.random.default_rng(5)
    out = {k: random.normal(size=n) + 1j * random.normal(size=n) for k, n in LENGTHS.items()}
    out[1][495:520] *= 6  # a burst across a block's border
    return {k: x.astype(np.complex64).astype(complex) for k, x in out.items()}


@pytest.fixture(scope="module")
def captures(spark, signals):
    rows = [(k, [(float(v.real), float(v.imag)) for v in x]) for k, x in signals.items()]
    return spark.createDataFrame(rows, "capture_id long, iq array<struct<i: double, q: double>>")


def values(iq):
    return np.array([s.i + 1j * s.q for s in iq])


@pytest.mark.parametrize("before, after", [(0, 0), (5, 3), (150, 70)])
def test_halo(captures, signals, before, after):
    rows = blk.with_halo(blk.cut_blocks(captures, 64), 64, before, after).collect()
    assert len(rows) == sum(-(-n // 64) for n in LENGTHS.values())
    for r in rows:
        x, low = signals[r.capture_id], r.block * 64
        first = max(0, low - before)
        assert r.first == first and r.own == min(64, len(x) - low)
        assert (values(r.iq) == x[first : low + r.own + after]).all()


@pytest.mark.parametrize("size", [8, 64, 5000])
def test_windows_over_blocks(spark, captures, signals, size):
    rows = [(1, 0, 10, 30), (1, 1, 60, 200), (1, 2, 990, 50), (1, 3, 2000, 5), (2, 0, 0, 37), (2, 0, 0, 37), (4, 0, 0, 3), (9, 0, 0, 3), (1, 4, 5, 0)]
    windows = spark.createDataFrame(rows, "capture_id long, view int, start long, length long")
    out = blk.windows_over_blocks(blk.cut_blocks(captures, size), windows, size).collect()
    want = [(k, v, s, n) for k, v, s, n in rows if k in signals and len(signals[k][s : s + n])]
    assert sorted((r.capture_id, r.view, r.start, r.length) for r in out) == sorted(want)
    assert all((values(r.iq) == signals[r.capture_id][r.start : r.start + r.length]).all() for r in out)


def test_bursts_equal_those_of_whole_rows(captures):
    for window, smooth in ((100, 16), (20, 512), (30, 1)):
        whole = {(r.capture_id, r.start) for r in ft.burst_starts(captures, window, smooth).collect()}
        blocks = blk.cut_blocks(captures, 64)
        halo = blk.with_halo(blocks, 64, smooth // 2, (smooth - 1) // 2).join(blk.lengths(blocks, 64), "capture_id")
        assert {(r.capture_id, r.start) for r in blk.burst_starts_over_blocks(halo, 64, window, smooth).collect()} == whole


def test_frames_over_blocks(captures, signals):
    out = blk.frames_over_blocks(blk.with_halo(blk.cut_blocks(captures, 16), 16, 0, 39), 16, 40, 25).collect()
    want = {(k, s) for k, x in signals.items() for s in range(0, len(x) - 39, 25)}
    assert {(r.capture_id, r.start) for r in out} == want and len(out) == len(want)
    assert all((values(r.iq) == signals[r.capture_id][r.start : r.start + 40]).all() for r in out)


@pytest.mark.parametrize("nfft, hop, bins", [(16, 8, 20), (100, 30, 5), (40, 1, 1)])
def test_spectrograms_equal_those_of_whole_rows(captures, nfft, hop, bins):
    one = {(r.capture_id, r.time_bin): (r.re, r.im) for r in ft.spectrogram_rows(captures, nfft, hop, bins).collect()}
    out = {(r.capture_id, r.time_bin): (r.re, r.im) for r in blk.spectrogram_over_blocks(blk.cut_blocks(captures, 32), 32, nfft, hop, bins).collect()}
    assert out.keys() == one.keys()
    assert all(np.allclose(out[k], one[k], atol=1e-7) for k in one)


@pytest.fixture(scope="module")
def folder(tmp_path_factory, signals):
    top = tmp_path_factory.mktemp("iq (a+b)")
    for k, x in signals.items():
        (top / f"{k}.c64").write_bytes(x.astype("<c8").tobytes() + b"abc")  # with an incomplete sample
    (top / "0.c64").write_bytes(b"")
    (top / ".hidden.c64").write_bytes(b"12345678")
    (top / "other.txt").write_bytes(b"12345678" * 9)
    return str(top)


def test_ranges(spark, folder, signals):
    rows = rng.read_blocks(spark, folder, block=100, before=7, after=3, rangeBytes=1600, pattern="*.c64")
    assert rows.rdd.getNumPartitions() > len(LENGTHS)  # several tasks read the long file
    for r in rows.collect():
        x, low = signals[int(r.path[0])], r.block * 100
        assert r.samples == len(x) and r.first == max(0, low - 7) and r.own == min(100, len(x) - low)
        assert (values(r.iq) == x[r.first : low + r.own + 3]).all()
    assert rows.count() == sum(-(-n // 100) for n in LENGTHS.values())


def test_ranges_by_filters_and_columns(spark, folder):
    rows = rng.read_blocks(spark, folder, "path", "block", block=100, pattern="*.c64")
    picked = rows.filter((F.col("path") == "1.c64") & (F.col("block") >= 3) & (F.col("block") < 6))
    assert sorted(map(tuple, picked.collect())) == [("1.c64", b) for b in (3, 4, 5)]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert " Filter (" not in plan
    assert {r.path for r in rows.filter("path like '%.c64' and path in ('2.c64', '3.c64', 'x')").collect()} == {"2.c64", "3.c64"}
    assert rows.filter("path = 'none'").collect() == []


def test_other_formats(spark, tmp_path):
    x = np.array([[-32768, 16384], [5, -7]], "<i2")
    (tmp_path / "a.iq").write_bytes(x.tobytes())
    for kind, scale in (("cs16", 32768.0), ("int16", 1.0)):
        (r,) = rng.read_blocks(spark, str(tmp_path), format=kind).collect()
        assert values(r.iq).tolist() == [complex(*(v / scale)) for v in x.astype(float)]
    with pytest.raises(Exception, match="unknown IQ format"):
        rng.read_blocks(spark, str(tmp_path), format="x").collect()


def test_stream_of_a_growing_file(spark, tmp_path):
    """A block comes when it is whole, after a restart too."""
    x = np.arange(40, dtype="<c8")
    (tmp_path / "in").mkdir()

    def run():
        query = rng.stream_blocks(spark, str(tmp_path / "in"), block=8).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.block, [int(s.i) for s in r.iq]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in/a.c64").write_bytes(x[:20].tobytes())
    assert run() == [(b, list(range(8 * b, 8 * b + 8))) for b in range(2)]
    (tmp_path / "in/a.c64").write_bytes(x.tobytes())
    assert run() == [(b, list(range(8 * b, 8 * b + 8))) for b in range(5)]


def test_replay_goes_round(spark, tmp_path, folder, signals):
    """As often as wanted, numbered through; a query that stopped after two rounds goes on with the third."""

    def run(rounds):
        stream = rng.replayed_chunks(spark, folder, block=300, pattern="*.c64", rounds=rounds)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.seq)

    one = [(f"{k}.c64", s) for k, x in signals.items() for s in range(0, len(x), 300)]
    assert [(r.path, r.first) for r in run(2)] == one * 2
    out = run(3)
    assert [(r.path, r.first) for r in out] == one * 3 and [r.seq for r in out] == list(range(3 * len(one)))
    assert all((values(r.iq) == signals[int(r.path[0])][r.first : r.first + 300]).all() for r in out)


def test_replay_by_the_clock(spark, folder):
    clock = rng.ReplayReader(rng.Layout.of({"path": folder, "block": 300, "pattern": "*.c64"}), {"rate": 1000, "started": 0}, ["seq"])
    assert clock.latestOffset()["chunk"] > 10**9  # endless
    with pytest.raises(ValueError, match="needs a rate"):
        rng.ReplayReader(rng.Layout.of({"path": folder}), {}, ["seq"])


def test_written_captures(spark, captures, signals, tmp_path):
    blocks = blk.cut_blocks(captures, 64).withColumn("name", F.concat("capture_id", F.lit(".c64")))
    assert rng.write_captures(blocks, str(tmp_path / "iq"), "name", "block") == len(LENGTHS)
    for k, x in signals.items():
        assert (np.frombuffer((tmp_path / "iq" / f"{k}.c64").read_bytes(), "<c8") == x).all()


def test_blocks_of_a_file_are_written_together():
    """What follows in a batch is one write, but for a new file, or over SAMPLES."""
    rows = [("a", [(1.0, 2.0)] * 3), ("a", None), ("a", [(1.0, 2.0)] * 5), ("b", []), ("b", [(0.0, 1.0)] * 2)]
    batch = pa.RecordBatch.from_pydict({"name": [n for n, _ in rows], "order": list(range(5)), "iq": pa.array([x and [{"i": i, "q": q} for i, q in x] for _, x in rows], pa.list_(rng.SAMPLE))})
    assert list(rng.stretches(batch)) == [("a", 0, 3), ("b", 3, 5)]
    long = pa.RecordBatch.from_pydict({"name": ["a"] * 5, "order": list(range(5)), "iq": pa.array([[{"i": 0.0, "q": 0.0}] * (rng.SAMPLES // 2)] * 5, pa.list_(rng.SAMPLE))})
    assert list(rng.stretches(long)) == [("a", 0, 2), ("a", 2, 4), ("a", 4, 5)]
    assert list(rng.stretches(batch.slice(0, 0))) == []


def test_samples_of_a_vector_are_taken_once(spark, tmp_path):
    """No cast of the whole vector for each of its samples."""
    rows = [(1, [0.5, 1.5, 2.5, 3.5], 4), (2, [1.0, None, 3.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = tables.captures(spark, str(tmp_path)).select("capture_id", "iq")
    assert {r.capture_id: [tuple(s) for s in r.iq] for r in out.collect()} == {1: [(0.5, 1.5), (2.5, 3.5)], 2: [(1.0, None)]}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1


@pytest.fixture(scope="module")
def small_ranges(tmp_path_factory):
    """Two files of 1,000 blocks of 64 samples, each block a range."""
    top = tmp_path_factory.mktemp("small")
    x = np.arange(2 * 64_000, dtype="<i2").reshape(-1, 2)
    for name in ("a.iq", "b.iq"):
        (top / name).write_bytes(x.tobytes())
    return str(top), {"path": str(top), "format": "int16", "block": 64, "rangebytes": 256}, x[:, 0] + 1j * x[:, 1]


def test_small_ranges_share_tasks(spark, small_ranges):
    folder, _, x = small_ranges
    rows = rng.read_blocks(spark, folder, format="int16", block=64, rangeBytes=256)
    assert rows.rdd.getNumPartitions() <= 256
    out = sorted(rows.collect(), key=lambda r: (r.path, r.block))
    assert [(r.path, r.block, r.first, r.own) for r in out] == [(name, b, 64 * b, 64) for name in ("a.iq", "b.iq") for b in range(1000)]
    assert all((values(r.iq) == x[r.first : r.first + 64]).all() for r in out)


def test_batches_hold_several_blocks(small_ranges):
    """With halos, over the borders of what is read together too."""
    _, options, x = small_ranges
    layout = rng.Layout.of({**options, "rangebytes": 1 << 20, "before": 5, "after": 9, "block": 3000})
    reader = rng.RangeReader(layout, ["path", "block", "first", "iq"])
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(batches) <= 2 and sum(b.num_rows for b in batches) == 44
    for path, block, first, iq in zip(*(sum((b.column(c).to_pylist() for b in batches), []) for c in range(4)), strict=True):
        assert path in ("a.iq", "b.iq") and first == max(0, 3000 * block - 5)
        assert [complex(s["i"], s["q"]) for s in iq] == x[first : 3000 * (block + 1) + 9].tolist()


def test_small_ranges_of_streams_share_tasks(small_ranges, monkeypatch):
    """All blocks once and in order, after some were read too; a task of a replay gets its files and doesn't list the folder."""
    _, options, _ = small_ranges
    growing = rng.GrowingReader(rng.Layout.of(options), ["path", "block"])
    replay = rng.ReplayReader(rng.Layout.of(options), {"rounds": "3"}, ["path", "round", "seq", "first"])
    cut, end = {"a.iq": 10}, growing.latestOffset()
    tasks, rounds = growing.partitions(cut, end), replay.partitions({"chunk": 1500}, replay.latestOffset())
    assert len(tasks) <= 256 and len(rounds) <= 256
    monkeypatch.setattr(rng.Layout, "files", None)
    rows = lambda reader, parts: [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert rows(growing, tasks) == [(f, b) for f in ("a.iq", "b.iq") for b in range(1000) if b >= cut.get(f, 0)]
    assert rows(replay, rounds) == [("ab"[n // 1000 % 2] + ".iq", n // 2000, n, 64 * (n % 1000)) for n in range(1500, 6000)]


def test_bursts_read_their_blocks_once(spark, small_ranges):
    halo = rng.read_blocks(spark, small_ranges[0], block=70, before=8, after=7).withColumnRenamed("path", "capture_id")
    bursts = blk.burst_starts_over_blocks(halo, 70, 100, 16)
    assert bursts._jdf.queryExecution().optimizedPlan().toString().count("iq_ranges") == 1
