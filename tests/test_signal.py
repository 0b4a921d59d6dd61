import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.functions import features as ft
from sigspark.functions import spectral as sp
from sigspark.operators import windows as win
from sigspark.plans import QUERIES
from sigspark.sources import frames as src
from sigspark.sources import tables as tab
from sigspark.streaming import live
from sigspark.streaming.run import drained, recorded

IQ = "capture_id long, iq array<struct<i: double, q: double>>"


def captures(spark, *signals):
    return spark.createDataFrame([(k, [(float(v.real), float(v.imag)) for v in x]) for k, x in enumerate(signals)], IQ)


def test_coercion(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0], [[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]])], "flat array<double>, rows array<array<double>>")
    (r,) = df.select(win.complex_from_flat(F.col("flat")).alias("a"), win.complex_from_channels(F.col("rows")).alias("b")).collect()
    assert [tuple(s) for s in r.a] == [(1, 2), (3, 4)] and [tuple(s) for s in r.b] == [(1, 2), (3, 4), (5, 6)]
    assert src.as_complex(np.array([[1, 3, 5], [2, 4, 6]])).tolist() == [1 + 2j, 3 + 4j, 5 + 6j]
    assert src.as_complex(np.array([1 + 2j, 3 + 4j])).tolist() == [1 + 2j, 3 + 4j]


def test_burst_start(spark):
    x = np.zeros(100, complex)
    x[70:80] = 10 + 10j
    starts = {r.capture_id: r.start for r in ft.burst_starts(captures(spark, x, x[60:75]), 20, 1).collect()}
    assert 60 <= starts[0] <= 70 and starts[1] == 0


def test_smoothing_matches_numpy(spark):
    rng = np.random.default_rng(1)
    signals = [rng.normal(size=n) + 1j * rng.normal(size=n) for n in (40, 61, 7)]
    out = {r.capture_id: r.smooth for r in ft.smoothed_rows(captures(spark, *signals), 5).collect()}
    for k, x in enumerate(signals):
        size = max(1, min(5, len(x) // 8))
        want = np.convolve(np.abs(x) ** 2 / 2, np.ones(size) / size, mode="same")
        assert np.allclose(out[k], want)


def test_binary_files(spark, tmp_path):
    x = np.array([[1, 2], [3, 4]], np.float32)
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "b.npz", other=x * 0, iq=x)
    (x[:, 0] + 1j * x[:, 1]).astype(np.complex64).tofile(tmp_path / "c.c64")
    x.tofile(tmp_path / "d.iq")
    (tmp_path / "e.npy").write_bytes(b"broken")
    rows = {r.path[-5:]: r.iq for r in src.read_iq_files(spark, str(tmp_path)).collect()}
    assert rows.pop("e.npy") is None and {tuple(map(tuple, v)) for v in rows.values()} == {((1.0, 2.0), (3.0, 4.0))} and len(rows) == 4
    assert src.list_files(spark, str(tmp_path), "*.npy").count() == 2
    want = spark.createDataFrame([("a.npy",), ("zz",)], "path string")
    sums = {r.path: r.sha256 for r in src.checksums(spark, want, str(tmp_path)).collect()}
    assert sums["zz"] is None and len(sums["a.npy"]) == 64


def test_frames():
    raw = np.array([64, -128, 1, 2, 32, 0, 9, 9, 7], np.int8).tobytes()
    assert src.decode_frame(raw, "cs8", 2).tolist() == [0.5 - 1j, 0.25 + 0j]
    assert src.decode_frame(np.array([16384, -32768], "<i2").tobytes() + b"x", "cs16").tolist() == [0.5 - 1j]
    assert src.decode_frame(None, "cf32").tolist() == []
    with pytest.raises(ValueError, match="unknown"):
        src.decode_frame(b"", "cu8")


def test_spectrogram_shape(spark):
    rng = np.random.default_rng(7)
    out = ft.spectrogram_rows(captures(spark, rng.normal(size=128) + 1j * rng.normal(size=128)), 32, 16, 8).collect()
    both = np.array([[r.re, r.im] for r in sorted(out, key=lambda r: r.time_bin)])
    assert both.shape == (8, 2, 32) and np.isfinite(both).all()


def test_kernels():
    t = np.arange(64)
    x = np.cos(2 * np.pi * 4 * t / 64)[None]
    assert np.allclose(sp.analytic(x), np.exp(2j * np.pi * 4 * t / 64))
    assert np.allclose(sp.autocorrelation(x)[0], [sum(x[0, k:] * x[0, : 64 - k]) for k in range(64)])
    f, p = sp.welch(np.exp(2j * np.pi * t / 8)[None])
    assert f[p[0].argmax()] == pytest.approx(1 / 8)
    a, d = sp.wavelet(x, sp.DB1_LOW, 1)
    assert np.allclose(a[0], (x[0, ::2] + x[0, 1::2]) / 2**0.5) and np.allclose((a**2).sum() + (d**2).sum(), (x**2).sum())
    assert np.allclose(sum(sp.DB4_LOW), 2**0.5) and np.isclose(sum(v * v for v in sp.DB4_LOW), 1)
    assert sp.peaks(np.array([0, 2, 1, 3, 3, 3, 0, 1])).tolist() == [1, 4]
    assert sp.half_widths(np.array([0.0, 1, 2, 1, 0]), np.array([2])).tolist() == [2.0]
    inside, outside = (np.abs(sp.band_passed(np.cos(np.pi * w * np.arange(400))[None]))[0, 100:-100].max() for w in (0.3, 0.95))
    assert inside > 0.9 and outside < 0.01
    assert sp.resized_linear(np.arange(5.0), 9).tolist() == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4]
    assert sp.resized_nearest(np.arange(3.0), 5).tolist() == [0, 1, 2, 2, 2]
    assert np.allclose(sp.denoised(np.cos(2 * np.pi * t / 8)[None], 0.5), np.cos(2 * np.pi * t / 8))
    assert np.allclose(sp.gaussian(np.ones((1, 9)), 2), 1)
    starts = sp.spaced_bursts(np.r_[np.zeros(50), np.ones(5) * 9, np.zeros(50), np.ones(5), np.zeros(50)], 10, 3, 20, 2, 1)
    assert abs(starts[0] - 47) <= 3 and abs(starts[1] - 102) <= 3


def test_band_pass_against_a_plain_loop():
    b, a = sp.butterworth_band(4, 0.1, 0.6)
    at = lambda w: abs(np.polyval(b, np.exp(1j * np.pi * w)) / np.polyval(a, np.exp(1j * np.pi * w)))
    middle = 2 / np.pi * np.arctan(np.sqrt(np.tan(0.05 * np.pi) * np.tan(0.3 * np.pi)))
    assert [at(w) for w in (0.1, 0.6, middle, 0.0, 1.0)] == pytest.approx([0.5**0.5, 0.5**0.5, 1, 0, 0], abs=1e-9)
    x = np.random.default_rng(2).normal(size=60)

    def once(v):  # the long way: a constant run-in instead of a steady state
        v = np.r_[np.full(3000, v[0]), v]
        y = np.zeros(len(v))
        for t in range(len(v)):
            y[t] = sum(b[k] * v[t - k] for k in range(9) if t >= k) - sum(a[k] * y[t - k] for k in range(1, 9) if t >= k)
        return y[3000:]

    long = np.r_[2 * x[0] - x[27:0:-1], x, 2 * x[-1] - x[-2:-29:-1]]
    assert np.allclose(sp.band_passed(x[None])[0], once(once(long)[::-1])[::-1][27:-27], atol=1e-6)
    with pytest.raises(ValueError, match="too few"):
        sp.band_passed(np.zeros((1, 20)))


def test_features_survive_bad_windows(spark):
    df = captures(spark, np.exp(1j * np.arange(64)), np.zeros(64), np.array([]))
    out = {r.capture_id: r for r in ft.extract_features(df).collect()}
    assert len(out) == 3 and out[0].papr == pytest.approx(1) and out[1].mag_skewness is None and out[2].rms is None
    ft.register_feature("own", lambda s: {"own_first": s.x.real[:, 0]})
    try:
        assert [r.own_first for r in ft.extract_features(df, ("own",)).orderBy("capture_id").collect()] == [1.0, 0.0, None]
    finally:
        del ft.FAMILIES["own"]
    assert ft.long_features(ft.extract_features(df, ("power",))).count() == 3 * 7


def test_one_bad_window_costs_no_other(spark):
    good = [np.exp(1j * np.arange(64) ** 1.3 / k) for k in (3, 5)]
    bad = [np.where(np.arange(64) == 9, v, good[0]) for v in (np.nan, np.inf)]
    alone = {r.capture_id: r for r in ft.extract_features(captures(spark, *good)).coalesce(1).collect()}
    out = {r.capture_id: r for r in ft.extract_features(captures(spark, *good, *bad).coalesce(1)).collect()}
    for k in (0, 1):
        assert [v if v is not None else -1 for v in out[k]] == pytest.approx([v if v is not None else -1 for v in alone[k]])
    assert out[0].constellation_density is not None and out[0].afreq_entropy is not None
    assert set(out[2][1:]) == set(out[3][1:]) == {None}

    def picky(s):
        if (s.x.real[:, 0] > 1.5).any():
            raise ValueError
        return {"own": s.x.real[:, 0]}

    assert ft.compute(np.array([[1 + 0j, 0], [2, 0], [0, 1]]), ("own",), {"own": picky})["own"] == pytest.approx([1, np.nan, 0], nan_ok=True)


def test_augmentation(spark):
    df = captures(spark, np.exp(1j * np.arange(2000)))
    out = {r["copy"]: np.array([complex(s.i, s.q) for s in r.iq]) for r in win.augmented(df, 2, 5, 0.01).collect()}
    noise = out[1] - out[0]
    assert np.allclose(out[0], np.exp(1j * np.arange(2000))) and 0.009 < noise.real.std() < 0.011 and not np.allclose(out[1], out[2])
    assert win.progressively_augmented(df, 10, 10, 5).count() == 1


def test_augmented_copies_differ_and_are_near(spark, tmp_path):
    """The first sample of a copy of 2941 rounds to the original's; one of 36864414 is 6.2 deviations away."""
    rows = [(k, [0.0] * 64, 1) for k in (2941, 36_864_414)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = sorted(map(tuple, QUERIES["arr19_augmented"](spark, str(tmp_path)).collect()))
    assert out == [(k, c, c == 0, True) for k, _, _ in rows for c in range(3)]


def test_text_sources_and_cache(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,q\n1,2\n3.5,-4\n")
    assert [(r.i, r.q) for r in tab.read_numeric_text(spark, str(tmp_path / "a.csv")).orderBy("line_no").collect()] == [(1, 2), (3.5, -4)]
    with pytest.raises(ValueError, match="missing: z"):
        tab.read_csv(spark, str(tmp_path / "a.csv"), "i double, q double", ("i", "z"))
    (tmp_path / "m.json").write_text('[{"dataset": "d", "accuracy": 0.5}]')
    assert tab.read_metrics(spark, str(tmp_path / "m.json"), str(tmp_path / "none.json")).count() == 1
    (tmp_path / "c.xml").write_text("<r><Clip><drone>x</drone><center_mhz>2440</center_mhz></Clip></r>")
    assert [(r.drone, r.center_mhz) for r in tab.read_clip_metadata(spark, str(tmp_path / "c.xml")).collect()] == [("x", 2440)]
    tab.write_csv(spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double"), str(tmp_path / "out"))
    assert "".join(sorted(p.read_text() for p in (tmp_path / "out").glob("*.csv"))).replace("a,b\n", "") in ("1,0.500000\n2,\n", '1,0.500000\n2,""\n')
    calls = []

    def compute(new):
        calls.append(new.count())
        return new.withColumn("v", F.col("k") * 2)

    keys = spark.range(4).select(F.col("id").alias("k"))
    assert tab.cached(keys.limit(3), "k", str(tmp_path / "cache"), compute).count() == 3
    assert tab.cached(keys, "k", str(tmp_path / "cache"), compute).count() == 4 and calls == [3, 1]


def test_streams_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = []
    for stream in (1, 2):
        for seq in range(40):
            loud = 3.0 if seq in (25, 31) else 0.1
            rows.append((stream, seq, (rng.normal(size=4) * loud).tolist(), (rng.normal(size=4) * loud).tolist()))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    frames = spark.createDataFrame([(s, n, i, q, live.power_of(np.array(i), np.array(q))) for s, n, i, q in rows], live.CHUNKS)
    t = live.Trigger(floor_chunks=10, above_db=10, pretrigger=1, window=12, cooldown=2)
    out = drained(live.triggered(recorded(frames, files=5, files_per_batch=1), t)).collect()
    assert sorted((r.stream_id, r.seq, r.kind) for r in out) == [(s, n, k) for s in (1, 2) for n, k in ((9, "floor"), (25, "capture"), (31, "capture"))]
    known = {(s, n): i for s, n, i, _ in rows}
    for r in out:
        if r.kind == "capture":
            assert r.i == [v for n in (r.seq - 1, r.seq, r.seq + 1) for v in known[r.stream_id, n]]
    chunks = drained(live.rechunked(recorded(frames.select("stream_id", "seq", "i", "q"), files=4, files_per_batch=1), 7)).collect()
    for s in (1, 2):
        whole = [v for n in range(40) for v in known[s, n]]
        assert [v for r in sorted(chunks, key=lambda r: r.seq) if r.stream_id == s for v in r.i] == whole[: 160 // 7 * 7]


def test_ends_timeouts_and_gaps(spark):
    """A stream's end pads, waiting times out, a round recalibrates, and a missing chunk is given up."""

    def run(levels, t, drop=()):
        rows = [(1, n, [v] if v is not None else [], [0.0] if v is not None else [], -120.0 if v is None else 10 * np.log10(v * v)) for n, v in enumerate(levels) if n not in drop]
        frames = spark.createDataFrame([(s, n, i, q, float(d)) for s, n, i, q, d in rows], live.CHUNKS)
        return [(r.seq, r.kind, r.i) for r in sorted(drained(live.triggered(recorded(frames), t)).collect(), key=lambda r: (r.seq, r.kind))]

    quiet, loud = 0.1, 3.0
    t = live.Trigger(floor_chunks=3, above_db=10, pretrigger=1, window=4)
    assert run([quiet] * 4 + [loud, None], t) == [(2, "floor", None), (4, "capture", [quiet, loud, 0, 0])]
    assert [e[:2] for e in run([quiet] * 9, live.Trigger(floor_chunks=3, above_db=10, timeout_chunks=2, one_shot=True))] == [(2, "floor"), (4, "timeout")]
    again = live.Trigger(floor_chunks=2, above_db=10, pretrigger=0, window=1, recalibrate=True)
    assert [e[:2] for e in run([quiet, quiet, loud, loud, loud, loud, 100.0], again)] == [(1, "floor"), (2, "capture"), (4, "floor"), (6, "capture")]
    assert [e[:2] for e in run([quiet] * 5 + [loud] * 3, live.Trigger(floor_chunks=2, above_db=10, pretrigger=0, window=1, most_held=2), drop=(1,))] == [(2, "floor"), (5, "capture"), (6, "capture"), (7, "capture")]
    rows = [(1, n, [float(n)] * 2, [0.0] * 2, 0.0) for n in range(4)] + [(1, 4, [], [], -120.0)]
    (r,) = drained(live.fixed_captures(recorded(spark.createDataFrame(rows, live.CHUNKS)), 7, 1)).collect()
    assert r.seq == 1 and r.i == [1, 1, 2, 2, 3, 3, 0]
    frames = spark.createDataFrame([(1, n, [float(n)] * 2, [0.0] * 2) for n in (0, 2, 3, 4)], "stream_id long, seq long, i array<double>, q array<double>")
    assert [r.i for r in drained(live.rechunked(recorded(frames), 4, most_held=2)).orderBy("seq").collect()] == [[0, 0, 2, 2], [3, 3, 4, 4]]


def test_json_sink(spark, tmp_path):
    events = recorded(spark.createDataFrame([(1, "a"), (2, "b")], "id int, kind string"))
    live.json_sink(events, str(tmp_path / "j"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert live.skipped(spark.range(5).withColumnRenamed("id", "seq"), 3).count() == 2
