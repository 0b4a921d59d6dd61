"""Kernels that take all rows of a batch together, against loops over rows, values and samples."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from sigspark.functions import features as ft
from sigspark.functions import spectral as sp

ROWS = arrays(float, st.tuples(st.integers(1, 4), st.integers(3, 40)), elements=st.integers(0, 6).map(float))


def plain_peaks(x):
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if j < len(x) - 1 and x[i - 1] < x[i] > x[j + 1]:
            out.append((i + j) // 2)
        i = j + 1
    return out


def plain_width(x, p):
    bases = []
    for step in (-1, 1):
        k, low = p, x[p]
        while 0 <= k < len(x) and x[k] <= x[p]:
            low = min(low, x[k])
            k += step
        bases.append(low)
    level, ends = x[p] - (x[p] - max(bases)) / 2, []
    for step in (-1, 1):
        k = p
        while 0 < k < len(x) - 1 and x[k] > level:
            k += step
        ends.append(k - step * (level - x[k]) / (x[k - step] - x[k]) if x[k] < level and k != p else float(k))
    return ends[1] - ends[0]


@settings(max_examples=200, deadline=None)
@given(ROWS, st.sampled_from([8, 1 << 18]))
def test_peaks_and_widths(x, most):
    rows, at = sp.peak_places(x)
    want = [(r, p) for r, row in enumerate(x) for p in plain_peaks(row)]
    assert list(zip(rows.tolist(), at.tolist(), strict=True)) == want
    assert np.allclose(sp.peak_widths(x, rows, at, most), [plain_width(x[r], p) for r, p in want])


@settings(max_examples=100, deadline=None)
@given(arrays(float, st.tuples(st.integers(1, 4), st.integers(2, 50)), elements=st.floats(-5, 5, width=32)))
def test_histograms(x):
    for bins in (10, 64):
        assert (sp.counts_of(sp.bins_of(x, bins), bins) == [np.histogram(r, bins)[0] for r in x]).all()


def test_families_equal_row_by_row():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 96)) + 1j * rng.normal(size=(40, 96))
    x[3] = 0.25
    x[5, 10:] = 0
    with np.errstate(all="ignore"):
        whole = {k: v for f in ("constellation", "analytic_phase", "peaks", "filters", "moments", "shape", "welch") for k, v in ft.FAMILIES[f](ft.Shared(x)).items()}
        for r in range(len(x)):
            one = {k: v for f in ("constellation", "analytic_phase", "peaks", "filters", "moments", "shape", "welch") for k, v in ft.FAMILIES[f](ft.Shared(x[r : r + 1])).items()}
            for k, v in one.items():
                assert np.allclose(whole[k][r], v[0], rtol=1e-8, atol=1e-9, equal_nan=True), (k, r)


def test_values_by_their_definitions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 64)) + 1j * rng.normal(size=(6, 64))
    s = ft.Shared(x)
    out = ft.constellation_family(s) | ft.filter_family(s) | ft.moment_family(s) | ft.shape_family(s) | ft.peak_family(s) | ft.welch_family(s)
    for r, row in enumerate(x):
        assert out["constellation_density"][r] == np.histogram2d(row.real, row.imag, bins=10)[0].var()
        power = np.abs(np.fft.fft(row)) ** 2
        sigma = np.clip(power.std() / power.mean(), 0.1, 2)
        assert np.isclose(out["adaptive_gaussian_sum"][r], sp.gaussian(power[None], sigma).sum())
        fifth = np.mean((row - row.mean()) ** 5)
        assert np.isclose(out["complex_central5"][r], abs(fifth)) and np.isclose(out["complex_central5_phase"][r], np.angle(fifth))
        assert np.isclose(out["complex_moment6"][r], abs(np.mean(row**6)))
        cubic = np.abs(np.fft.fft(row**3)) ** 2
        cubic /= cubic.sum()
        assert np.isclose(out["spectral_entropy_cubic"][r], -np.sum(cubic * np.log(cubic + 1e-10)))
        for order in (1, 3):
            spec = np.abs(np.fft.fft(row)) ** order
            at = plain_peaks(spec)
            v = spec[at]
            want = {"count": len(at), "mean": v.mean(), "max": v.max(), "min": v.min(), "std": v.std(), "width": np.mean([plain_width(spec, p) for p in at]), "spacing": np.diff(at).std(), "range": at[-1] - at[0], "kurtosis": np.mean((v - v.mean()) ** 4) / v.var() ** 2 - 3}
            for name, column in (("count", "count"), ("mean", "mean"), ("max", "max"), ("min", "min"), ("std", "energy_std"), ("width", "width"), ("spacing", "spacing_std"), ("range", "range"), ("kurtosis", "kurtosis")):
                assert np.isclose(out[f"peaks{order}_{column}"][r], want[name]), (name, order)
    assert (out["modulation_bandwidth_quadratic"] == out["modulation_bandwidth"]).all()
