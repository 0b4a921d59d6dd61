"""The features job: one row of scalars per window, one transform shared by all spectral families.

A feature that can't be computed is null; it never costs a row, and never shows an older value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spectral as sp
from .batches import batched, by_length, split_channels

EPS = 1e-12


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variance, skewness and non-excess kurtosis of rows, population forms."""
    m = x.mean(1)
    c = x - m[:, None]
    v = (c**2).mean(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return m, v, (c**3).mean(1) / v**1.5, (c**4).mean(1) / v**2


TINY = 1e-10


def bits(p: np.ndarray) -> np.ndarray:
    """Entropy in bits of rows that sum to one, or of a part of them."""
    return -(p * np.log2(p + TINY)).sum(1)


def share(x: np.ndarray) -> np.ndarray:
    return x / x.sum(1, keepdims=True)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the first and the second half of the bins."""
    return x[:, : x.shape[1] // 2].sum(1), x[:, x.shape[1] // 2 :].sum(1)


class Shared:
    """What several families of a batch use, computed when first asked for."""

    def __init__(self, x: np.ndarray):
        self.x, self.kept = x, {}

    def get(self, name: str, make: Callable[[], object]):
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    @property
    def mag(self):
        return self.get("mag", lambda: np.abs(self.x))

    @property
    def spec(self):
        return self.get("spec", lambda: np.fft.fft(self.x, axis=1))

    @property
    def power(self):
        return self.get("power", lambda: np.abs(self.spec) ** 2)

    @property
    def amp(self):
        return self.get("amp", lambda: np.abs(self.spec))

    @property
    def freqs(self):
        return np.fft.fftfreq(self.x.shape[1])

    @property
    def hilbert(self):
        return self.get("hilbert", lambda: sp.analytic(self.x.real))

    @property
    def welch(self):
        return self.get("welch", lambda: sp.welch(self.x))

    @property
    def phase(self):
        return self.get("phase", lambda: np.unwrap(np.angle(self.x), axis=1))


def power_family(s: Shared) -> dict:
    p = s.mag**2
    mean, top, rms = p.mean(1), p.max(1), np.sqrt(p.mean(1))
    return {"avg_symbol_power": mean, "papr": top / (mean + EPS), "crest_factor": s.mag.max(1) / (rms + EPS), "rms": rms, "mean_abs": s.mag.mean(1),
            "peak_to_average": s.mag.max(1) / (s.mag.mean(1) + EPS), "snr_proxy": 10 * np.log10(mean / (s.mag.var(1) + EPS) + EPS)}


def moment_family(s: Shared) -> dict:
    m, v, skew, kurt = moments(s.mag)
    c = s.mag - m[:, None]
    fifth, sixth = ((s.x - s.x.mean(1, keepdims=True)) ** 5).mean(1), (s.x**6).mean(1)
    both = lambda name, z: {name: np.abs(z), f"{name}_phase": np.angle(z)}
    return both("complex_central5", fifth) | both("complex_moment6", sixth) | {"mag_variance": v, "mag_skewness": skew, "mag_kurtosis": kurt, "mag_central4": (c**4).mean(1), "mag_central5": (c**5).mean(1), **{f"mag_raw{k}": (s.mag**k).mean(1) for k in (2, 3, 4)}}


def crossing_family(s: Shared) -> dict:
    x, n = s.x.real, s.x.shape[1]
    d = np.sign(np.diff(x, axis=1))
    return {"zero_crossing_rate": (np.diff(np.sign(x), axis=1) != 0).sum(1) / n, "temporal_peak_density": (np.diff(d, axis=1) < 0).sum(1) / n}


def phase_family(s: Shared) -> dict:
    d = np.diff(s.phase, axis=1)
    wrapped = np.diff(np.angle(s.x**4), axis=1)
    cubic, quartic = np.diff(np.angle(s.x**3), axis=1), np.angle(s.x**4)
    return {"inst_freq_std": d.std(1), "inst_freq_dev": d.std(1) / (2 * np.pi), "phase_deviation_rate": d.std(1), "frequency_variance": d.var(1),
            "phase_change_rate": wrapped.var(1), "phase_skew_cubic": moments(cubic)[2] ** 3, "phase_skew_quartic": moments(quartic)[2] ** 4, "iq_phase_variance": np.angle(s.x).var(1), "iq_phase_skewness": moments(np.angle(s.x))[2],
            "iq_phase_kurtosis": moments(np.angle(s.x))[3], "iq_freq_rms": np.sqrt((d**2).mean(1))}


def constellation_family(s: Shared) -> dict:
    cells = sp.bins_of(s.x.real, 10) * 10 + sp.bins_of(s.x.imag, 10)
    return {"constellation_density": sp.counts_of(cells, 100).var(1)}


def envelope_family(s: Shared) -> dict:
    """Envelope of the analytic signal of the real part; some of the real part's cube, or of its square less one."""
    e = np.abs(s.hilbert)
    m, v, skew, kurt = moments(e)
    cubic = np.abs(sp.analytic(s.x.real**3))
    quartiles = lambda x: np.subtract(*np.percentile(x, [75, 25], axis=1))
    return {"env_mean": m, "env_variance": v, "env_std": np.sqrt(v), "env_kurtosis": kurt, "env_rms": np.sqrt((e**2).mean(1)), "env_rms_polynomial": np.sqrt((np.abs(sp.analytic(s.x.real**2 - 1)) ** 2).mean(1)),
            "env_peak_ratio": e.max(1) / m, "env_iqr": quartiles(e), "env_iqr_cubic": quartiles(np.abs(sp.analytic(cubic))), "amplitude_asymmetry": skew, "amplitude_asymmetry_cubic": moments(cubic)[2],
            "modulation_index": v / m, "modulation_index_peak": (e.max(1) - m) / (m + TINY), "temporal_energy_variance": sp.gaussian(e, 3).var(1)}


def analytic_phase_family(s: Shared) -> dict:
    """Phase of the analytic signal of the real part, and its steps (radians a sample)."""
    ph = np.unwrap(np.angle(s.hilbert), axis=1)
    d = np.diff(ph, axis=1)
    same = np.concatenate([d, d[:, -1:]], 1) / (2 * np.pi)  # as long as the window: the last step twice
    m, v, skew, kurt = moments(ph)
    span = d.max(1) - d.min(1)
    density = sp.counts_of(sp.bins_of(d, 64), 64) / d.shape[1] / (np.where(span > 0, span, 1) / 64)[:, None] + TINY
    cubic = np.diff(np.unwrap(np.angle(sp.analytic(s.x.real**3)), axis=1), axis=1)
    e = np.abs(s.hilbert)
    ce, cp = e - e.mean(1, keepdims=True), ph - m[:, None]
    return {"aphase_mean": m, "aphase_variance": v, "aphase_std": np.sqrt(v), "aphase_skewness": skew, "aphase_kurtosis": kurt, "afreq_mean": same.mean(1), "afreq_std": same.std(1), "afreq_rms": np.sqrt((d**2).mean(1)),
            "afreq_entropy": -(density * np.log2(density)).sum(1), "afreq_rate_of_change": np.diff(d, axis=1).std(1), "afreq_modulation_rate": np.abs(np.diff(d, axis=1)).mean(1), "afreq_asymmetry": (d**3).mean(1), "afreq_asymmetry_cubic": (cubic**3).mean(1),
            "afreq_wrapped_std": np.diff(np.angle(s.hilbert), axis=1).std(1), "phase_envelope_correlation": (ce * cp).mean(1) / np.sqrt((ce**2).mean(1) * (cp**2).mean(1)), "phase_jitter": d.std(1)}


def spectrum_family(s: Shared) -> dict:
    a, p, db = s.amp, s.power, lambda x: 20 * np.log10(x)
    return {"fft_peak_index": a.argmax(1).astype(float), "fft_peak_frequency": s.freqs[a.argmax(1)], "fft_mean": a.mean(1), "fft_std": a.std(1), "fft_peak_power": p.max(1), "fft_mean_power": p.mean(1), "fft_std_power": p.std(1),
            "fft_peak_power_db": db(a.max(1)), "fft_mean_power_db": db(a.mean(1)), "fft_std_power_db": db(a.std(1)), "spectral_energy": p.sum(1), "spectral_energy_density": p.sum(1) / p.shape[1], "spectral_peak_ratio": a.max(1) / a.mean(1)}


def shape_family(s: Shared) -> dict:
    """Shape of the spectrum, with bins in the transform's own order."""
    a, p, f = s.amp, s.power, s.freqs
    n, rows = a.shape[1], np.arange(len(a))
    total = (a + TINY).sum(1)
    centroid = (f * a).sum(1) / total
    away = a - a.mean(1, keepdims=True)
    cum = np.cumsum(p, axis=1)
    roll = (cum >= 0.85 * cum[:, -1:]).argmax(1)
    wide = lambda t: f[n - 1 - (a >= t * a.max(1, keepdims=True))[:, ::-1].argmax(1)] - f[(a >= t * a.max(1, keepdims=True)).argmax(1)]
    geometric = lambda x: np.exp(np.log(x + TINY).mean(1))
    low, high = halves(p)
    pa = share(a)
    fixed = np.abs(np.fft.fft(s.x, 128, axis=1)) ** 2
    cubic, quartic = (np.abs(np.fft.fft(s.x**k, axis=1)) ** 2 for k in (3, 4))
    return {"spectral_entropy_cubic": -(share(cubic) * np.log(share(cubic) + TINY)).sum(1), "spectral_flatness_quartic": geometric(quartic) / (quartic.mean(1) + TINY), "spectral_entropy": -(share(p) * np.log(share(p) + TINY)).sum(1), "spectral_entropy_amplitude": -(pa * np.log(np.where(pa > 0, pa, 1))).sum(1), "spectral_entropy_128": bits(share(fixed)),
            "spectral_flatness": geometric(a) / a.mean(1), "spectral_flatness_power": geometric(p) / (p.mean(1) + TINY), "spectral_skewness": moments(a)[2], "spectral_kurtosis": moments(a)[3],
            "spectral_sparsity": (a < a.mean(1, keepdims=True)).sum(1), "spectral_centroid": centroid, "spectral_spread": np.sqrt((a * (f - centroid[:, None]) ** 2).sum(1) / total), "spectral_slope": (away * (f - f.mean())).sum(1) / ((f - f.mean()) ** 2 + TINY).sum(),
            "spectral_rolloff": f[roll], "rolloff_energy": cum[rows, roll], "bandwidth_quarter": wide(0.25), "bandwidth_half": wide(0.5), "spectral_asymmetry": (high - low) / (high + low + TINY), "spectral_symmetry": np.abs(low - high) / (low + high + TINY),
            "psd_kurtosis": np.abs(moments(p)[3] - 3), "high_half_entropy": bits(share(p)[:, n // 2 :]), "spectrum_zero_crossings": (np.diff(np.sign(s.spec.real), axis=1) != 0).sum(1) / n}


def energy_around(power: np.ndarray, centre: np.ndarray, width: int) -> np.ndarray:
    """Share of the energy in the bins from half a width before the centre to half a width after it."""
    k = np.arange(power.shape[1])
    near = (k >= np.maximum(0, centre - width // 2)[:, None]) & (k < np.minimum(len(k), centre + width // 2)[:, None])
    return (power * near).sum(1) / (power.sum(1) + TINY)


def band_family(s: Shared) -> dict:
    p, n = s.power, s.power.shape[1]
    return {"centre_energy_share": energy_around(p, s.amp.argmax(1), n // 8), "band_spread": p[:, int(0.1 * n) : int(0.5 * n)].sum(1) / (p.sum(1) + TINY), "high_frequency_ratio": p[:, np.abs(s.freqs) > 0.4].sum(1) / (p.sum(1) * (1 - 0.4))}


def peak_family(s: Shared) -> dict:
    out: dict[str, np.ndarray] = {}
    names = ("count", "mean", "max", "min", "energy_ratio", "width", "to_average", "kurtosis", "spacing_std", "energy", "flatness", "energy_std", "density", "range")
    n = s.amp.shape[1]
    for order in (1, 2, 3, 4):
        spec = s.amp**order
        rows, at = sp.peak_places(spec)
        total = lambda v, rows=rows: np.bincount(rows, v, len(spec))
        v, count = spec[rows, at], np.bincount(rows, minlength=len(spec))
        some, one = count > 0, np.maximum(count, 1)
        first = np.cumsum(count) - count
        mean = total(v) / one
        away = v - mean[rows]
        variance = total(away**2) / one
        step, same = np.diff(at), np.diff(rows) == 0
        between = np.bincount(rows[1:][same], step[same], len(spec)) / np.maximum(count - 1, 1)
        spacing = np.bincount(rows[1:][same], (step[same] - between[rows[1:][same]]) ** 2, len(spec)) / np.maximum(count - 1, 1)
        ends = lambda x, some=some, first=first, count=count: (x[first[some]], x[(first + count - 1)[some]])
        reach, most, least = np.zeros(len(spec)), np.zeros(len(spec)), np.zeros(len(spec))
        reach[some] = np.subtract(*ends(at)[::-1])
        most[some], least[some] = (f.reduceat(v, first[some]) if some.any() else [] for f in (np.maximum, np.minimum))
        values = (count, mean, most, least, total(v**2) / (spec**2).sum(1), total(sp.peak_widths(spec, rows, at)) / one, mean / spec.mean(1), total(away**4) / one / variance**2 - 3,
                  np.sqrt(spacing), total(v), np.exp(total(np.log(v + TINY)) / one) / (mean + TINY), np.sqrt(variance), count / n, reach)
        out |= {f"peaks{order}_{name}": np.where(some, x, 0.0) for name, x in zip(names, values, strict=True)}  # all are 0 without a peak
    loud = lambda x, least: np.bincount((p := sp.peak_places(x))[0], x[p] > least[p[0]], len(x))
    out["adaptive_peak_count"] = loud(s.amp, 1.5 * np.median(s.amp, axis=1))
    smooth = sp.gaussian(s.amp, 3)
    out["smoothed_peak_density"] = loud(smooth, 0.1 * smooth.max(1)) / n
    return out


def spread_of(f: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Standard deviation of the frequency under a density."""
    mean = (f * p).sum(1) / p.sum(1)
    return np.sqrt(((f - mean[:, None]) ** 2 * p).sum(1) / p.sum(1))


def welch_family(s: Shared) -> dict:
    """Over a density with frequencies from -0.5 to 0.5; bands are those of positive frequencies. The kernel that is named
    quadratic leaves samples as they are, so its bandwidth is the plain one."""
    f, p = s.welch
    bands = {"low": (f >= 0) & (f <= 0.25), "mid": (f >= 0.25) & (f <= 0.5), "high": (f >= 0.5) & (f <= 1)}
    out = {f"band_entropy{k}_{b}": bits(share(p[:, m] ** k)) if m.any() else np.zeros(len(p)) for k in (1, 2, 3, 4) for b, m in bands.items()}
    middle = (f >= 0.1) & (f <= 0.5)
    blocks = [sp.welch(s.x[:, i : i + 64]) for i in range(0, s.x.shape[1] - 64, 64)]
    every = np.stack([spread_of(*b) for b in blocks], 1) if blocks else np.full((len(p), 1), np.nan)
    fe, pe = sp.welch_real(np.abs(s.hilbert))
    size = len(fe) // 4
    powers = np.stack([pe[:, i * size : (i + 1) * size].sum(1) for i in range(4)], 1)
    spread = spread_of(f, p)
    modulation = np.sqrt((f**2 * p).mean(1) - (f * p).mean(1) ** 2)
    return out | {"energy_concentration": p[:, middle].sum(1), "mid_band_energy": sp.welch(s.x**2 - 1)[1][:, middle].sum(1), "frequency_spread_log": np.log(spread), "frequency_spread_cubic": np.log(spread + TINY) ** 3,
                  "modulation_bandwidth": modulation, "modulation_bandwidth_quadratic": modulation, "welch_high_ratio": p[:, f > 0.5].sum(1) / p.sum(1),
                  "centre_concentration": p[:, (f > 0.4) & (f < 0.6)].sum(1) / p.sum(1), "frequency_spread_variability": every.var(1), "envelope_power_variability": powers.var(1)}


def stft_family(s: Shared) -> dict:
    """Half-overlapping transforms of windows that are padded by half a frame of zeros at both ends.

    The concentration is that of magnitudes: complex values cancel over all frequencies of a frame.
    """
    f, z = sp.padded_stft(s.x, 128)
    p = np.abs(z) ** 2
    g, whole = sp.padded_stft(s.x, 256)
    whole = np.abs(whole)
    gauss = sp.padded_stft(sp.gaussian(s.x, 1), 128)[1]
    return {"stft_kurtosis": (p.var(2) / p.mean(2) ** 2 - 1).mean(1), "stft_energy_spread": np.abs(z).std((1, 2)), "stft_energy_spread_gaussian": np.abs(gauss).std((1, 2)), "tf_concentration": whole[:, (g >= 0.05) & (g <= 0.3)].sum((1, 2)) / whole.sum((1, 2))}


def correlation_family(s: Shared) -> dict:
    """Of the whole autocorrelation of the window, of its fourth power, and of its real part."""
    r = sp.autocorrelation(s.x)
    both = lambda x: np.concatenate([x[:, :0:-1].conj(), x], 1)
    decay = -np.gradient(np.log(r / (r[:, :1] + TINY) + TINY), axis=1)
    quartic = both(sp.autocorrelation(s.x**4))
    c = quartic - quartic.mean(1, keepdims=True)
    own = sp.autocorrelation(s.x.real).real
    return {"autocorrelation_decay": decay[:, 1:].mean(1).real, "autocorrelation_skewness": np.abs((c**3).mean(1) / (c**2).mean(1) ** 1.5), "autocorrelation_energy_variance": both(r).var(1), "digital_flag": (own / own.max(1, keepdims=True) < 0.1).any(1).astype(float)}


def wavelet_family(s: Shared) -> dict:
    one = sp.wavelet(s.x, sp.DB1_LOW, 4)
    real, four = sp.wavelet(s.x.real, sp.DB1_LOW, 4), sp.wavelet(s.x.real, sp.DB4_LOW, 4)
    total = sum(-(np.abs(c) * np.log(np.abs(c) + TINY)).sum(1) for c in one)
    power = lambda levels, k: np.mean([(np.abs(c) ** k).mean(1) for c in levels], axis=0)
    return {"wavelet_entropy": total**2, "wavelet_detail_mean": np.abs(one[-1].mean(1)), "wavelet_detail_energy": (np.abs(one[-1]) ** 2).sum(1), "wavelet_cubic": power(real, 3), "wavelet4_cubic": power(four[1:], 3), "wavelet4_quartic": power(four[1:], 4)}


def filter_family(s: Shared) -> dict:
    p = s.power
    sigma = np.clip(p.std(1) / p.mean(1), 0.1, 2)
    band = np.abs(sp.analytic(sp.band_passed(s.x.real))) if s.x.shape[1] > sp.band_reach() else np.full(s.x.shape, np.nan)
    return {"gaussian_sum": sp.gaussian(p, 1).sum(1), "adaptive_gaussian_sum": sp.gaussian_sums(p, sigma), "adaptive_bandwidth": sigma, "band_pass_rms": np.sqrt((band**2).mean(1))}


def rolling_entropy(amp: np.ndarray, size: int) -> np.ndarray:
    """Mean entropy of the spectrum in half-overlapping windows of ``size`` bins; undefined for shorter spectra."""
    if amp.shape[1] < size:
        return np.full(len(amp), np.nan)
    return np.mean([bits(share(amp[:, i : i + size])) for i in range(0, amp.shape[1] - size + 1, size // 2)], axis=0)


def rolling_family(s: Shared) -> dict:
    return {f"rolling_entropy_{size}": rolling_entropy(s.amp, size) for size in (16, 128)}


FAMILIES: dict[str, Callable[[Shared], dict]] = {
    "power": power_family, "moments": moment_family, "crossings": crossing_family, "phase": phase_family, "constellation": constellation_family, "envelope": envelope_family, "analytic_phase": analytic_phase_family,
    "spectrum": spectrum_family, "shape": shape_family, "band": band_family, "peaks": peak_family, "welch": welch_family, "stft": stft_family, "correlation": correlation_family, "wavelet": wavelet_family, "filters": filter_family, "rolling": rolling_family,
}


def register_feature(name: str, family: Callable[[Shared], dict]) -> None:
    """Adds a family: a function of a batch of complex windows, giving named arrays with a value per window."""
    FAMILIES[name] = family


def compute(x: np.ndarray, families: tuple[str, ...], kinds: dict[str, Callable[[Shared], dict]]) -> dict[str, np.ndarray]:
    """All features of windows of one length; where a family fails, only the failing windows have no values."""
    shared, out = Shared(x), {}
    for name in families:
        try:
            with np.errstate(all="ignore"):
                out |= {k: np.asarray(v, float) for k, v in kinds[name](shared).items()}
        except (ValueError, FloatingPointError, IndexError):
            for r in range(len(x) if len(x) > 1 else 0):
                for k, v in compute(x[r : r + 1], (name,), kinds).items():
                    out.setdefault(k, np.full(len(x), np.nan))[r] = v[0]
    return out


def feature_names(families: tuple[str, ...]) -> list[str]:
    probe = np.exp(1j * np.arange(64) ** 1.3 / 5)[None].repeat(2, 0)
    return list(compute(probe, families, FAMILIES))


def extract_features(windows: DataFrame, families: tuple[str, ...] | None = None, key: str = "capture_id", selected: list[str] | None = None) -> DataFrame:
    """(key, a double column per feature) from (key, iq) rows; no shuffle. Empty windows, windows with samples that are null or not finite, and undefined values give nulls."""
    families = families or tuple(FAMILIES)
    names = [n for n in feature_names(families) if selected is None or n in selected]
    kinds = {f: FAMILIES[f] for f in families}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((batch.num_rows, len(names)), np.nan)
            for rows, x in by_length(batch.column(1), batch.column(2), 2):
                sound = np.isfinite(x).all(1)
                if sound.any():
                    got = compute(x[sound], families, kinds)
                    for k, c in enumerate(names):
                        if c in got:
                            out[rows[sound], k] = got[c]
            columns = [pa.array(v, mask=~np.isfinite(v)) for v in np.ascontiguousarray(out.T)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *names])

    split = split_channels(windows, key)
    return split.mapInArrow(run, f"{key} {dict(split.dtypes)[key]}, " + ", ".join(f"{n} double" for n in names))


def long_features(wide: DataFrame, key: str = "capture_id") -> DataFrame:
    """(key, feature, value) rows."""
    return wide.unpivot([key], [c for c in wide.columns if c != key], "feature", "value")


def spectrogram_rows(windows: DataFrame, nfft: int, hop: int, bins: int, key: str = "capture_id", resize: str = "linear") -> DataFrame:
    """(key, time_bin, re, im): one row per time bin, so that rows stay small; standardised and clipped.

    ``resize``: linear interpolation of the time axis, the nearest of its places, or ``starts``: frames at evenly spaced starts.
    """

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        if resize == "starts":
            spec = sp.stft_at(x, nfft, bins)
        else:
            spec = (sp.resized_linear if resize == "linear" else sp.resized_nearest)(sp.stft(x, nfft, hop), bins)
        both = sp.clipped(spec)
        return {"time_bin": np.tile(np.arange(bins), (len(x), 1)), "re": both[..., 0].transpose(0, 2, 1), "im": both[..., 1].transpose(0, 2, 1)}

    return batched(windows, kernel, {"time_bin": "int", "re": "array<double>", "im": "array<double>"}, key)


def channel_rows(windows: DataFrame, nfft: int, bins: int, names: tuple[str, ...] = ("re", "im", "logmag", "phase"), key: str = "capture_id") -> DataFrame:
    """(key, time_bin, an array per channel): centred windows at unit power, frames at evenly spaced starts, each channel standardised over the window and clipped."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        x = x - x.mean(1, keepdims=True)
        x = x / (np.sqrt((np.abs(x) ** 2).mean(1, keepdims=True)) + 1e-6)
        out = sp.channels(sp.stft_at(x, nfft, bins) * nfft, names)
        return {"time_bin": np.tile(np.arange(bins), (len(x), 1)), **{n: out[:, k].transpose(0, 2, 1) for k, n in enumerate(names)}}

    return batched(windows, kernel, {"time_bin": "int", **{n: "array<double>" for n in names}}, key)


def spectrum_view(windows: DataFrame, key: str = "capture_id") -> DataFrame:
    """(key, bin, frequency, db): the centred spectrum of a window in dB, over normalised frequency."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        n = x.shape[1]
        f = np.fft.fftshift(np.fft.fftfreq(n))
        db = 20 * np.log10(np.abs(np.fft.fftshift(np.fft.fft(x, axis=1), axes=1)) + 1e-8)
        return {"bin": np.tile(np.arange(n), (len(x), 1)), "frequency": np.tile(f, (len(x), 1)), "db": db}

    return batched(windows, kernel, {"bin": "int", "frequency": "double", "db": "double"}, key)


def waterfall(windows: DataFrame, nfft: int, most_columns: int = 900, sample_rate: float = 20e6, key: str = "capture_id") -> DataFrame:
    """(key, column, time_ms, db, low, high): columns of a half-overlapping spectrogram in dB, and the window's 5 and 99.5 percentiles.

    Windows of under ``nfft`` samples give no row. ``waterfall_cells`` has a row per cell and the frequency axis.
    """

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        starts = np.arange(0, x.shape[1] - nfft + 1, max(1, nfft // 2))
        if len(starts) > most_columns:
            starts = starts[np.linspace(0, len(starts) - 1, most_columns).astype(int)]
        db = 20 * np.log10(np.abs(sp.spectra_at(x, nfft, starts)) + 1e-8)
        low, high = np.percentile(db.reshape(len(x), -1), [5, 99.5], axis=1)
        wide = lambda v: np.repeat(v[:, None], len(starts), 1)
        return {"column": np.tile(np.arange(len(starts)), (len(x), 1)), "time_ms": np.tile(starts / sample_rate * 1000, (len(x), 1)), "db": db, "low": wide(low), "high": wide(high)}

    return batched(windows, kernel, {"column": "int", "time_ms": "double", "db": "array<double>", "low": "double", "high": "double"}, key, nfft)


def waterfall_cells(columns: DataFrame, nfft: int, sample_rate: float = 20e6, centre_hz: float = 0.0, key: str = "capture_id") -> DataFrame:
    """(key, column, freq_bin, time_ms, frequency_mhz, db, low, high)."""
    rows = columns.select(key, "column", "time_ms", F.posexplode("db").alias("freq_bin", "db"), "low", "high")
    mhz = ((F.col("freq_bin") - nfft // 2) / F.lit(float(nfft)) * F.lit(sample_rate) + F.lit(centre_hz)) / 1e6
    return rows.select(key, "column", "freq_bin", "time_ms", mhz.alias("frequency_mhz"), "db", "low", "high")


def denoised_windows(windows: DataFrame, threshold: float = 0.1, channels: int = 1, sigma: float | None = None, key: str = "capture_id") -> DataFrame:
    """(key, i, q): each channel without its weak bins (magnitude up to threshold x deviation / channels), or, with ``sigma``, smoothed ``channels`` times by a normal kernel."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        out = []
        for part in (x.real, x.imag):
            if sigma is None:
                part = sp.denoised(part, threshold / channels)
            else:
                for _ in range(channels):
                    part = sp.gaussian(part, sigma)
            out.append(part[:, None])
        return {"i": out[0], "q": out[1]}

    return batched(windows, kernel, {"i": "array<double>", "q": "array<double>"}, key)


def seed_of(key: object) -> int:
    """A seed from an id of any kind, the same in every process."""
    return int.from_bytes(hashlib.sha1(str(key).encode()).digest()[:4], "big")


def spaced_burst_starts(windows: DataFrame, window: int, smooth: int, spacing: int, most: int = 8, key: str = "capture_id") -> DataFrame:
    """(key, view_idx, start): the strongest starts of each capture, at least ``spacing`` apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, v, s) for k, p in zip(frame[key], frame["power"], strict=True) for v, s in enumerate(sp.spaced_bursts(np.asarray(p, float), window, smooth, spacing, most, seed_of(k)))]
            yield pd.DataFrame(rows, columns=[key, "view_idx", "start"])

    power = windows.select(key, F.transform("iq", lambda s: s.i * s.i + s.q * s.q).alias("power"))
    return power.mapInPandas(run, f"{key} {dict(power.dtypes)[key]}, view_idx int, start int")


def burst_starts(windows: DataFrame, window: int, smooth: int = 512, total: bool = False, key: str = "capture_id") -> DataFrame:
    """(key, start): a window around the first largest smoothed power, inside the capture; 0 for short ones.

    Power is the mean of both channels' squares, smoothed over K samples, K an eighth of the capture at most; ``total`` takes
    the sum of the squares, and bounds K by the length. Samples stay in their rows.
    """

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        n = x.shape[1]
        centre = sp.smoothed(np.abs(x) ** 2 / (1 if total else 2), max(1, min(smooth, n if total else n // 8))).argmax(1)
        return {"start": np.clip(centre - window // 2, 0, max(0, n - window))[:, None]}

    return batched(windows, kernel, {"start": "int"}, key)


def smoothed_rows(windows: DataFrame, smooth: int, key: str = "capture_id") -> DataFrame:
    """(key, smooth): the moving mean of the power of each capture, as an array."""
    return batched(windows, lambda x: {"smooth": sp.smoothed(np.abs(x) ** 2 / 2, max(1, min(smooth, x.shape[1] // 8)))[:, None]}, {"smooth": "array<double>"}, key)


def unwrapped_rows(windows: DataFrame, key: str = "capture_id") -> DataFrame:
    """(key, phase, unwrapped): the phase of each sample, and with jumps of over pi corrected, as arrays."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        phase = np.angle(x)
        return {"phase": phase[:, None], "unwrapped": np.unwrap(phase, axis=1)[:, None]}

    return batched(windows, kernel, {"phase": "array<double>", "unwrapped": "array<double>"}, key)
