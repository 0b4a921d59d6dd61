"""Vectorised numpy kernels over batches of windows: rows are windows, columns samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal of real rows."""
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1)


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Row x frame x sample; one zero-padded frame for short rows."""
    if x.shape[1] < size:
        x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop]


def stft(x: np.ndarray, nfft: int, hop: int) -> np.ndarray:
    """Row x frequency x time: symmetric Hann window, centred spectrum, divided by nfft."""
    spec = np.fft.fft(frames(x, nfft, hop) * np.hanning(nfft), axis=2)
    return np.fft.fftshift(spec, axes=2).transpose(0, 2, 1) / nfft


def spectra_at(x: np.ndarray, nfft: int, starts: np.ndarray) -> np.ndarray:
    """Row x frame x frequency: symmetric Hann window, centred spectrum, at the given starts."""
    seg = x[:, starts[:, None] + np.arange(nfft)] * np.hanning(nfft)
    return np.fft.fftshift(np.fft.fft(seg, axis=2), axes=2)


def stft_at(x: np.ndarray, nfft: int, bins: int) -> np.ndarray:
    """The same as ``stft``, at ``bins`` evenly spaced starts (whole parts)."""
    x = np.pad(x, ((0, 0), (0, max(0, nfft - x.shape[1]))))
    return spectra_at(x, nfft, np.linspace(0, x.shape[1] - nfft, bins).astype(int)).transpose(0, 2, 1) / nfft


def smoothed(x: np.ndarray, k: int) -> np.ndarray:
    """Moving mean over ``k`` samples, those from k // 2 before on; zeros beyond the ends."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (k // 2, (k - 1) // 2))), k, axis=1).sum(2) / k


def resized_linear(spec: np.ndarray, bins: int) -> np.ndarray:
    """Time axis (the last) to ``bins`` by linear interpolation."""
    n = spec.shape[-1]
    if n == bins:
        return spec
    at = np.linspace(0, n - 1, bins)
    low = np.minimum(at.astype(int), n - 1)
    high = np.minimum(low + 1, n - 1)
    part = at - low
    return spec[..., low] * (1 - part) + spec[..., high] * part


def resized_nearest(spec: np.ndarray, bins: int) -> np.ndarray:
    """Time axis by the nearest of evenly spaced places; short ones repeat their last column."""
    n = spec.shape[-1]
    if n >= bins:
        return spec[..., np.round(np.linspace(0, n - 1, bins)).astype(int)]
    return spec[..., np.minimum(np.arange(bins), n - 1)]


def clipped(spec: np.ndarray, limit: float = 6.0) -> np.ndarray:
    """By the standard deviation of each row's real and imaginary parts together, clipped."""
    both = np.stack([spec.real, spec.imag], -1)
    scale = both.reshape(len(both), -1).std(1) + 1e-6
    return np.clip(both / scale.reshape(-1, *[1] * (both.ndim - 1)), -limit, limit)


def channels(spec: np.ndarray, names: tuple[str, ...] = ("re", "im", "logmag", "phase"), limit: float = 6.0) -> np.ndarray:
    """Row x channel x frequency x time, each channel standardised per row and clipped."""
    kinds = {"logmag": lambda s: np.log1p(np.abs(s)), "re": np.real, "im": np.imag, "phase": lambda s: np.angle(s) / np.pi}
    out = np.stack([kinds[k](spec) for k in names], 1)
    mean, std = out.mean((2, 3), keepdims=True), out.std((2, 3), keepdims=True)
    return np.clip((out - mean) / (std + 1e-6), -limit, limit)


def welch(x: np.ndarray, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and density: periodic Hann, half overlap, constant detrend, all frequencies of complex rows."""
    n = min(most, x.shape[1])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    seg = frames(x, n, n - n // 2)
    seg = (seg - seg.mean(2, keepdims=True)) * w
    return np.fft.fftfreq(n), (np.abs(np.fft.fft(seg, axis=2)) ** 2).mean(1) / (w * w).sum()


def welch_real(x: np.ndarray, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The same for real rows: frequencies from 0 on, with the density of both signs."""
    f, p = welch(x, most)
    n = len(f)
    half = p[:, : n // 2 + 1].copy()
    half[:, 1 : (n + 1) // 2] *= 2
    return np.abs(f[: n // 2 + 1]), half


def padded_stft(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies, and row x frequency x time: periodic Hann, half overlap, half a frame of zeros at both ends
    and as many more as fill the last frame, divided by the sum of the window."""
    n = min(most, x.shape[1])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    hop, length = n - n // 2, x.shape[1] + 2 * (n // 2)
    x = np.pad(x, ((0, 0), (n // 2, n // 2 + (-(length - n) % hop))))
    return np.fft.fftfreq(n), np.fft.fft(frames(x, n, hop) * w, axis=2).transpose(0, 2, 1) / w.sum()


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Lags 0..n-1 of each row with itself, through the spectrum."""
    n = x.shape[1]
    spec = np.fft.fft(x, 2 * n, axis=1)
    return np.fft.ifft(np.abs(spec) ** 2, axis=1)[:, :n]


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Rows smoothed by a normal kernel cut at four deviations, mirrored at the ends."""
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    n = x.shape[1]
    at = np.arange(-r, n + r) % (2 * n)
    at = np.where(at < n, at, 2 * n - 1 - at)
    return np.lib.stride_tricks.sliding_window_view(x[:, at], 2 * r + 1, axis=1) @ k


def denoised(x: np.ndarray, threshold: float = 0.1) -> np.ndarray:
    """Real rows with the spectral bins above a multiple of the row's deviation (n - 1 in its divisor) only."""
    spec = np.fft.fft(x, axis=1)
    keep = np.abs(spec) > threshold * x.std(1, ddof=1, keepdims=True)
    return np.fft.ifft(np.where(keep, spec, 0), axis=1).real


# Analysis filters of the Daubechies wavelets with one and four vanishing moments.
DB1_LOW = (0.7071067811865476, 0.7071067811865476)
DB4_LOW = (-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965)


def wavelet(x: np.ndarray, low: tuple[float, ...], levels: int) -> list[np.ndarray]:
    """Approximation, then details from the coarsest on; mirrored at the ends."""
    lo = np.array(low)
    hi = lo[::-1] * (-1.0) ** np.arange(len(lo))
    hi, out, a = -hi, [], x
    for _ in range(levels):
        n, m = a.shape[1], len(lo) - 1
        if n < 2:
            break
        at = np.arange(-m, n + m) % (2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at)
        win = np.lib.stride_tricks.sliding_window_view(a[:, at], len(lo), axis=1)[:, 1::2]
        a, d = win @ lo[::-1], win @ hi[::-1]
        out.insert(0, d)
    return [a, *out]


def butterworth_band(order: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a digital Butterworth band-pass; bounds are shares of the Nyquist frequency."""
    a, b = 4 * np.tan(np.pi * np.array([low, high]) / 2)
    prototype = -np.exp(0.5j * np.pi * np.arange(1 - order, order, 2) / order) * (b - a) / 2
    root = np.sqrt(prototype**2 - a * b)
    poles = np.concatenate([prototype + root, prototype - root])
    gain = (b - a) ** order * (4.0**order / np.prod(4 - poles)).real
    return gain * np.poly(np.r_[np.ones(order), -np.ones(order)]), np.poly((4 + poles) / (4 - poles)).real


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Rows through a filter with a state; all rows step together."""
    out, z = np.empty_like(x), state.copy()
    for t in range(x.shape[1]):
        out[:, t] = b[0] * x[:, t] + z[:, 0]
        z[:, :-1] = z[:, 1:] + np.outer(x[:, t], b[1:-1]) - np.outer(out[:, t], a[1:-1])
        z[:, -1] = b[-1] * x[:, t] - a[-1] * out[:, t]
    return out


def band_reach(order: int = 4) -> int:
    """Samples by which both ends are extended."""
    return 3 * (2 * order + 1)


def band_passed(x: np.ndarray, low: float = 0.05, high: float = 0.3, order: int = 4) -> np.ndarray:
    """Real rows through a Butterworth band-pass, forth and back; bounds are in cycles a sample.

    Ends are extended by point reflection, and the filter starts in the steady state of the first sample.
    Rows that are no longer than the extension raise ``ValueError``.
    """
    b, a = butterworth_band(order, 2 * low, 2 * high)
    pad = band_reach(order)
    if x.shape[1] <= pad:
        raise ValueError(f"{x.shape[1]} samples are too few to filter")
    companion = np.eye(len(a) - 1, k=1)
    companion[:, 0] = -a[1:]
    steady = np.linalg.solve(np.eye(len(a) - 1) - companion, b[1:] - a[1:] * b[0])
    out = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], 1)
    for _ in range(2):
        out = filtered(b, a, out, np.outer(out[:, 0], steady))[:, ::-1]
    return out[:, pad:-pad]


def peak_places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places) of the strict local maxima of each row, in order; a plateau counts at its middle."""
    n, flat = x.shape[1], x.ravel()
    change = np.ones(x.shape, bool)
    change[:, 1:] = x[:, 1:] != x[:, :-1]
    starts = np.flatnonzero(change)  # of runs of equal values
    ends = np.r_[starts[1:], flat.size] - 1
    v, inner = flat[starts], (starts % n > 0) & (ends % n < n - 1)
    top = np.flatnonzero(inner)
    top = top[(v[top] > v[top - 1]) & (v[top] > v[top + 1])]
    middle = (starts[top] + ends[top]) // 2
    return middle // n, middle % n


def peaks(x: np.ndarray) -> np.ndarray:
    """Places of the strict local maxima of one row."""
    return peak_places(x[None])[1]


class Stretches:
    """Least and largest values of stretches of rows, from tables of stretches of 1, 2, 4, ... samples."""

    def __init__(self, x: np.ndarray):
        self.n = x.shape[1]
        self.low, self.high = [x.ravel()], [x.ravel()]
        while 2 << len(self.low) - 1 <= self.n:
            half = 1 << len(self.low) - 1
            self.low.append(np.minimum(self.low[-1][:-half], self.low[-1][half:]))
            self.high.append(np.maximum(self.high[-1][:-half], self.high[-1][half:]))

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least value from start up to, but without, end."""
        k = np.frexp(end - start)[1] - 1
        out = np.empty(len(start))
        for level in np.unique(k):
            own = k == level
            out[own] = np.minimum(self.low[level][start[own]], self.low[level][end[own] - (1 << level)])
        return out

    def reach(self, at: np.ndarray, tables: list[np.ndarray], fits: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int) -> np.ndarray:
        """How far from ``at`` on (to the left for a step of -1, without it) all of a row's samples fit."""
        edge, out = at // self.n * self.n + (self.n - 1) * (step > 0), np.zeros(len(at), int)
        for level in range(len(tables) - 1, -1, -1):
            size = 1 << level
            first = at + out + 1 if step > 0 else at - out - size
            inside = first + size - 1 <= edge if step > 0 else first >= edge
            good = inside.copy()
            good[inside] = fits(tables[level][first[inside]], inside)
            out += size * good
        return out


def peak_widths(x: np.ndarray, rows: np.ndarray, at: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Widths of peaks at half of their prominence, interpolated: all peaks of a batch of rows together.

    A binary search over the tables finds where a higher sample ends a peak's surroundings, and where its flanks reach half height.
    """
    n, out = x.shape[1], np.zeros(len(at))
    step = max(1, most // n)
    for begin in range(0, len(x), step):
        own = (rows >= begin) & (rows < begin + step)
        part, place = x[begin : begin + step], (rows[own] - begin) * n + at[own]
        if not len(place):
            continue
        table, flat = Stretches(part), part.ravel()
        top = flat[place]
        left = place - table.reach(place, table.high, lambda v, k: v <= top[k], -1)
        right = place + table.reach(place, table.high, lambda v, k: v <= top[k], 1)
        base = np.maximum(table.least(left, place + 1), table.least(place, right + 1))
        level = top - (top - base) / 2
        first, last = place // n * n, place // n * n + n - 1
        i = np.where(top > level, np.maximum(first, place - table.reach(place, table.low, lambda v, k: v > level[k], -1) - 1), place)
        j = np.where(top > level, np.minimum(last, place + table.reach(place, table.low, lambda v, k: v > level[k], 1) + 1), place)
        a, b = i.astype(float), j.astype(float)
        k = (flat[i] < level) & (i < place)
        a[k] += (level[k] - flat[i[k]]) / (flat[i[k] + 1] - flat[i[k]])
        k = (flat[j] < level) & (j > place)
        b[k] -= (level[k] - flat[j[k]]) / (flat[j[k] - 1] - flat[j[k]])
        out[own] = b - a
    return out


def half_widths(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Widths of peaks of one row."""
    return peak_widths(x[None], np.zeros(len(at), int), at)


def bins_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Of each value, its number among equal bins between the least and the largest value of its row."""
    low, high = x.min(1, keepdims=True), x.max(1, keepdims=True)
    flat = low == high
    low, high = low - 0.5 * flat, high + 0.5 * flat
    edges = np.linspace(low[:, 0], high[:, 0], bins + 1, axis=1)
    at = np.minimum(((x - low) * (bins / (high - low))).astype(int), bins - 1)
    at -= x < np.take_along_axis(edges, at, 1)  # rounding may put a value beside its bin
    at += (x >= np.take_along_axis(edges, at + 1, 1)) & (at < bins - 1)
    return at


def counts_of(at: np.ndarray, bins: int) -> np.ndarray:
    """How many of each row's values are in each bin."""
    return np.bincount((np.arange(len(at))[:, None] * bins + at).ravel(), minlength=len(at) * bins).reshape(len(at), bins)


def gaussian_sums(x: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Sums of rows that are smoothed as ``gaussian`` does, each by a deviation of its own."""
    n, out = x.shape[1], np.zeros(len(x))
    radius = np.maximum(1, (4 * sigma + 0.5).astype(int))
    for r in np.unique(radius):  # a few sizes of kernels
        own = radius == r
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma[own, None]) ** 2)
        at = np.arange(-r, n + r) % (2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at)
        shifted = np.lib.stride_tricks.sliding_window_view(x[own][:, at], n, axis=1).sum(2)
        out[own] = (shifted * k).sum(1) / k.sum(1)
    return out


def spaced_bursts(power: np.ndarray, window: int, smooth: int, spacing: int, most: int, seed: int) -> list[int]:
    """Starts of the strongest windows at least ``spacing`` apart, strongest first; seeded ones fill up what is missing."""
    n = len(power)
    if n <= window:
        return [0]
    k = max(1, min(smooth, n, window))
    level = np.convolve(power, np.ones(k) / k, mode="same")
    starts: list[int] = []
    free = np.ones(n - window + 1, bool)
    place = np.clip(np.arange(n) - window // 2, 0, n - window)
    for centre in np.argsort(-level, kind="stable"):
        s = int(place[centre])
        if free[s]:
            starts.append(s)
            free[max(0, s - spacing + 1) : s + spacing] = False
            if len(starts) == most or not free.any():
                break
    rng = np.random.default_rng(seed)
    for _ in range(20 * most):
        if len(starts) >= most or not free.any():
            break
        s = int(rng.integers(0, n - window + 1))
        if free[s]:
            starts.append(s)
            free[max(0, s - spacing + 1) : s + spacing] = False
    return starts
