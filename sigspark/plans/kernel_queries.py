"""Registered queries on features, spectrograms and streams, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import spectral as sp
from ..functions.arrays import mean_of
from ..operators import windows as win
from ..streaming import live
from ..streaming.run import drained, recorded
from .catalogue_queries import rounded
from .signal_queries import TAU, UNWRAP
from .tables import captures, chunks, predictions, r6, table, with_tables

IQ = with_tables("iq")


def windows(spark, sf):
    return captures(spark, sf).select("capture_id", "iq")


def ft1_time_features(spark, sf):
    names = ["avg_symbol_power", "papr", "rms", "mean_abs", "mag_variance", "mag_skewness", "mag_kurtosis", "mag_central5", "mag_raw4", "zero_crossing_rate", "temporal_peak_density"]
    return rounded(ft.extract_features(windows(spark, sf), ("power", "moments", "crossings"), selected=names))


FT1 = IQ + """, s AS (SELECT *, sqrt(i * i + q * q) AS m, sign(i) <> lag(sign(i)) OVER w AS z, i > lag(i) OVER w AND i > lead(i) OVER w AS t FROM iq WINDOW w AS (PARTITION BY capture_id ORDER BY n)), a AS (SELECT *, avg(m) OVER (PARTITION BY capture_id) AS mu FROM s),
g AS (SELECT capture_id, avg(m * m) AS p, max(m * m) AS top, avg(m) AS ma, avg((m - mu) ** 2) AS v, avg((m - mu) ** 3) AS c3, avg((m - mu) ** 4) AS c4, avg((m - mu) ** 5) AS c5, avg(m ** 4) AS r4, sum(z::INT) / 32 AS z, sum(t::INT) / 32 AS t FROM a GROUP BY 1)
SELECT capture_id, round(p, 6) + 0.0 AS avg_symbol_power, round(top / (p + 1e-12), 6) + 0.0 AS papr, round(sqrt(p), 6) + 0.0 AS rms, round(ma, 6) + 0.0 AS mean_abs, round(v, 6) + 0.0 AS mag_variance, round(c3 / v ** 1.5, 6) + 0.0 AS mag_skewness, round(c4 / v ** 2, 6) + 0.0 AS mag_kurtosis,
round(c5, 6) + 0.0 AS mag_central5, round(r4, 6) + 0.0 AS mag_raw4, round(z, 6) + 0.0 AS zero_crossing_rate, round(t, 6) + 0.0 AS temporal_peak_density FROM g"""


def features(spark, sf, family, *names):
    """Some features of a family, rounded."""
    return rounded(ft.extract_features(windows(spark, sf), (family,), selected=list(names)).select("capture_id", *names))


def r(**columns: str) -> str:
    """Rounded columns, by name."""
    return ", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in columns.items())


def central(x: str, mean: str, k: int) -> str:
    return f"avg(({x} - {mean}) ** {k})"


def transformed(name: str, source: str, n: int = 32) -> str:
    """The discrete Fourier transform of (capture_id, n, i, q) rows as (capture_id, k, re, im, a, f)."""
    angle = f"{TAU} * k * n / {n}"
    return f""", {name}_s AS (SELECT capture_id, k::INT AS k, sum(i * cos({angle}) + q * sin({angle})) AS re, sum(q * cos({angle}) - i * sin({angle})) AS im FROM {source}, range({n}) b(k) GROUP BY ALL),
{name} AS (SELECT *, sqrt(re * re + im * im) AS a, ((k + {n // 2}) % {n} - {n // 2}) / {n} AS f FROM {name}_s)"""


def analytic(name: str, source: str) -> str:
    """The analytic signal of real (capture_id, n, i) rows of 32 samples as (capture_id, n, re, im, e, p, d): envelope, phase and its unwrapped step."""
    spec = transformed(f"{name}_f", f"(SELECT capture_id, n, i, 0.0::DOUBLE AS q FROM {source})")
    angle = f"{TAU} * k * n / 32"
    return spec + f""", {name}_a AS (SELECT capture_id, n::INT AS n, sum(h * (re * cos({angle}) - im * sin({angle}))) / 32 AS re, sum(h * (re * sin({angle}) + im * cos({angle}))) / 32 AS im
FROM (SELECT *, CASE WHEN k % 16 = 0 THEN 1 ELSE 2 END AS h FROM {name}_f WHERE k <= 16), range(32) b(n) GROUP BY ALL),
{name}_b AS (SELECT *, sqrt(re * re + im * im) AS e, atan2(im, re) AS p, atan2(im, re) - lag(atan2(im, re)) OVER (PARTITION BY capture_id ORDER BY n) AS w FROM {name}_a),
{name} AS (SELECT *, w - {TAU} * round(w / {TAU}) AS d FROM {name}_b)"""


POWERS = IQ + ", sq AS (SELECT capture_id, n, i * i - q * q AS i, 2 * i * q AS q FROM iq), cube AS (SELECT capture_id, n, s.i * x.i - s.q * x.q AS i, s.i * x.q + s.q * x.i AS q FROM sq s JOIN iq x USING (capture_id, n)), fourth AS (SELECT capture_id, n, i * i - q * q AS i, 2 * i * q AS q FROM sq)"


def ft4_phase_features(spark, sf):
    return features(spark, sf, "phase", "inst_freq_std", "inst_freq_dev", "phase_deviation_rate", "frequency_variance", "phase_change_rate", "phase_skew_cubic", "phase_skew_quartic", "iq_phase_variance", "iq_phase_skewness", "iq_phase_kurtosis", "iq_freq_rms")


FT4 = POWERS + UNWRAP + f""", p AS (SELECT capture_id, n, u - lag(u) OVER w AS d, phase, atan2(c.q, c.i) - lag(atan2(c.q, c.i)) OVER w AS d3, atan2(f.q, f.i) AS p4, atan2(f.q, f.i) - lag(atan2(f.q, f.i)) OVER w AS d4
FROM un JOIN cube c USING (capture_id, n) JOIN fourth f USING (capture_id, n) WINDOW w AS (PARTITION BY capture_id ORDER BY n)), g AS (SELECT capture_id, avg(d3) AS m3, avg(p4) AS m4, avg(phase) AS mp FROM p GROUP BY 1)
SELECT capture_id, {r(inst_freq_std="stddev_pop(d)", inst_freq_dev=f"stddev_pop(d) / {TAU}", phase_deviation_rate="stddev_pop(d)", frequency_variance="var_pop(d)", phase_change_rate="var_pop(d4)", phase_skew_cubic=f"({central('d3', 'm3', 3)} / var_pop(d3) ** 1.5) ** 3",
    phase_skew_quartic=f"({central('p4', 'm4', 3)} / var_pop(p4) ** 1.5) ** 4", iq_phase_variance="var_pop(phase)", iq_phase_skewness=f"{central('phase', 'mp', 3)} / var_pop(phase) ** 1.5", iq_phase_kurtosis=f"{central('phase', 'mp', 4)} / var_pop(phase) ** 2", iq_freq_rms="sqrt(avg(d * d))")} FROM p JOIN g USING (capture_id) GROUP BY capture_id"""


def ft5_constellation(spark, sf):
    return features(spark, sf, "constellation", "constellation_density")


FT5 = IQ + """, g AS (SELECT capture_id, min(i) AS li, max(i) AS hi, min(q) AS lq, max(q) AS hq FROM iq GROUP BY 1),
c AS (SELECT capture_id, least(9, floor((i - li) / (hi - li) * 10)) AS x, least(9, floor((q - lq) / (hq - lq) * 10)) AS y, count(*) AS n FROM iq JOIN g USING (capture_id) GROUP BY ALL)
SELECT capture_id, round(sum(n * n) / 100 - (sum(n) / 100) ** 2, 6) + 0.0 AS constellation_density FROM c GROUP BY 1"""


def ft6_envelope_features(spark, sf):
    return features(spark, sf, "envelope", "env_mean", "env_variance", "env_std", "env_kurtosis", "env_rms", "env_rms_polynomial", "env_peak_ratio", "env_iqr", "env_iqr_cubic", "amplitude_asymmetry", "amplitude_asymmetry_cubic", "modulation_index", "modulation_index_peak", "temporal_energy_variance")


CUBED = "(SELECT capture_id, n, i ** 3 AS i FROM iq)"
FT6 = IQ + analytic("x", "iq") + analytic("c", CUBED) + analytic("cc", "(SELECT capture_id, n, e AS i FROM c)") + analytic("y", "(SELECT capture_id, n, i * i - 1 AS i FROM iq)") + f""",
w AS (SELECT j, exp(-0.5 * (j / 3.0) ** 2) / sum(exp(-0.5 * (j / 3.0) ** 2)) OVER () AS w FROM range(-12, 13) t(j)), sm AS (SELECT capture_id, n, sum(w * e) AS s FROM (SELECT t.n, j, w, CASE WHEN (t.n + j + 64) % 64 < 32 THEN (t.n + j + 64) % 64 ELSE 63 - (t.n + j + 64) % 64 END AS m FROM w, range(32) t(n)) z JOIN (SELECT capture_id, n AS m, e FROM x) USING (m) GROUP BY ALL),
sv AS (SELECT capture_id, var_pop(s) AS tv FROM sm GROUP BY 1), cs AS (SELECT capture_id, avg(e) AS mc FROM c GROUP BY 1), ck AS (SELECT capture_id, {central('e', 'mc', 3)} / var_pop(e) ** 1.5 AS ac FROM c JOIN cs USING (capture_id) GROUP BY 1),
cq AS (SELECT capture_id, quantile_cont(e, 0.75) - quantile_cont(e, 0.25) AS iq3 FROM cc GROUP BY 1), yr AS (SELECT capture_id, sqrt(avg(e * e)) AS yr FROM y GROUP BY 1), g AS (SELECT capture_id, avg(e) AS m, var_pop(e) AS v FROM x GROUP BY 1)
SELECT capture_id, {r(env_mean="any_value(m)", env_variance="any_value(v)", env_std="sqrt(any_value(v))", env_kurtosis=f"{central('e', 'm', 4)} / any_value(v) ** 2", env_rms="sqrt(avg(e * e))", env_rms_polynomial="any_value(yr)", env_peak_ratio="max(e) / any_value(m)", env_iqr="quantile_cont(e, 0.75) - quantile_cont(e, 0.25)", env_iqr_cubic="any_value(iq3)",
    amplitude_asymmetry=f"{central('e', 'm', 3)} / any_value(v) ** 1.5", amplitude_asymmetry_cubic="any_value(ac)", modulation_index="any_value(v / m)", modulation_index_peak="max(e) / (any_value(m) + 1e-10) - any_value(m / (m + 1e-10))", temporal_energy_variance="any_value(tv)")}
FROM x JOIN g USING (capture_id) JOIN sv USING (capture_id) JOIN ck USING (capture_id) JOIN cq USING (capture_id) JOIN yr USING (capture_id) GROUP BY capture_id"""


def ft7_analytic_phase(spark, sf):
    return features(spark, sf, "analytic_phase", "aphase_mean", "aphase_variance", "aphase_std", "aphase_skewness", "aphase_kurtosis", "afreq_mean", "afreq_std", "afreq_rms", "afreq_entropy", "afreq_rate_of_change", "afreq_modulation_rate", "afreq_asymmetry", "afreq_asymmetry_cubic", "afreq_wrapped_std", "phase_envelope_correlation", "phase_jitter")


FT7 = IQ + analytic("x", "iq") + analytic("c", CUBED) + f""", u AS (SELECT *, first_value(p) OVER w + coalesce(sum(d) OVER w, 0) AS u, d - lag(d) OVER w AS dd FROM x WINDOW w AS (PARTITION BY capture_id ORDER BY n)),
steps AS (SELECT capture_id, d FROM x WHERE n > 0), same AS (SELECT capture_id, d / {TAU} AS t FROM steps UNION ALL SELECT capture_id, d / {TAU} FROM x WHERE n = 31), sg AS (SELECT capture_id, avg(t) AS ta, stddev_pop(t) AS ts FROM same GROUP BY 1),
hr AS (SELECT capture_id, min(d) AS lo, (max(d) - min(d)) / 64 AS width FROM steps GROUP BY 1), hc AS (SELECT capture_id, any_value(width) AS width, least(63, floor((d - lo) / width)) AS b, count(*) AS n FROM steps JOIN hr USING (capture_id) GROUP BY capture_id, b),
he AS (SELECT capture_id, -sum((n / 31 / width + 1e-10) * log2(n / 31 / width + 1e-10)) - (64 - count(*)) * 1e-10 * log2(1e-10) AS h FROM hc GROUP BY 1),
ca AS (SELECT capture_id, avg(d ** 3) AS ca FROM c GROUP BY 1), g AS (SELECT capture_id, avg(u) AS m, var_pop(u) AS v FROM u GROUP BY 1)
SELECT capture_id, {r(aphase_mean="any_value(m)", aphase_variance="any_value(v)", aphase_std="sqrt(any_value(v))", aphase_skewness=f"{central('u', 'm', 3)} / any_value(v) ** 1.5", aphase_kurtosis=f"{central('u', 'm', 4)} / any_value(v) ** 2", afreq_mean="any_value(ta)", afreq_std="any_value(ts)", afreq_rms="sqrt(avg(d * d))", afreq_entropy="any_value(h)",
    afreq_rate_of_change="stddev_pop(dd)", afreq_modulation_rate="avg(abs(dd))", afreq_asymmetry="avg(d ** 3)", afreq_asymmetry_cubic="any_value(ca)", afreq_wrapped_std="stddev_pop(w)", phase_envelope_correlation="corr(u, e)", phase_jitter="stddev_pop(d)")}
FROM u JOIN g USING (capture_id) JOIN sg USING (capture_id) JOIN he USING (capture_id) JOIN ca USING (capture_id) GROUP BY capture_id"""
DFT = IQ + transformed("m", "iq")


def ft8_spectrum_features(spark, sf):
    return features(spark, sf, "spectrum", "fft_peak_index", "fft_peak_frequency", "fft_mean", "fft_std", "fft_peak_power", "fft_mean_power", "fft_std_power", "fft_peak_power_db", "fft_mean_power_db", "fft_std_power_db", "spectral_energy", "spectral_energy_density", "spectral_peak_ratio")


FT8 = DFT + f""" SELECT capture_id, {r(fft_peak_index="arg_max(k, a)::DOUBLE", fft_peak_frequency="arg_max(f, a)", fft_mean="avg(a)", fft_std="stddev_pop(a)", fft_peak_power="max(a * a)", fft_mean_power="avg(a * a)", fft_std_power="stddev_pop(a * a)", fft_peak_power_db="20 * log10(max(a))",
    fft_mean_power_db="20 * log10(avg(a))", fft_std_power_db="20 * log10(stddev_pop(a))", spectral_energy="sum(a * a)", spectral_energy_density="sum(a * a) / 32", spectral_peak_ratio="max(a) / avg(a)")} FROM m GROUP BY capture_id"""


def ft9_spectrum_shape(spark, sf):
    return features(spark, sf, "shape", "spectral_entropy", "spectral_entropy_amplitude", "spectral_entropy_128", "spectral_flatness", "spectral_flatness_power", "spectral_skewness", "spectral_kurtosis", "spectral_sparsity", "spectral_centroid", "spectral_spread", "spectral_slope", "spectral_rolloff", "rolloff_energy",
                    "bandwidth_quarter", "bandwidth_half", "spectral_asymmetry", "spectral_symmetry", "psd_kurtosis", "high_half_entropy", "spectrum_zero_crossings")


FT9 = DFT + transformed("wide", "iq", 128) + f""", g AS (SELECT capture_id, avg(a) AS mu, var_pop(a) AS v, sum(a) AS t, sum(a * a) AS e, avg(a * a) AS mp, var_pop(a * a) AS vp, max(a) AS top, sum(f * a) / sum(a + 1e-10) AS c, avg(f) AS mf FROM m GROUP BY 1),
x AS (SELECT *, a * a AS p, sum(a * a) OVER w AS cum, sign(re) <> lag(sign(re)) OVER w AS z FROM m JOIN g USING (capture_id) WINDOW w AS (PARTITION BY capture_id ORDER BY k)),
s AS (SELECT capture_id, sum(a * a) AS se FROM wide GROUP BY 1), h AS (SELECT capture_id, -sum(a * a / se * log2(a * a / se + 1e-10)) AS h128 FROM wide JOIN s USING (capture_id) GROUP BY 1)
SELECT capture_id, {r(spectral_entropy="-sum(p / e * ln(p / e + 1e-10))", spectral_entropy_amplitude="-sum(a / t * ln(a / t))", spectral_entropy_128="any_value(h128)", spectral_flatness="exp(avg(ln(a + 1e-10))) / any_value(mu)", spectral_flatness_power="exp(avg(ln(p + 1e-10))) / (any_value(mp) + 1e-10)",
    spectral_skewness=f"{central('a', 'mu', 3)} / any_value(v) ** 1.5", spectral_kurtosis=f"{central('a', 'mu', 4)} / any_value(v) ** 2", spectral_sparsity="count(*) FILTER (a < mu)::DOUBLE", spectral_centroid="any_value(c)", spectral_spread="sqrt(sum((f - c) ** 2 * a) / sum(a + 1e-10))",
    spectral_slope="sum((f - mf) * (a - mu)) / sum((f - mf) ** 2 + 1e-10)", spectral_rolloff="arg_min(f, k) FILTER (cum >= 0.85 * e)", rolloff_energy="min(cum) FILTER (cum >= 0.85 * e)", bandwidth_quarter="arg_max(f, k) FILTER (a >= 0.25 * top) - arg_min(f, k) FILTER (a >= 0.25 * top)",
    bandwidth_half="arg_max(f, k) FILTER (a >= 0.5 * top) - arg_min(f, k) FILTER (a >= 0.5 * top)", spectral_asymmetry="(sum(p) FILTER (k >= 16) - sum(p) FILTER (k < 16)) / (sum(p) + 1e-10)", spectral_symmetry="abs(sum(p) FILTER (k >= 16) - sum(p) FILTER (k < 16)) / (sum(p) + 1e-10)",
    psd_kurtosis=f"abs({central('p', 'mp', 4)} / any_value(vp) ** 2 - 3)", high_half_entropy="-sum(p / e * log2(p / e + 1e-10)) FILTER (k >= 16)", spectrum_zero_crossings="sum(z::INT) / 32")} FROM x JOIN h USING (capture_id) GROUP BY capture_id"""


def ft2_complex_moments(spark, sf):
    """Fifth central and sixth moment of complex samples, as size and phase. Values scaled up, as they are small."""
    rows = ft.extract_features(windows(spark, sf).withColumn("iq", F.transform("iq", lambda s: F.struct((s.i * 8).alias("i"), (s.q * 8).alias("q")))), ("moments",))
    return rounded(rows.select("capture_id", "complex_central5", "complex_central5_phase", "complex_moment6", "complex_moment6_phase"))


FT2 = IQ + """, z AS (SELECT capture_id, i * 8 AS i, q * 8 AS q, avg(i * 8) OVER w AS mi, avg(q * 8) OVER w AS mq FROM iq WINDOW w AS (PARTITION BY capture_id)), p AS (SELECT capture_id, sqrt((i - mi) ** 2 + (q - mq) ** 2) AS r, atan2(q - mq, i - mi) AS t, sqrt(i * i + q * q) AS r0, atan2(q, i) AS t0 FROM z),
m AS (SELECT capture_id, avg(r ** 5 * cos(5 * t)) AS a, avg(r ** 5 * sin(5 * t)) AS b, avg(r0 ** 6 * cos(6 * t0)) AS c, avg(r0 ** 6 * sin(6 * t0)) AS d FROM p GROUP BY 1)
SELECT capture_id, round(sqrt(a * a + b * b), 6) + 0.0 AS complex_central5, round(atan2(b, a), 6) + 0.0 AS complex_central5_phase, round(sqrt(c * c + d * d), 6) + 0.0 AS complex_moment6, round(atan2(d, c), 6) + 0.0 AS complex_moment6_phase FROM m"""


def ft9_kernel_forms(spark, sf):
    """Entropy of the spectrum of x^3, and flatness of that of x^4."""
    return features(spark, sf, "shape", "spectral_entropy_cubic", "spectral_flatness_quartic")


FT9K = IQ + ", cubed AS (SELECT capture_id, n, i ** 3 - 3 * i * q * q AS i, 3 * i * i * q - q ** 3 AS q FROM iq), fourth AS (SELECT capture_id, n, i ** 4 - 6 * i * i * q * q + q ** 4 AS i, 4 * i ** 3 * q - 4 * i * q ** 3 AS q FROM iq)" + transformed("c3", "cubed") + transformed("c4", "fourth") + f""",
t AS (SELECT capture_id, sum(a * a) AS e FROM c3 GROUP BY 1), h AS (SELECT capture_id, {r(spectral_entropy_cubic="-sum(a * a / e * ln(a * a / e + 1e-10))")} FROM c3 JOIN t USING (capture_id) GROUP BY capture_id), g AS (SELECT capture_id, {r(spectral_flatness_quartic="exp(avg(ln(a * a + 1e-10))) / (avg(a * a) + 1e-10)")} FROM c4 GROUP BY capture_id)
SELECT * FROM h JOIN g USING (capture_id)"""


def ft12_quadratic_kernel(spark, sf):
    return features(spark, sf, "welch", "modulation_bandwidth_quadratic")


def ft10_band_energy(spark, sf):
    return features(spark, sf, "band", "centre_energy_share", "band_spread", "high_frequency_ratio")


FT10 = DFT + f""", g AS (SELECT capture_id, arg_max(k, a) AS c FROM m GROUP BY 1)
SELECT capture_id, {r(centre_energy_share="coalesce(sum(a * a) FILTER (k >= c - 2 AND k < c + 2), 0) / (sum(a * a) + 1e-10)", band_spread="sum(a * a) FILTER (k >= 3 AND k < 16) / (sum(a * a) + 1e-10)", high_frequency_ratio="sum(a * a) FILTER (abs(f) > 0.4) / (sum(a * a) * (1 - 0.4))")} FROM m JOIN g USING (capture_id) GROUP BY capture_id"""
PEAKS = ("count", "mean", "max", "min", "energy_ratio", "to_average", "kurtosis", "spacing_std", "energy", "flatness", "energy_std", "density", "range")


def ft11_spectral_peaks(spark, sf):
    return features(spark, sf, "peaks", *[f"peaks{k}_{n}" for k in (1, 4) for n in PEAKS], "adaptive_peak_count")


def peak_columns(k: int) -> dict[str, str]:
    v, some = f"a ** {k}", "FILTER (top)"
    out = {
        "count": f"count(*) {some}", "mean": f"avg({v}) {some}", "max": f"max({v}) {some}", "min": f"min({v}) {some}", "energy_ratio": f"sum(a ** {2 * k}) {some} / sum(a ** {2 * k})", "to_average": f"avg({v}) {some} / avg({v})", "kurtosis": f"avg(({v} - m{k}) ** 4) {some} / (var_pop({v}) {some}) ** 2 - 3",
        "spacing_std": f"stddev_pop(gap) {some}", "energy": f"sum({v}) {some}", "flatness": f"exp(avg(ln({v} + 1e-10)) {some}) / (avg({v}) {some} + 1e-10)", "energy_std": f"stddev_pop({v}) {some}", "density": f"count(*) {some} / 32", "range": f"max(k) {some} - min(k) {some}",
    }
    return {f"peaks{k}_{n}": f"({x})::DOUBLE" for n, x in out.items()}


FT11 = DFT + f""", t AS (SELECT *, coalesce(a > lag(a) OVER w AND a > lead(a) OVER w, false) AS top FROM m WINDOW w AS (PARTITION BY capture_id ORDER BY k)),
g AS (SELECT capture_id, median(a) AS med, avg(a) FILTER (top) AS m1, avg(a ** 4) FILTER (top) AS m4 FROM t GROUP BY 1), u AS (SELECT *, k - lag(k) OVER (PARTITION BY capture_id, top ORDER BY k) AS gap FROM t JOIN g USING (capture_id))
SELECT capture_id, {r(**peak_columns(1), **peak_columns(4), adaptive_peak_count="(count(*) FILTER (top AND a >= 1.5 * med))::DOUBLE")} FROM u GROUP BY capture_id"""


def ft12_welch_features(spark, sf):
    return features(spark, sf, "welch", *[f"band_entropy{k}_{b}" for k in (1, 2, 3, 4) for b in ("low", "mid", "high")], "energy_concentration", "mid_band_energy", "frequency_spread_log", "frequency_spread_cubic", "modulation_bandwidth", "welch_high_ratio", "centre_concentration", "envelope_power_variability")


def welch_sql(name: str, source: str) -> str:
    """Density of one segment of 32 samples: constant detrend, periodic Hann."""
    hann = f"(0.5 - 0.5 * cos({TAU} * n / 32))"
    return f", {name}_m AS (SELECT capture_id, avg(i) AS mi, avg(q) AS mq FROM {source} GROUP BY 1), {name}_w AS (SELECT capture_id, n, (i - mi) * {hann} AS i, (q - mq) * {hann} AS q FROM {source} JOIN {name}_m USING (capture_id))" + transformed(f"{name}_t", f"{name}_w") + f", {name} AS (SELECT *, a * a / 12 AS p FROM {name}_t)"


def band_entropy(k: int, low: float, high: float) -> str:
    some = f"FILTER (f >= {low} AND f <= {high})"
    return f"coalesce(-sum(p ** {k} / s{k}_{int(low * 100)} * log2(p ** {k} / s{k}_{int(low * 100)} + 1e-10)) {some}, 0)"


BANDS = {"low": (0, 0.25), "mid": (0.25, 0.5), "high": (0.5, 1)}
FT12 = IQ + welch_sql("d", "iq") + ", poly AS (SELECT capture_id, n, i * i - q * q - 1 AS i, 2 * i * q AS q FROM iq)" + welch_sql("y", "poly") + analytic("x", "iq") + ", env AS (SELECT capture_id, n, e AS i, 0.0::DOUBLE AS q FROM x)" + welch_sql("v", "env") + f""",
s AS (SELECT capture_id, sum(f * p) / sum(p) AS mf, {", ".join(f"sum(p ** {k}) FILTER (f >= {lo} AND f <= {hi}) AS s{k}_{int(lo * 100)}" for k in (1, 2, 3, 4) for lo, hi in BANDS.values())} FROM d GROUP BY 1), me AS (SELECT capture_id, sum(p) AS me FROM y WHERE f >= 0.1 AND f <= 0.5 GROUP BY 1),
ev AS (SELECT capture_id, var_pop(b) AS ev FROM (SELECT capture_id, k // 4 AS j, sum(CASE WHEN k = 0 THEN p ELSE 2 * p END) AS b FROM v WHERE k < 16 GROUP BY ALL) GROUP BY 1), z AS (SELECT capture_id, sqrt(sum((f - mf) ** 2 * p) / sum(p)) AS sp FROM d JOIN s USING (capture_id) GROUP BY 1)
SELECT capture_id, {r(**{f"band_entropy{k}_{b}": band_entropy(k, *BANDS[b]) for k in (1, 2, 3, 4) for b in BANDS}, energy_concentration="sum(p) FILTER (f >= 0.1 AND f <= 0.5)", mid_band_energy="any_value(me)", frequency_spread_log="ln(any_value(sp))", frequency_spread_cubic="ln(any_value(sp) + 1e-10) ** 3",
    modulation_bandwidth="sqrt(avg(f * f * p) - avg(f * p) ** 2)", welch_high_ratio="coalesce(sum(p) FILTER (f > 0.5), 0) / sum(p)", centre_concentration="sum(p) FILTER (f > 0.4 AND f < 0.6) / sum(p)", envelope_power_variability="any_value(ev)")}
FROM d JOIN s USING (capture_id) JOIN me USING (capture_id) JOIN ev USING (capture_id) JOIN z USING (capture_id) GROUP BY capture_id"""


FT12Q = IQ + welch_sql("d", "iq") + f" SELECT capture_id, {r(modulation_bandwidth_quadratic='sqrt(avg(f * f * p) - avg(f * p) ** 2)')} FROM d GROUP BY capture_id"


def ft13_stft_features(spark, sf):
    return features(spark, sf, "stft", "stft_kurtosis", "stft_energy_spread", "tf_concentration")


FT13 = IQ + f""", fr AS (SELECT capture_id, t, n - 16 * (t - 1) AS j, i, q FROM iq, range(3) z(t) WHERE n >= 16 * (t - 1) AND n < 16 * (t - 1) + 32), w AS (SELECT capture_id * 3 + t AS capture_id, j AS n, i * (0.5 - 0.5 * cos({TAU} * j / 32)) / 16 AS i, q * (0.5 - 0.5 * cos({TAU} * j / 32)) / 16 AS q FROM fr)""" + transformed("m", "w") + f""",
x AS (SELECT capture_id // 3 AS capture_id, k, f, re, im, a FROM m), kf AS (SELECT capture_id, k, var_pop(a * a) / avg(a * a) ** 2 - 1 AS v FROM x GROUP BY ALL), ks AS (SELECT capture_id, avg(v) AS ku FROM kf GROUP BY 1),
b AS (SELECT capture_id, sum(a) FILTER (f >= 0.05 AND f <= 0.3) / sum(a) AS tf, stddev_pop(a) AS es FROM x GROUP BY 1)
SELECT capture_id, {r(stft_kurtosis="ku", stft_energy_spread="es", tf_concentration="tf")} FROM b JOIN ks USING (capture_id)"""


def ft14_autocorrelation(spark, sf):
    return features(spark, sf, "correlation", "autocorrelation_decay", "autocorrelation_skewness", "autocorrelation_energy_variance", "digital_flag")


def lagged(name: str, source: str) -> str:
    return f", {name} AS (SELECT x.capture_id, x.n - y.n AS l, sum(x.i * y.i + x.q * y.q) AS re, sum(x.q * y.i - x.i * y.q) AS im, sum(x.i * y.i) AS own FROM {source} x JOIN {source} y ON x.capture_id = y.capture_id AND x.n >= y.n GROUP BY ALL)"


FT14 = POWERS + lagged("a", "iq") + lagged("b", "fourth") + f""", z AS (SELECT capture_id, re + 1e-10 AS r0 FROM a WHERE l = 0), d AS (SELECT capture_id, l, ln(sqrt((re / r0 + 1e-10) ** 2 + (im / r0) ** 2)) AS v FROM a JOIN z USING (capture_id)),
dc AS (SELECT capture_id, -((sum(v) FILTER (l >= 30) - sum(v) FILTER (l < 2)) / 2 + sum(v) FILTER (l = 31) - sum(v) FILTER (l = 30)) / 31 AS decay FROM d GROUP BY 1),
ag AS (SELECT capture_id, sum(CASE WHEN l = 0 THEN re ELSE 2 * re END) / 63 AS mu FROM a GROUP BY 1), av AS (SELECT capture_id, sum(CASE WHEN l = 0 THEN 1 ELSE 2 END * ((re - mu) ** 2 + im * im)) / 63 AS ev FROM a JOIN ag USING (capture_id) GROUP BY 1),
fl AS (SELECT capture_id, (min(own) / max(own) < 0.1)::INT::DOUBLE AS flag FROM a GROUP BY 1), bg AS (SELECT capture_id, sum(CASE WHEN l = 0 THEN re ELSE 2 * re END) / 63 AS mu FROM b GROUP BY 1),
bs AS (SELECT capture_id, sum(w * (c * c - im * im)) / 63 AS m2, sum(w * (c ** 3 - 3 * c * im * im)) / 63 AS m3 FROM (SELECT capture_id, CASE WHEN l = 0 THEN 1 ELSE 2 END AS w, re - mu AS c, im FROM b JOIN bg USING (capture_id)) GROUP BY 1)
SELECT capture_id, {r(autocorrelation_decay="decay", autocorrelation_skewness="abs(m3) / abs(m2) ** 1.5", autocorrelation_energy_variance="ev", digital_flag="flag")} FROM dc JOIN av USING (capture_id) JOIN fl USING (capture_id) JOIN bs USING (capture_id)"""


def ft15_wavelet_features(spark, sf):
    return features(spark, sf, "wavelet", "wavelet_entropy", "wavelet_detail_mean", "wavelet_detail_energy", "wavelet_cubic", "wavelet4_cubic", "wavelet4_quartic")


def haar() -> str:
    """(capture_id, level, i, q): details of levels 1 to 4 and, as level 5, the approximation, as sums over blocks."""
    parts = [f"SELECT capture_id, {v} AS level, n // {2 ** min(v, 4)} AS b, sum(i * {s}) / {2 ** (min(v, 4) / 2)} AS i, sum(q * {s}) / {2 ** (min(v, 4) / 2)} AS q FROM iq GROUP BY ALL"
             for v, s in [(v, f"CASE WHEN n % {2**v} < {2 ** (v - 1)} THEN 1 ELSE -1 END") for v in (1, 2, 3, 4)] + [(5, "1")]]
    return ", haar AS (" + " UNION ALL ".join(parts) + ")"


def daubechies() -> str:
    """(capture_id, level, d): details of four levels of the eight-tap filter bank, mirrored at the ends."""
    low = sp.DB4_LOW
    high = [-((-1) ** j) * low[7 - j] for j in range(8)]
    taps = ", ".join(f"({j}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for j, (a, b) in enumerate(zip(low, high, strict=True)))
    out, n = f", taps(j, lo, hi) AS (VALUES {taps}), w0 AS (SELECT capture_id, n, i AS x FROM iq)", 32
    for level in (1, 2, 3, 4):
        place = f"(2 * t.k + 1 - j + {8 * n}) % {2 * n}"
        out += f", w{level} AS (SELECT capture_id, k AS n, sum(lo * x) AS x, sum(hi * x) AS d FROM (SELECT k, lo, hi, CASE WHEN {place} < {n} THEN {place} ELSE {2 * n - 1} - {place} END AS n FROM taps, range({(n + 7) // 2}) t(k)) z JOIN w{level - 1} USING (n) GROUP BY ALL)"
        n = (n + 7) // 2
    return out + ", fine AS (" + " UNION ALL ".join(f"SELECT capture_id, {v} AS level, d FROM w{v}" for v in (1, 2, 3, 4)) + ")"


FT15 = IQ + haar() + daubechies() + f""", h AS (SELECT *, sqrt(i * i + q * q) AS c FROM haar), hg AS (SELECT capture_id, level, -sum(c * ln(c + 1e-10)) AS e, avg(abs(i) ** 3) AS c3, avg(i) AS mi, avg(q) AS mq, sum(c * c) AS en FROM h GROUP BY ALL),
fg AS (SELECT capture_id, level, avg(abs(d) ** 3) AS d3, avg(d ** 4) AS d4 FROM fine GROUP BY ALL), f AS (SELECT capture_id, avg(d3) AS d3, avg(d4) AS d4 FROM fg GROUP BY 1)
SELECT capture_id, {r(wavelet_entropy="sum(e) ** 2", wavelet_detail_mean="sqrt(any_value(mi) FILTER (level = 1) ** 2 + any_value(mq) FILTER (level = 1) ** 2)", wavelet_detail_energy="any_value(en) FILTER (level = 1)", wavelet_cubic="avg(c3)", wavelet4_cubic="any_value(d3)", wavelet4_quartic="any_value(d4)")} FROM hg JOIN f USING (capture_id) GROUP BY capture_id"""


def ft16_filtered_features(spark, sf):
    return features(spark, sf, "filters", "gaussian_sum", "adaptive_gaussian_sum", "adaptive_bandwidth")


#: A symmetric kernel that is mirrored at the ends keeps the sum.
FT16 = DFT + f" SELECT capture_id, {r(gaussian_sum='sum(a * a)', adaptive_gaussian_sum='sum(a * a)', adaptive_bandwidth='greatest(0.1, least(2.0, stddev_pop(a * a) / avg(a * a)))::DOUBLE')} FROM m GROUP BY capture_id"


def win8_rolling_entropy(spark, sf):
    return features(spark, sf, "rolling", "rolling_entropy_16")


WIN8 = DFT + """, w AS (SELECT capture_id, t, a, sum(a) OVER (PARTITION BY capture_id, t) AS s FROM m, range(3) z(t) WHERE k >= 8 * t AND k < 8 * t + 16), e AS (SELECT capture_id, t, -sum(a / s * log2(a / s + 1e-10)) AS e FROM w GROUP BY ALL)
SELECT capture_id, round(avg(e), 6) + 0.0 AS rolling_entropy_16 FROM e GROUP BY 1"""


def ft_band_pass(spark, sf):
    """Envelopes behind the band-pass filter."""
    return features(spark, sf, "filters", "band_pass_rms")


def filtered_sql(name: str, source: str, last: int) -> str:
    """A difference equation over (capture_id, t, x), t from 0 to ``last``: before the first sample there has always been that sample,
    of which a band-pass lets nothing through."""
    b, a = ("[" + ", ".join(f"{v:.17g}::DOUBLE" for v in c) + "]" for c in sp.butterworth_band(4, 0.1, 0.6))
    y = f"{b}[1] * {{x}} + list_sum(list_transform(range(2, 10), lambda k: {b}[k] * xs[k - 1] - {a}[k] * ys[k - 1]))"
    first = f"SELECT capture_id, 0 AS t, x, list_transform(range(8), lambda k: x) AS xs, list_transform(range(8), lambda k: 0.0::DOUBLE) AS ys FROM {source} WHERE t = 0"
    return f""", {name} AS (SELECT capture_id, t, x, {y.format(x="x")} AS y, xs, ys FROM ({first}) UNION ALL
SELECT capture_id, t, x, {y.format(x="x")} AS y, xs, ys FROM (SELECT p.capture_id, e.t, e.x, list_prepend(p.x, p.xs[1:7]) AS xs, list_prepend(p.y, p.ys[1:7]) AS ys FROM {name} p JOIN {source} e ON e.capture_id = p.capture_id AND e.t = p.t + 1 WHERE p.t < {last}))"""


BAND = IQ.replace("WITH ", "WITH RECURSIVE ", 1) + """, ends AS (SELECT capture_id, max(i) FILTER (n = 0) AS head, max(i) FILTER (n = 31) AS tail FROM iq GROUP BY 1),
ext AS (SELECT capture_id, n + 27 AS t, i AS x FROM iq UNION ALL SELECT capture_id, 27 - n, 2 * head - i FROM iq JOIN ends USING (capture_id) WHERE n BETWEEN 1 AND 27 UNION ALL SELECT capture_id, 89 - n, 2 * tail - i FROM iq JOIN ends USING (capture_id) WHERE n BETWEEN 4 AND 30)""" + filtered_sql("forth", "ext", 85) + """,
turned AS (SELECT capture_id, 85 - t AS t, y AS x FROM forth)""" + filtered_sql("back", "turned", 85) + ", banded AS (SELECT capture_id, 58 - t AS n, y AS i FROM back WHERE t BETWEEN 27 AND 58)" + analytic("x", "banded") + f" SELECT capture_id, {r(band_pass_rms='sqrt(avg(e * e))')} FROM x GROUP BY capture_id"


def ft_all_features(spark, sf):
    """All families; long form, aggregated to one row per feature."""
    rows = ft.long_features(ft.extract_features(windows(spark, sf)))
    return rows.groupBy("feature").agg(F.count("value").alias("known"), r6(F.avg("value")).alias("mean"))


def arr12_spectrogram(spark, sf):
    rows = ft.spectrogram_rows(windows(spark, sf), 8, 4, 7).select("capture_id", "time_bin", F.posexplode(F.arrays_zip("re", "im")).alias("freq_bin", "v"))
    return rows.select("capture_id", "time_bin", "freq_bin", r6(F.col("v.re")).alias("re"), r6(F.col("v.im")).alias("im"))


ARR12 = IQ + f""", fr AS (SELECT capture_id, t::INT AS t, n - 4 * t AS n, i * (0.5 - 0.5 * cos({TAU} * (n - 4 * t) / 7)) AS i, q * (0.5 - 0.5 * cos({TAU} * (n - 4 * t) / 7)) AS q FROM iq, range(7) r(t) WHERE n >= 4 * t AND n < 4 * t + 8),
b AS (SELECT capture_id, t, k, sum(i * cos({TAU} * k * n / 8) + q * sin({TAU} * k * n / 8)) / 8 AS re, sum(q * cos({TAU} * k * n / 8) - i * sin({TAU} * k * n / 8)) / 8 AS im FROM fr, range(8) r(k) GROUP BY ALL),
s AS (SELECT capture_id, sqrt((sum(re * re) + sum(im * im)) / 112 - ((sum(re) + sum(im)) / 112) ** 2) + 1e-6 AS sd FROM b GROUP BY 1)
SELECT capture_id, t AS time_bin, ((k + 4) % 8)::INT AS freq_bin, round(greatest(-6.0::DOUBLE, least(6.0::DOUBLE, re / sd)), 6) + 0.0 AS re, round(greatest(-6.0::DOUBLE, least(6.0::DOUBLE, im / sd)), 6) + 0.0 AS im FROM b JOIN s USING (capture_id)"""


def cells(rows, *arrays):
    """One row per time and frequency bin of array columns, rounded."""
    long = rows.select("capture_id", "time_bin", F.posexplode(F.arrays_zip(*arrays)).alias("freq_bin", "v"))
    return long.select("capture_id", "time_bin", "freq_bin", *[r6(F.col(f"v.{c}")).alias(c) for c in arrays])


def frames_sql(source: str, starts: list[int], size: int = 8) -> str:
    """Frames at the given starts under a symmetric Hann window, and their transforms b (capture_id, t, k, re, im)."""
    places = ", ".join(f"({t}, {s})" for t, s in enumerate(starts))
    hann, angle = f"(0.5 - 0.5 * cos({TAU} * (n - s) / {size - 1}))", f"{TAU} * k * n / {size}"
    return f""", fr AS (SELECT capture_id, t, n - s AS n, i * {hann} AS i, q * {hann} AS q FROM {source}, (VALUES {places}) z(t, s) WHERE n >= s AND n < s + {size}),
b AS (SELECT capture_id, t, k::INT AS k, sum(i * cos({angle}) + q * sin({angle})) AS re, sum(q * cos({angle}) - i * sin({angle})) AS im FROM fr, range({size}) y(k) GROUP BY ALL)"""


def clip_sql(x: str) -> str:
    return f"round(greatest(-6.0::DOUBLE, least(6.0::DOUBLE, {x})), 6) + 0.0"


def standardised_sql(source: str, cells: int) -> str:
    return f""", s AS (SELECT capture_id, sqrt((sum(re * re) + sum(im * im)) / {2 * cells} - ((sum(re) + sum(im)) / {2 * cells}) ** 2) + 1e-6 AS sd FROM {source} GROUP BY 1)
SELECT capture_id, t::INT AS time_bin, ((k + 4) % 8)::INT AS freq_bin, {clip_sql("re / sd")} AS re, {clip_sql("im / sd")} AS im FROM {source} JOIN s USING (capture_id)"""


def arr13_interpolated(spark, sf):
    """Seven frames drawn out to eleven time bins."""
    return cells(ft.spectrogram_rows(windows(spark, sf), 8, 4, 11), "re", "im")


ARR13 = IQ + frames_sql("iq", [4 * t for t in range(7)]) + """, pl AS (SELECT t, floor(t * 0.6::DOUBLE)::INT AS lo, least(6, floor(t * 0.6::DOUBLE)::INT + 1) AS hi, t * 0.6::DOUBLE - floor(t * 0.6::DOUBLE) AS part FROM range(11) z(t)),
d AS (SELECT x.capture_id, pl.t, x.k, (x.re * (1 - part) + y.re * part) / 8 AS re, (x.im * (1 - part) + y.im * part) / 8 AS im FROM pl JOIN b x ON x.t = lo JOIN b y ON y.t = hi AND y.capture_id = x.capture_id AND y.k = x.k)""" + standardised_sql("d", 88)


def arr13_nearest(spark, sf):
    """Seven frames thinned to four time bins."""
    return cells(ft.spectrogram_rows(windows(spark, sf), 8, 4, 4, resize="nearest"), "re", "im")


ARR13N = IQ + frames_sql("iq", [0, 8, 16, 24]) + ", d AS (SELECT capture_id, t, k, re / 8 AS re, im / 8 AS im FROM b)" + standardised_sql("d", 32)


def arr13_spaced_starts(spark, sf):
    """Frames at five evenly spaced starts."""
    return cells(ft.spectrogram_rows(windows(spark, sf), 8, 4, 5, resize="starts"), "re", "im")


ARR13S = IQ + frames_sql("iq", [0, 6, 12, 18, 24]) + ", d AS (SELECT capture_id, t, k, re / 8 AS re, im / 8 AS im FROM b)" + standardised_sql("d", 40)


def arr15_channels(spark, sf):
    return cells(ft.channel_rows(windows(spark, sf), 8, 5), "re", "im", "logmag", "phase")


CHANNELS = {"re": "re", "im": "im", "logmag": "ln(1 + sqrt(re * re + im * im))", "phase": "atan2(im, re) / pi()"}
ARR15 = IQ + ", m AS (SELECT capture_id, avg(i) AS mi, avg(q) AS mq FROM iq GROUP BY 1), c AS (SELECT capture_id, n, i - mi AS i, q - mq AS q FROM iq JOIN m USING (capture_id)), w AS (SELECT capture_id, sqrt(avg(i * i + q * q)) + 1e-6 AS rms FROM c GROUP BY 1), x AS (SELECT capture_id, n, i / rms AS i, q / rms AS q FROM c JOIN w USING (capture_id))" + frames_sql("x", [0, 6, 12, 18, 24]) + f""",
v AS (SELECT capture_id, t, k, {", ".join(f"{x} AS {n}" for n, x in CHANNELS.items())} FROM b), g AS (SELECT capture_id, {", ".join(f"avg({n}) AS {n}_m, stddev_pop({n}) + 1e-6 AS {n}_s" for n in CHANNELS)} FROM v GROUP BY 1)
SELECT capture_id, t::INT AS time_bin, ((k + 4) % 8)::INT AS freq_bin, {", ".join(f"{clip_sql(f'({n} - {n}_m) / {n}_s')} AS {n}" for n in CHANNELS)} FROM v JOIN g USING (capture_id)"""


def arr16_spectrum_view(spark, sf):
    return rounded(ft.spectrum_view(windows(spark, sf)))


ARR16 = DFT + " SELECT capture_id, ((k + 16) % 32)::INT AS bin, round(f, 6) + 0.0 AS frequency, round(20 * log10(a + 1e-8), 6) + 0.0 AS db FROM m"


def arr17_waterfall(spark, sf):
    return rounded(ft.waterfall_cells(ft.waterfall(windows(spark, sf), 8), 8, centre_hz=2.47e9))


ARR17 = IQ + frames_sql("iq", [4 * t for t in range(7)]) + """, d AS (SELECT *, 20 * log10(sqrt(re * re + im * im) + 1e-8) AS db FROM b), g AS (SELECT capture_id, quantile_cont(db, 0.05) AS low, quantile_cont(db, 0.995) AS high FROM d GROUP BY 1)
SELECT capture_id, t::INT AS column, ((k + 4) % 8)::INT AS freq_bin, round(4 * t / 2e7 * 1000, 6) + 0.0 AS time_ms, round((((k + 4) % 8 - 4) / 8 * 2e7 + 2.47e9) / 1e6, 6) + 0.0 AS frequency_mhz, round(db, 6) + 0.0 AS db, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high FROM d JOIN g USING (capture_id)"""


def samples_of(rows):
    long = rows.select("capture_id", F.posexplode(F.arrays_zip("i", "q")).alias("n", "s"))
    return long.select("capture_id", "n", r6(F.col("s.i")).alias("i"), r6(F.col("s.q")).alias("q"))


def arr22_fft_denoised(spark, sf):
    return samples_of(ft.denoised_windows(windows(spark, sf), 5.0))


def one_channel(c: str) -> str:
    angle = f"{TAU} * k * n / 32"
    return transformed(f"{c}t", f"(SELECT capture_id, n, {c} AS i, 0.0::DOUBLE AS q FROM iq)") + f""", {c}d AS (SELECT capture_id, 5 * stddev_samp({c}) AS least FROM iq GROUP BY 1),
{c}o AS (SELECT capture_id, n::INT AS n, sum(CASE WHEN a > least THEN re * cos({angle}) - im * sin({angle}) ELSE 0 END) / 32 AS v FROM {c}t JOIN {c}d USING (capture_id), range(32) y(n) GROUP BY ALL)"""


ARR22F = IQ + one_channel("i") + one_channel("q") + " SELECT capture_id, n, round(io.v, 6) + 0.0 AS i, round(qo.v, 6) + 0.0 AS q FROM io JOIN qo USING (capture_id, n)"


def arr22_gaussian(spark, sf):
    return samples_of(ft.denoised_windows(windows(spark, sf), sigma=2.0))


ARR22G = IQ + """, w AS (SELECT j, exp(-0.5 * (j / 2.0) ** 2) / sum(exp(-0.5 * (j / 2.0) ** 2)) OVER () AS w FROM range(-8, 9) t(j)), z AS (SELECT t.n::INT AS k, w, CASE WHEN (t.n + j + 64) % 64 < 32 THEN (t.n + j + 64) % 64 ELSE 63 - (t.n + j + 64) % 64 END AS n FROM w, range(32) t(n))
SELECT capture_id, k AS n, round(sum(w * i), 6) + 0.0 AS i, round(sum(w * q), 6) + 0.0 AS q FROM z JOIN iq USING (n) GROUP BY ALL"""


def win1_smoothed_power(spark, sf):
    rows = ft.smoothed_rows(windows(spark, sf), 4).select("capture_id", F.posexplode("smooth").alias("n", "smooth"))
    return rounded(rows)


WIN1 = IQ + " SELECT capture_id, n, round(sum((i * i + q * q) / 2) OVER (PARTITION BY capture_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 6) + 0.0 AS smooth FROM iq"


def arr10_spaced_bursts(spark, sf):
    return ft.spaced_burst_starts(windows(spark, sf), 8, 3, 6, 4)


#: Starts in the order of their smoothed power, each taken if it is far from those taken before. With room for all starts that fit, none is drawn.
ARR10 = IQ.replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS (SELECT capture_id, n, sum(i * i + q * q) OVER (PARTITION BY capture_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s FROM iq),
o AS (SELECT capture_id, greatest(0, least(n - 4, 24))::INT AS start, row_number() OVER (PARTITION BY capture_id ORDER BY s DESC, n) AS k FROM p),
fold AS (SELECT capture_id, 1 AS k, [start] AS starts FROM o WHERE k = 1 UNION ALL
SELECT o.capture_id, o.k::INT, CASE WHEN len(f.starts) < 4 AND len(list_filter(f.starts, lambda x: abs(x - o.start) < 6)) = 0 THEN list_append(f.starts, o.start) ELSE f.starts END FROM fold f JOIN o ON o.capture_id = f.capture_id AND o.k = f.k + 1)
SELECT capture_id, (v - 1)::INT AS view_idx, starts[v] AS start FROM (SELECT capture_id, starts, unnest(range(1, len(starts) + 1)) AS v FROM fold WHERE k = 32)"""


def live_chunks(spark, sf, *more):
    """Chunks of a sample each, with ``more`` columns of theirs."""
    rows = chunks(spark, sf)
    level = F.sqrt(F.pow(F.lit(10.0), F.col("power_db") / 10) / 2)
    return rows.select("stream_id", "seq", F.array(level).alias("i"), F.array(level).alias("q"), "power_db", *more)


TRIGGER = live.Trigger(floor_chunks=20, above_db=4.0, pretrigger=2, window=5, cooldown=3)


def str4_noise_floors(spark, sf):
    """Floors as the trigger's state finds them."""
    events = drained(live.triggered(recorded(live_chunks(spark, sf)), TRIGGER))
    return events.filter("kind = 'floor'").select("stream_id", "seq", r6(F.col("floor")).alias("floor"))


STR4 = with_tables("chunks") + " SELECT stream_id, 19::BIGINT AS seq, round(median(power_db), 6) + 0.0 AS floor FROM chunks WHERE seq < 20 GROUP BY 1 HAVING count(*) = 20"


def str5_triggered_captures(spark, sf):
    events = drained(live.triggered(recorded(live_chunks(spark, sf)), TRIGGER))
    return events.filter("kind = 'capture'").select("stream_id", "seq", r6(F.col("power_db")).alias("power_db"), F.size("i").alias("samples"))


#: Each capture starts at the first loud chunk behind the last one's cool-down; its ring holds two chunks, fewer right behind the floor.
STR5 = with_tables("chunks").replace("WITH ", "WITH RECURSIVE ", 1) + """, fl AS (SELECT stream_id, median(power_db) AS floor FROM chunks WHERE seq < 20 GROUP BY 1 HAVING count(*) = 20), ends AS (SELECT stream_id, max(seq) AS last FROM chunks GROUP BY 1),
hits AS (SELECT stream_id, seq, power_db FROM chunks JOIN fl USING (stream_id) WHERE seq >= 20 AND power_db >= floor + 4),
step AS (SELECT stream_id, min(seq) AS s FROM hits GROUP BY 1 UNION ALL SELECT p.stream_id, min(h.seq) FROM step p JOIN hits h ON h.stream_id = p.stream_id AND h.seq >= p.s + 8 - least(2, p.s - 20) GROUP BY p.stream_id, p.s)
SELECT stream_id, s AS seq, round(power_db, 6) + 0.0 AS power_db, 5 AS samples FROM step JOIN ends USING (stream_id) JOIN hits h USING (stream_id) WHERE h.seq = s AND s + 4 - least(2, s - 20) <= last"""


def ended(spark, sf):
    """The streams of chunks, each with an empty chunk at its end."""
    rows = live_chunks(spark, sf)
    none = F.expr("cast(array() as array<double>)")
    last = rows.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq")).select("stream_id", "seq", none.alias("i"), none.alias("q"), F.lit(-120.0).alias("power_db"))
    return rows.unionByName(last)


def str5_padded_captures(spark, sf):
    """With an end of the stream: what was being captured is padded."""
    events = drained(live.triggered(recorded(ended(spark, sf)), TRIGGER))
    return events.filter("kind = 'capture'").select("stream_id", "seq", F.size("i").alias("samples"), F.size(F.filter("i", lambda v: v == 0)).alias("padded"))


STR5P = STR5[: STR5.index("SELECT stream_id, s AS seq, round(power_db")] + "SELECT stream_id, s AS seq, 5 AS samples, greatest(0, s + 4 - least(2, s - 20) - last)::INT AS padded FROM step JOIN ends USING (stream_id)"


def str6_fixed_captures(spark, sf):
    out = drained(live.fixed_captures(recorded(live_chunks(spark, sf)), 5, discard=3))
    return out.select("stream_id", "seq", r6(mean_of(F.col("i"))).alias("mean"))


STR6 = with_tables("chunks") + " SELECT stream_id, 3::BIGINT AS seq, round(avg(sqrt(10 ** (power_db / 10) / 2)), 6) + 0.0 AS mean FROM chunks WHERE seq >= 3 AND seq < 8 GROUP BY 1 HAVING count(*) = 5"


def str3_chunk_powers(spark, sf):
    return rounded(drained(live.chunk_powers(recorded(live_chunks(spark, sf)))))


STR3 = with_tables("chunks") + " SELECT stream_id, seq, round(10 * log10(10 ** (power_db / 10) + 1e-12), 6) + 0.0 AS power_db FROM chunks"


def str3_windowed_powers(spark, sf):
    return rounded(live.windowed_powers(chunks(spark, sf), "1 day"))


STR3W = with_tables("chunks") + " SELECT stream_id, date_trunc('day', ts) AS start, count(*) AS chunks, round(10 * log10(avg(10 ** (power_db / 10))), 6) + 0.0 AS power_db, round(max(power_db), 6) + 0.0 AS peak_db FROM chunks GROUP BY ALL"


def str7_candidate_windows(spark, sf):
    rows = win.replay_windows(captures(spark, sf), 12, 5)
    return rows.select("capture_id", "start", r6(mean_of(F.transform("iq", lambda s: s.i))).alias("mean_i"))


STR7 = IQ + " SELECT capture_id, s::INT AS start, round(avg(i), 6) + 0.0 AS mean_i FROM iq, (VALUES (0), (5), (10), (15), (20)) z(s) WHERE n >= s AND n < s + 12 GROUP BY ALL"


def str2_rechunked(spark, sf):
    frames = chunks(spark, sf).select("stream_id", "seq", F.array_repeat("power_db", 3).alias("i"), F.array_repeat(F.lit(0.0), 3).alias("q"))
    out = drained(live.rechunked(recorded(frames), 7))
    return out.groupBy("stream_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("seq").alias("last"), r6(F.sum(F.aggregate("i", F.lit(0.0), lambda s, x: s + x))).alias("total"))


STR2 = with_tables("chunks") + """, s AS (SELECT stream_id, 3 * seq + r AS p, power_db, 3 * count(*) OVER (PARTITION BY stream_id, r) AS n FROM chunks, range(3) t(r))
SELECT stream_id, any_value(n // 7)::BIGINT AS chunks, any_value(n // 7 - 1)::BIGINT AS last, round(sum(power_db), 6) + 0.0 AS total FROM s WHERE p < n // 7 * 7 GROUP BY 1"""


def str9_rolling_summary(spark, sf):
    rows = predictions(spark, sf).select("ts", F.col("y_true").alias("condition"), (F.col("y_pred") != "view").alias("alert"), "confidence")
    out = live.rolling_summary(rows, "1 day")
    return out.withColumn("mean_confidence", F.round("mean_confidence", 12))


STR9 = with_tables("predictions") + " SELECT date_trunc('day', ts) AS start, y_true AS condition, count(*) AS events, sum((y_pred <> 'view')::INT)::BIGINT AS alerts, round(sum(confidence::DECIMAL(28, 12))::DOUBLE / count(*), 12) AS mean_confidence FROM predictions GROUP BY ALL"


def dec10_forest_importances(spark, sf):
    from ..operators.scoring import forest_importances

    names = ["avg_symbol_power", "papr", "mag_variance", "zero_crossing_rate", "inst_freq_std"]
    rows = ft.extract_features(windows(spark, sf), ("power", "moments", "crossings", "phase"), selected=names).na.fill(0.0)
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("capture_id"), F.col("label").cast("double").alias("label"))
    return rounded(forest_importances(rows.join(labels, "capture_id"), names, trees=5)[1])


def dec10_held_out(spark, sf):
    """A forest that learns which windows peak four times above their mean, from four fifths of them."""
    from ..operators.scoring import forest_importances, held_out_accuracy

    names = ["avg_symbol_power", "papr", "mag_variance", "zero_crossing_rate"]
    rows = ft.extract_features(windows(spark, sf), ("power", "moments", "crossings"), selected=names).na.fill(0.0)
    rows = rows.withColumn("label", (F.col("papr") >= 4.0).cast("double"))
    model, importances = forest_importances(rows.filter("capture_id % 5 > 0"), names, trees=9)
    found = held_out_accuracy(model, rows.filter("capture_id % 5 = 0"), names)
    total = importances.agg(F.sum("importance").alias("total"), F.max_by("feature", "importance").alias("most"))
    return found.crossJoin(F.broadcast(total)).select("rows", "majority", (F.col("right") >= 0.9 * F.col("rows")).alias("learnt"), (F.col("right") > F.col("majority")).alias("better"), F.round("total", 6).alias("total"), "most")


DEC10 = IQ + """, p AS (SELECT capture_id, (max(i * i + q * q) / (avg(i * i + q * q) + 1e-12) >= 4)::INT AS label FROM iq WHERE capture_id % 5 = 0 GROUP BY 1)
SELECT count(*) AS rows, greatest(sum(label), count(*) - sum(label))::BIGINT AS majority, true AS learnt, true AS better, 1.0::DOUBLE AS total, 'papr' AS most FROM p"""


QUERIES = {n: f for n, f in list(globals().items()) if n.split("_")[0].rstrip("0123456789") in ("ft", "arr", "str", "dec", "win") and callable(f) and getattr(f, "__module__", "") == __name__}
ORACLES = {"ft1_time_features": FT1, "dec10_held_out": DEC10, "arr10_spaced_bursts": ARR10, "ft_band_pass": BAND, "ft2_complex_moments": FT2, "ft9_kernel_forms": FT9K, "ft12_quadratic_kernel": FT12Q, "ft4_phase_features": FT4, "ft5_constellation": FT5, "ft6_envelope_features": FT6, "ft7_analytic_phase": FT7, "ft8_spectrum_features": FT8, "ft9_spectrum_shape": FT9, "ft10_band_energy": FT10, "ft11_spectral_peaks": FT11, "ft12_welch_features": FT12, "ft13_stft_features": FT13,
           "ft14_autocorrelation": FT14, "ft15_wavelet_features": FT15, "ft16_filtered_features": FT16, "win8_rolling_entropy": WIN8, "win1_smoothed_power": WIN1, "arr13_interpolated": ARR13, "arr13_nearest": ARR13N, "arr13_spaced_starts": ARR13S, "arr15_channels": ARR15, "arr16_spectrum_view": ARR16, "arr17_waterfall": ARR17, "arr22_fft_denoised": ARR22F, "arr22_gaussian": ARR22G,
           "str3_chunk_powers": STR3, "str3_windowed_powers": STR3W, "str5_triggered_captures": STR5, "str5_padded_captures": STR5P, "str6_fixed_captures": STR6, "str7_candidate_windows": STR7, "arr12_spectrogram": ARR12, "str4_noise_floors": STR4, "str2_rechunked": STR2, "str9_rolling_summary": STR9}
