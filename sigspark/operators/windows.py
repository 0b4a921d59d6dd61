"""Windows over captures: cutting, padding, normalising, bursts, views, augmentation. Arrays stay in their rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, mean_of

ZERO = "named_struct('i', 0D, 'q', 0D)"


def complex_from_flat(flat: Column) -> Column:
    """De-interleaves I, Q, I, Q, ...; an odd tail goes."""
    n = F.floor(F.size(flat) / 2).cast("int")
    pair = lambda k: F.struct(F.element_at(flat, 2 * k + 1).cast("double").alias("i"), F.element_at(flat, 2 * k + 2).cast("double").alias("q"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.expr("cast(array() as array<struct<i: double, q: double>>)"))


def complex_from_channels(rows: Column) -> Column:
    """From two arrays of the same length, I and Q; nested rows of another shape are (n, 2), except 2 x 2, which is read as rows too."""
    first = F.element_at(rows, 1)
    by_channel = (F.size(rows) == 2) & (F.size(first) != 2)
    channels = F.zip_with(first, F.element_at(rows, 2), lambda i, q: F.struct(i.cast("double").alias("i"), q.cast("double").alias("q")))
    pairs = F.transform(rows, lambda r: F.struct(F.element_at(r, 1).cast("double").alias("i"), F.element_at(r, 2).cast("double").alias("q")))
    return F.when(by_channel, channels).otherwise(pairs)


def zero_padded(iq: Column, length: int) -> Column:
    return F.concat(iq, F.when(F.size(iq) < length, F.array_repeat(F.expr(ZERO), F.lit(length) - F.size(iq))).otherwise(F.expr("cast(array() as array<struct<i: double, q: double>>)")))


def cut(iq: Column, start: Column, length: int) -> Column:
    return F.slice(iq, start.cast("int") + 1, length)


def sample(i: Column, q: Column) -> Column:
    return F.struct(i.alias("i"), q.alias("q"))


def centred(iq: Column) -> Column:
    """Minus the mean of each channel."""
    means = lambda x: F.struct(mean_of(F.transform(x, lambda s: s.i)).alias("i"), mean_of(F.transform(x, lambda s: s.q)).alias("q"))
    return let(iq, lambda x: let(means(x), lambda m: F.transform(x, lambda s: sample(s.i - m.i, s.q - m.q))))


def scaled(iq: Column, by: Column) -> Column:
    return let(by, lambda d: F.transform(iq, lambda s: sample(s.i / d, s.q / d)))


def mean_square(iq: Column) -> Column:
    """Mean over both channels."""
    return mean_of(F.transform(iq, lambda s: (s.i * s.i + s.q * s.q) / 2))


def normalised(df: DataFrame, column: str = "iq") -> DataFrame:
    """Centres each channel and divides by the root of the mean square over both, plus 1e-8."""
    return df.withColumn(column, let(centred(F.col(column)), lambda c: scaled(c, F.sqrt(mean_square(c) + 1e-8))))


def max_abs(iq: Column) -> Column:
    return F.array_max(F.transform(iq, lambda s: F.greatest(F.abs(s.i), F.abs(s.q))))


def max_abs_normalised(iq: Column, floor: float = 1e-12) -> Column:
    return scaled(iq, max_abs(iq) + F.lit(floor))


def channel_normalised(iq: Column) -> Column:
    """Each channel by its own largest absolute value; an all-zero channel stays."""
    top = lambda c: F.array_max(F.transform(iq, lambda s: F.abs(s[c])))
    one = lambda a: F.when(a == 0, 1.0).otherwise(a)
    tops = F.struct(one(top("i")).alias("i"), one(top("q")).alias("q"))
    return let(tops, lambda m: F.transform(iq, lambda s: sample(s.i / m.i, s.q / m.q)))


def tiled(iq: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.element_at(iq, (k % F.size(iq) + 1).cast("int")))


def rms_clipped(iq: Column, length: int, limit: float = 5.0) -> Column:
    """Tiled to ``length``, centred, divided by the RMS of the complex power, clipped."""
    clip = lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x))
    rms = lambda c: F.sqrt(mean_square(c) * 2 + 1e-12)
    return let(centred(tiled(iq, length)), lambda c: let(rms(c), lambda d: F.transform(c, lambda s: sample(clip(s.i / d), clip(s.q / d)))))


def with_channel(iq: Column, value) -> Column:
    """Adds a third channel c: of a function of the sample, or a column."""
    return F.transform(iq, lambda s: F.struct(s.i.alias("i"), s.q.alias("q"), (value(s) if callable(value) else value).cast("double").alias("c")))


def with_snr(iq: Column, snr: Column, scale: float = 20.0) -> Column:
    return with_channel(iq, snr / scale)


def with_envelope(iq: Column) -> Column:
    return with_channel(iq, lambda s: F.hypot(s.i, s.q))


def candidate_starts(n: Column, window: int, stride: int) -> Column:
    """0, stride, ..., and the last start; [0] for short captures."""
    last = (n - window).cast("int")
    return F.when(last > 0, F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))).otherwise(F.array(F.lit(0)))


def frame_starts(n: Column, nfft: int, hop: int) -> Column:
    last = (n - nfft).cast("int")
    return F.when(last > 0, F.sequence(F.lit(0), last, F.lit(hop))).otherwise(F.array(F.lit(0)))


def starts_around(burst: Column, n: Column, window: int, views: int) -> Column:
    """Sorted distinct starts at offsets (k - (views - 1) / 2) * stride around a burst, clipped, truncated."""
    stride = max(1, window // max(4, views + 1))
    last = F.greatest(F.lit(0), n - window)
    at = lambda k: F.greatest(F.lit(0), F.least(last, (burst + (k - (views - 1) / 2) * stride).cast("int"))).cast("int")
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(views - 1)), at)))


def seeded_start(path: Column, view: Column, seed: int, n: Column, window: int, strongest: Column) -> Column:
    """View 0 is the strongest window; others start at a place derived from sha1 of path, view and seed."""
    number = F.conv(F.substring(F.sha1(F.concat_ws("|", path, view.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("long")
    return F.when(view == 0, strongest).otherwise(F.pmod(number, F.greatest(F.lit(1), n - window + 1))).cast("int")


def capture_stats(df: DataFrame, key: str = "capture_id") -> DataFrame:
    """(key, power_db, peak, i_clip_pct, q_clip_pct, fullscale_pct, warning), from the samples inside each row."""
    magnitude = lambda s: F.hypot(s.i, s.q)
    share = lambda test: mean_of(F.transform("iq", lambda s: F.when(test(s), 100.0).otherwise(0.0)))
    out = df.select(
        key, (10 * F.log10(mean_of(F.transform("iq", lambda s: s.i * s.i + s.q * s.q)) + F.lit(1e-12))).alias("power_db"), F.array_max(F.transform("iq", magnitude)).alias("peak"),
        share(lambda s: F.abs(s.i) >= 0.99).alias("i_clip_pct"), share(lambda s: F.abs(s.q) >= 0.99).alias("q_clip_pct"), share(lambda s: magnitude(s) >= 1.0).alias("fullscale_pct"),
    )
    return out.withColumn("warning", (F.col("i_clip_pct") > 0.1) | (F.col("q_clip_pct") > 0.1) | (F.col("fullscale_pct") > 0.5))


def rotated_views(df: DataFrame, views: int) -> DataFrame:
    """Each row ``views`` times, multiplied by exp(2 pi j k / views)."""
    rows = df.withColumn("view_idx", F.explode(F.sequence(F.lit(0), F.lit(views - 1))))
    angle = F.col("view_idx") * (2 * math.pi / views)
    c, s = F.cos(angle), F.sin(angle)
    return rows.withColumn("iq", F.transform("iq", lambda x: F.struct((x.i * c - x.q * s).alias("i"), (x.i * s + x.q * c).alias("q"))))


def hash_uniform(*parts: Column) -> Column:
    """A number above 0 and up to 1 from a hash: the same whatever the partitioning."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2**40)) + 1) / F.lit(float(2**40))


#: No ``hash_normal`` is further from 0: its first hash has 40 bits.
FURTHEST = math.sqrt(80 * math.log(2))


def hash_normal(*parts: Column) -> Column:
    """A standard normal number by Box-Muller from two hashes."""
    return F.sqrt(-2 * F.log(hash_uniform(*parts, F.lit(1)))) * F.cos(hash_uniform(*parts, F.lit(2)) * (2 * math.pi))


def augmented(df: DataFrame, copies: int, seed: int, noise: Column | float = 0.005, scale: Column | float = 0.0, shift: int = 0, key: str = "capture_id") -> DataFrame:
    """Rows with copy 0 as they are, and ``copies`` more with normal noise, a random factor and a circular shift."""
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    part = [F.lit(seed), F.col(key), F.col("copy")]
    factor = 1 + (scale if isinstance(scale, Column) else F.lit(scale)) * hash_normal(*part, F.lit("scale"))
    noise = noise if isinstance(noise, Column) else F.lit(noise)
    n = F.size("iq")
    by = F.pmod(F.xxhash64(*part, F.lit("shift")), F.lit(2 * shift + 1)) - shift if shift else F.lit(0)
    turned = F.when(by == 0, F.col("iq")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.element_at("iq", (F.pmod(k + by, n) + 1).cast("int"))))
    moved = F.transform(turned, lambda s, k: F.struct(
        (s.i * factor + noise * hash_normal(*part, k, F.lit("i"))).alias("i"), (s.q * factor + noise * hash_normal(*part, k, F.lit("q"))).alias("q")))
    return rows.withColumn("iq", F.when(F.col("copy") == 0, F.col("iq")).otherwise(moved))


def progressively_augmented(df: DataFrame, epoch: int, total: int, seed: int, share: float = 0.5, noise: float = 0.05, scale: float = 0.1, shift: int = 8, key: str = "capture_id") -> DataFrame:
    """Adds one changed copy of a share of the rows; share, noise, factor and shift shrink as training goes on."""
    left = max(0.0, 1 - epoch / total)
    rows = augmented(df, 1, seed + epoch, noise * left, scale * left, int(shift * left), key)
    return rows.filter((F.col("copy") == 0) | (hash_uniform(F.lit(seed + epoch), F.col(key), F.lit("share")) <= share * left))


def replay_ready(iq: Column, length: int, amplitude: float = 0.8, silence: int = 0) -> Column:
    """Mean removed, peak set to ``amplitude``, silence on both ends, tiled to ``length``."""
    quiet = F.array_repeat(F.expr(ZERO), silence) if silence else F.expr("cast(array() as array<struct<i: double, q: double>>)")
    peak = lambda c: F.array_max(F.transform(c, lambda s: F.hypot(s.i, s.q))) + F.lit(1e-12)
    loud = let(centred(iq), lambda c: scaled(c, peak(c) / amplitude))
    return let(F.concat(quiet, loud, quiet), lambda x: tiled(x, length))


def three_tap(iq: Column, passes: int = 1) -> Column:
    """Repeated mean over a sample and its two neighbours, zero beyond the ends."""

    def once(x: Column) -> Column:
        near = lambda k, c: F.when(k >= 1, F.element_at(x, F.greatest(k, F.lit(1)))[c]).otherwise(0.0) + F.element_at(x, k + 1)[c] + F.coalesce(F.try_element_at(x, k + 2)[c], F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda k: sample(near(k, "i") / 3, near(k, "q") / 3))

    for _ in range(passes):
        iq = let(iq, once)
    return iq


def powered(iq: Column, kind: str) -> Column:
    """x^3, x^4 or x^2 - 1 of complex samples; other kinds are the identity."""
    re = {"cubic": lambda i, q: i * i * i - 3 * i * q * q, "quartic": lambda i, q: i**4 - 6 * i * i * q * q + q**4, "polynomial": lambda i, q: i * i - q * q - 1}
    im = {"cubic": lambda i, q: 3 * i * i * q - q * q * q, "quartic": lambda i, q: 4 * i * i * i * q - 4 * i * q * q * q, "polynomial": lambda i, q: 2 * i * q}
    if kind not in re:
        return iq
    return F.transform(iq, lambda s: F.struct(re[kind](s.i, s.q).alias("i"), im[kind](s.i, s.q).alias("q")))


def differences(values: Column) -> Column:
    """First differences of an array of numbers; empty for under two."""
    return F.when(F.size(values) > 1, let(values, lambda x: F.transform(F.sequence(F.lit(2), F.size(x)), lambda k: F.element_at(x, k) - F.element_at(x, k - 1)))).otherwise(F.expr("cast(array() as array<double>)"))


def window_samples(df: DataFrame, starts: Column, length: int) -> DataFrame:
    """One row per start in an array of starts: view_idx, start, and iq cut to the window inside the row; nothing is shuffled."""
    rows = df.select("*", F.posexplode(starts).alias("view_idx", "start"))
    return rows.withColumn("iq", cut(F.col("iq"), F.col("start"), length))


def replay_windows(df: DataFrame, window: int, stride: int) -> DataFrame:
    """One row per candidate window: start, and its samples cut inside the row; nothing is shuffled."""
    rows = df.withColumn("start", F.explode(candidate_starts(F.size("iq"), window, stride)))
    return rows.withColumn("iq", zero_padded(cut(F.col("iq"), F.col("start"), window), window))


def feature_stack(df: DataFrame, features: list[str], snr: str = "snr") -> DataFrame:
    """Adds stack, a row of numbers per sample: I and Q by their largest absolute values, the ratio, then the scalars; nulls as zeros."""
    scalars = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in [snr, *features]])
    return df.withColumn("stack", let(scalars, lambda tail: F.transform(channel_normalised(F.col("iq")), lambda s: F.concat(F.array(s.i, s.q), tail))))
