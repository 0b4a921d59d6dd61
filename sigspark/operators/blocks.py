"""Captures longer than a row: blocks (capture_id, block, iq) of equally many samples, but for a capture's last one.

No task holds a capture. Windows meet the blocks they lie over in an equi-join on block numbers, and only their pieces are
put together; what a block needs of its neighbours comes as a halo, read from the file with it or exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectral as sp
from ..functions.batches import batched

IQ = "array<struct<i: double, q: double>>"


def cut_blocks(captures: DataFrame, size: int, key: str = "capture_id") -> DataFrame:
    """(key, block, iq) from captures that still fit in a row."""
    rows = captures.select(key, "iq", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(size(iq) - 1) div {size}")))).alias("block"))
    return rows.select(key, F.col("block").cast("long").alias("block"), F.slice("iq", F.col("block").cast("int") * size + 1, size).alias("iq"))


def lengths(blocks: DataFrame, size: int, key: str = "capture_id") -> DataFrame:
    """(key, samples) of each capture, from its last block; samples aren't moved."""
    return blocks.groupBy(key).agg(F.max(F.col("block") * size + F.size("iq")).alias("samples"))


def with_halo(blocks: DataFrame, size: int, before: int, after: int, key: str = "capture_id") -> DataFrame:
    """Adds ``first`` (the index of the first sample in iq) and ``own`` (samples without the halo); iq gets up to ``before`` samples
    of the blocks in front and ``after`` of those behind.

    Blocks send each neighbour within reach the stretch that it needs, as rows of their own: what is exchanged besides the
    blocks are the halos, however long these are against a block.
    """
    reach = range(-(-(-before // size)), -(-after // size) + 1)
    pieces = [F.struct(F.lit(0).alias("step"), F.col("iq").alias("piece"))]
    for step in reach:  # for the block ``step`` blocks away: behind it (step < 0) or in front of it
        if step < 0:  # a later block sees the end of this one
            need = F.lit(before - (-step - 1) * size)
            part = F.slice("iq", F.greatest(F.lit(1), F.size("iq") - need + 1), F.greatest(F.lit(0), F.least(need, F.size("iq"))))
        elif step > 0:
            part = F.slice("iq", 1, max(0, min(size, after - (step - 1) * size)))
        else:
            continue
        pieces.append(F.struct(F.lit(step).alias("step"), part.alias("piece")))
    sent = blocks.select(key, "block", F.inline(F.array(*pieces))).select(key, (F.col("block") - F.col("step")).alias("block"), "step", "piece")
    both = sent.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("step", "piece"))).alias("pieces"))
    both = both.filter(F.exists("pieces", lambda p: p.step == 0))
    taken = lambda test: F.coalesce(F.aggregate(F.filter("pieces", test), F.lit(0), lambda n, p: n + F.size(p.piece)), F.lit(0))
    front = taken(lambda p: p.step < 0)
    return both.select(key, "block", (F.col("block") * size - front).alias("first"), taken(lambda p: p.step == 0).cast("long").alias("own"), F.flatten(F.transform("pieces", lambda p: p.piece)).alias("iq"))


def windows_over_blocks(blocks: DataFrame, windows: DataFrame, size: int, key: str = "capture_id") -> DataFrame:
    """Columns of ``windows`` (key, start, length, and what tells windows of a capture apart) with iq cut from start on, shorter at the capture's end.

    A range join by bins: a window is sent to the blocks that it lies over, and gets back a piece from each. Windows
    that start behind the capture have no row; negative starts are an error of the caller. Repeated windows stay repeated.
    """
    own = windows.columns
    named = windows.withColumn("_window", F.monotonically_increasing_id())
    last = F.greatest(F.col("start"), F.col("start") + F.col("length") - 1)
    binned = named.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))))
    met = binned.join(blocks.select(key, "block", F.col("iq").alias("_iq")), [key, "block"])
    low = F.greatest(F.lit(0), F.col("start") - F.col("block") * size)
    high = F.least(F.size("_iq").cast("long"), F.col("start") + F.col("length") - F.col("block") * size)
    piece = F.slice("_iq", (low + 1).cast("int"), F.greatest(F.lit(0), high - low).cast("int"))
    pieces = met.select(*own, "_window", F.struct("block", piece.alias("piece")).alias("_piece"))
    together = pieces.groupBy(*own, "_window").agg(F.flatten(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p.piece)).alias("iq"))
    return together.filter(F.size("iq") > 0).select(*own, "iq")


def frames_over_blocks(halo: DataFrame, size: int, frame: int, hop: int) -> DataFrame:
    """(own columns, start, iq): the frames that start in each block with a halo of ``frame`` - 1 samples behind; whole ones only."""
    begin = F.col("block") * size
    first = F.ceil(begin / hop) * hop
    last = F.least(begin + F.col("own") - 1, F.col("first") + F.size("iq") - frame)
    starts = F.when(first <= last, F.sequence(first, last, F.lit(hop).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    rows = halo.withColumn("start", F.explode(starts))
    return rows.withColumn("iq", F.slice("iq", (F.col("start") - F.col("first") + 1).cast("int"), frame))


def smoothing(samples: Column, smooth: int) -> Column:
    """Samples that power is averaged over: an eighth of the capture at most."""
    return F.greatest(F.lit(1), F.least(F.lit(smooth), F.floor(samples / 8))).cast("int")


def burst_starts_over_blocks(halo: DataFrame, size: int, window: int, smooth: int = 512, key: str = "capture_id") -> DataFrame:
    """(key, start): a window around the first largest smoothed power of the whole capture, inside it; 0 for short ones.

    ``halo``: (key, block, first, own, samples, iq) with at least smooth // 2 samples in front and (smooth - 1) // 2 behind.
    Each block gives its largest smoothed power and where that is; of a capture only these meet. ``halo`` is read once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            iq, firsts, blocks, own, widths, samples = (batch.column(c) for c in range(1, 7))
            found = []
            for row in range(batch.num_rows):
                first, begin, k = firsts[row].as_py(), blocks[row].as_py() * size, widths[row].as_py()
                part = iq.slice(row, 1).flatten()
                i, q = (part.field(c).to_numpy(zero_copy_only=False).astype(float) for c in (0, 1))
                power = sp.smoothed((np.abs(i + 1j * q) ** 2 / 2)[None], k)[0, begin - first : begin - first + own[row].as_py()]
                at = int(power.argmax())
                found.append((float(power[at]), begin + at))
            yield pa.RecordBatch.from_arrays([batch.column(0), samples, pa.array([f for f, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=[key, "samples", "power", "at"])

    rows = halo.filter("own > 0").select(key, "iq", "first", "block", "own", smoothing(F.col("samples"), smooth).alias("width"), F.col("samples").cast("long"))
    kind = dict(halo.dtypes)[key]
    best = rows.mapInArrow(run, f"{key} {kind}, samples long, power double, at long").groupBy(key).agg(F.max(F.struct("power", (-F.col("at")).alias("back"))).alias("best"), F.max("samples").alias("samples"))
    return best.select(key, F.greatest(F.lit(0), F.least(-F.col("best.back") - window // 2, F.col("samples") - window)).cast("int").alias("start"))


def spectrogram_over_blocks(blocks: DataFrame, size: int, nfft: int, hop: int, bins: int, key: str = "capture_id", limit: float = 6.0) -> DataFrame:
    """(key, time_bin, re, im) of whole captures: frames under a Hann window, linearly interpolated to ``bins`` time bins, standardised over
    all of them and clipped, as ``features.spectrogram_rows`` gives it for captures in a row.

    A time bin needs two frames, however long the capture is: only these are cut from the blocks, and transformed.
    """
    samples, t = F.col("samples"), F.col("time_bin")
    count = F.greatest(F.lit(1), F.floor((samples - nfft) / hop) + 1)
    rows = lengths(blocks, size, key).withColumn("count", count).withColumn("time_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    rows = rows.withColumn("at", F.when(F.col("count") == bins, t.cast("double")).otherwise(t * ((F.col("count") - 1) / max(1, bins - 1))))
    low = F.least(F.floor("at"), F.col("count") - 1)
    both = F.array(F.struct((1 - (F.col("at") - low)).alias("weight"), (low * hop).alias("start")), F.struct((F.col("at") - low).alias("weight"), (F.least(low + 1, F.col("count") - 1) * hop).alias("start")))
    windows = rows.select(key, "time_bin", F.inline(both)).filter("weight > 0").withColumn("length", F.lit(nfft).cast("long"))
    frames = windows_over_blocks(blocks, windows, size, key).select(F.struct(key, "time_bin", "weight").alias("_frame"), "iq")

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        x = np.pad(x, ((0, 0), (0, nfft - x.shape[1])))
        spec = sp.stft(x, nfft, hop)[:, :, :1].transpose(0, 2, 1)
        return {"re": spec.real, "im": spec.imag}

    parts = batched(frames, kernel, {"re": "array<double>", "im": "array<double>"}, "_frame").select("_frame.*", *[F.transform(c, lambda v: v * F.col("_frame.weight")).alias(c) for c in ("re", "im")])
    plus = lambda c: F.aggregate(F.slice(c, 2, F.size(c)), F.get(c, F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    spec = parts.groupBy(key, "time_bin").agg(F.collect_list("re").alias("re"), F.collect_list("im").alias("im")).select(key, "time_bin", plus("re").alias("re"), plus("im").alias("im"))
    total = lambda f: F.sum(F.aggregate(F.concat("re", "im"), F.lit(0.0), lambda s, x: s + f(x)))
    figures = spec.groupBy(key).agg((total(lambda x: x) / (2 * nfft * bins)).alias("mean"), (total(lambda x: x * x) / (2 * nfft * bins)).alias("square"))
    scale = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))) + 1e-6
    out = spec.join(figures.select(key, scale.alias("scale")), key)
    clip = lambda c: F.transform(c, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x / F.col("scale")))).alias(c)
    return out.select(key, "time_bin", clip("re"), clip("im"))
