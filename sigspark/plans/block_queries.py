"""Registered queries on captures longer than a row, with their SQL for DuckDB.

A long capture is fifty vectors in a row; each vector is a block of 32 samples.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import blocks as blk
from ..operators import windows as win
from ..sources import ranges as rng
from ..streaming.run import drained, working_folder
from .kernel_queries import TAU, cells, standardised_sql
from .tables import captures, r6, with_tables

VECTORS, SIZE = 50, 32
LONG = with_tables("iq") + f", long AS (SELECT capture_id // {VECTORS} AS capture_id, ((capture_id % {VECTORS}) * {SIZE} + n)::INT AS n, i, q FROM iq), lengths AS (SELECT capture_id, max(n) + 1 AS samples FROM long GROUP BY 1)"


def long_blocks(spark, sf):
    """(capture_id, block, iq)."""
    rows = captures(spark, sf).select("capture_id", "iq")
    return rows.select(F.expr(f"capture_id div {VECTORS}").alias("capture_id"), (F.col("capture_id") % VECTORS).alias("block"), "iq")


def written(spark, sf, suffix: str, kind: str = "cf32", scale: float = 1.0):
    """The long captures as binary files, one each."""
    folder = working_folder(spark)
    rows = long_blocks(spark, sf).withColumn("iq", F.transform("iq", lambda s: F.struct((s.i * scale).alias("i"), (s.q * scale).alias("q"))))
    rng.write_captures(rows.withColumn("name", F.concat(F.col("capture_id").cast("string"), F.lit(suffix))), folder, "name", "block", kind)
    return folder


def named(rows):
    return rows.withColumn("capture_id", F.split("path", r"\.")[0].cast("long"))


def samples_of(rows):
    """Of blocks without a halo."""
    each = named(rows).select("capture_id", "first", F.posexplode("iq").alias("k", "s"))
    return each.select("capture_id", (F.col("first") + F.col("k")).cast("int").alias("n"), r6(F.col("s.i")).alias("i"), r6(F.col("s.q")).alias("q"))


def src2_ranges(spark, sf):
    """Single-precision files, read in ranges of two blocks at least."""
    return samples_of(rng.read_blocks(spark, written(spark, sf, ".c64"), block=100, rangeBytes=1600, pattern="*.c64"))


def src2_ranges_selected(spark, sf):
    """Some files and blocks by filters that choose what is opened, with no samples read for their numbers."""
    rows = rng.read_blocks(spark, written(spark, sf, ".c64"), "path", "samples", "block", "own", block=100)
    return named(rows.filter("path like '1%' and block >= 2")).select("capture_id", "samples", "block", "own")


def src3_ranges(spark, sf):
    """16-bit files, at their own scale."""
    return samples_of(rng.read_blocks(spark, written(spark, sf, ".iq", "int16", 1000.0), format="int16", block=64, rangeBytes=256))


def src5_range_stream(spark, sf):
    """Whole blocks of files as a stream; what has not filled a block waits."""
    return samples_of(drained(rng.stream_blocks(spark, written(spark, sf, ".c64"), block=100, rangeBytes=1600)))


PARTS = LONG + " SELECT capture_id, n, round(i, 6) + 0.0 AS i, round(q, 6) + 0.0 AS q FROM long"


def str11_looped(spark, sf):
    """Three rounds of the files, as chunks that are numbered through."""
    chunks = drained(rng.replayed_chunks(spark, written(spark, sf, ".c64"), block=90, rangeBytes=72_000, rounds=3))
    power = F.aggregate("iq", F.lit(0.0), lambda s, x: s + x.i * x.i + x.q * x.q) / F.size("iq")
    return named(chunks).select("capture_id", "round", "seq", "first", F.size("iq").alias("samples"), r6(power).alias("power"))


def jn6_blocked(spark, sf):
    """Windows of 70 samples, which lie over three or four blocks."""
    ids = long_blocks(spark, sf).select("capture_id").distinct().withColumn("view_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    windows = ids.select("capture_id", "view_idx", ((F.col("capture_id") * 37 + F.col("view_idx") * 211) % 1500).alias("start"), F.lit(70).cast("long").alias("length"))
    rows = blk.windows_over_blocks(long_blocks(spark, sf), windows, SIZE)
    return rows.select("capture_id", "view_idx", F.posexplode("iq").alias("n", "s")).select("capture_id", "view_idx", "n", r6(F.col("s.i")).alias("i"), r6(F.col("s.q")).alias("q"))


def win2_blocked(spark, sf):
    rows = long_blocks(spark, sf)
    halo = blk.with_halo(rows, SIZE, 8, 7).join(blk.lengths(rows, SIZE), "capture_id")
    return blk.burst_starts_over_blocks(halo, SIZE, 100, 16)


def win2_ranges(spark, sf):
    """The same bursts from files: the halo is read with each block."""
    return blk.burst_starts_over_blocks(named(rng.read_blocks(spark, written(spark, sf, ".c64"), block=70, before=8, after=7, rangeBytes=1200)), 70, 100, 16)


def arr11_blocked(spark, sf):
    """Frames of 40 samples, longer than a block, every 25."""
    rows = blk.frames_over_blocks(blk.with_halo(long_blocks(spark, sf), SIZE, 0, 39), SIZE, 40, 25)
    return rows.select("capture_id", F.col("start").cast("int").alias("start"), r6(win.mean_square(F.col("iq"))).alias("power"))


def arr12_blocked(spark, sf):
    """Spectrograms of whole captures, with frames longer than a block."""
    rows = blk.spectrogram_over_blocks(long_blocks(spark, sf), SIZE, 40, 25, 30)
    return cells(rows, "re", "im")


ARR12 = LONG + f""", w AS (SELECT capture_id, t::INT AS t, (samples - 40) // 25 + 1 AS c, t * (((samples - 40) // 25)::DOUBLE / 29) AS a FROM lengths, range(30) r(t)),
p AS (SELECT capture_id, t, least(floor(a), c - 1)::INT * 25 AS s, 1 - (a - least(floor(a), c - 1)) AS wt FROM w UNION ALL SELECT capture_id, t, least(floor(a) + 1, c - 1)::INT * 25, a - least(floor(a), c - 1) FROM w),
fr AS (SELECT capture_id, t, n - s AS n, wt * i * (0.5 - 0.5 * cos({TAU} * (n - s) / 39)) AS i, wt * q * (0.5 - 0.5 * cos({TAU} * (n - s) / 39)) AS q FROM long JOIN p USING (capture_id) WHERE n >= s AND n < s + 40),
b AS (SELECT capture_id, t, k, sum(i * cos({TAU} * k * n / 40) + q * sin({TAU} * k * n / 40)) / 40 AS re, sum(q * cos({TAU} * k * n / 40) - i * sin({TAU} * k * n / 40)) / 40 AS im FROM fr, range(40) r(k) GROUP BY ALL)""" + standardised_sql("b", 1200).replace("(k + 4) % 8", "(k + 20) % 40")
WIN2 = LONG + """, p AS (SELECT capture_id, n, sum((i * i + q * q) / 2) OVER (PARTITION BY capture_id ORDER BY n ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) / 16 AS s FROM long), b AS (SELECT capture_id, n, row_number() OVER (PARTITION BY capture_id ORDER BY s DESC, n) AS k FROM p)
SELECT capture_id, greatest(0, least(n - 50, samples - 100))::INT AS start FROM b JOIN lengths USING (capture_id) WHERE k = 1"""
QUERIES = {n: f for n, f in list(globals().items()) if re.match(r"(src|arr|jn|win|str)\d", n) and getattr(f, "__module__", "") == __name__}
ORACLES = {
    "src2_ranges": PARTS,
    "src2_ranges_selected": LONG + " SELECT capture_id, samples::BIGINT AS samples, b AS block, least(100, samples - 100 * b)::BIGINT AS own FROM lengths, range(2, 1000) t(b) WHERE capture_id::VARCHAR LIKE '1%' AND 100 * b < samples",
    "src3_ranges": LONG + " SELECT capture_id, n, round_even(i * 1000, 0) + 0.0 AS i, round_even(q * 1000, 0) + 0.0 AS q FROM long",
    "src5_range_stream": LONG + " SELECT capture_id, n, round(i, 6) + 0.0 AS i, round(q, 6) + 0.0 AS q FROM long JOIN lengths USING (capture_id) WHERE n < samples // 100 * 100",
    "str11_looped": LONG + """, c AS (SELECT capture_id, n // 90 AS k, count(*) AS samples, sum(i * i + q * q) / count(*) AS power FROM long GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY capture_id || '.c64', k) - 1 AS place, count(*) OVER () AS n FROM c)
SELECT capture_id, r::BIGINT AS round, (r * n + place)::BIGINT AS seq, (k * 90)::BIGINT AS first, samples::INT AS samples, round(power, 6) + 0.0 AS power FROM o, range(3) t(r)""",
    "jn6_blocked": LONG + ", w AS (SELECT capture_id, v::INT AS view_idx, (capture_id * 37 + v * 211) % 1500 AS start FROM lengths, range(4) t(v)) SELECT capture_id, view_idx, (n - start)::INT AS n, round(i, 6) + 0.0 AS i, round(q, 6) + 0.0 AS q FROM long JOIN w USING (capture_id) WHERE n >= start AND n < start + 70",
    "arr12_blocked": ARR12, "win2_blocked": WIN2, "win2_ranges": WIN2,
    "arr11_blocked": LONG + " SELECT capture_id, start::INT AS start, round(avg((i * i + q * q) / 2), 6) + 0.0 AS power FROM long JOIN lengths USING (capture_id), range(0, 100000, 25) t(start) WHERE start + 40 <= samples AND n >= start AND n < start + 40 GROUP BY ALL",
}
