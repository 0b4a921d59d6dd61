"""Registered queries on sources, sinks, cleaning and decisions, with their SQL for DuckDB.

What a source reads is written first, from the provided tables, to the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import catalogue as cat
from ..operators import scoring as sc
from ..operators import windows as win
from ..sources import frames as src
from ..sources import tables as tab
from ..streaming import live
from ..streaming.run import drained, recorded, working_folder
from .catalogue_queries import PATHS, listing_of, paths, rounded
from .hash_sql import Hashed, normal, uniform
from .signal_queries import LABELS10, NAMED, long, probs_of
from .tables import captures, chunks, predictions, r6, table, with_tables

IQ, PRED, CHUNKS = with_tables("iq"), with_tables("predictions"), with_tables("chunks")


def encoded(spark, sf, encode: Callable[[np.ndarray], bytes]):
    """(vec_id, content) with each vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [encode(np.array(v, np.float32)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["vec_id", "content"])

    return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, content binary")


def src1_listed_files(spark, sf):
    """One file per class, found by name pattern at any depth."""
    folder = working_folder(spark)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("value"), "label")
    rows.repartition("label").write.partitionBy("label").text(folder)
    files = src.list_files(spark, folder, "*.txt").filter("length > 0")
    return files.groupBy(F.regexp_extract("path", r"label=(\d+)", 1).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("files"))


def binary_captures(spark, sf, kind: str, encode: Callable[[np.ndarray], bytes]):
    files = encoded(spark, sf, encode).select(F.concat("vec_id", F.lit(kind)).alias("path"), "content")
    rows = src.decoded_files(files).withColumn("capture_id", F.split("path", r"\.")[0].cast("long"))
    return long(rows, "capture_id")


def src2_complex_files(spark, sf):
    return binary_captures(spark, sf, ".c64", lambda v: v.tobytes())


def src3_interleaved_files(spark, sf):
    """Single-precision pairs."""
    return binary_captures(spark, sf, ".iq", lambda v: v.tobytes())


def src3_sixteen_bit_files(spark, sf):
    """Three 16-bit pairs a file: too few values to be single-precision ones."""
    return binary_captures(spark, sf, ".iq", lambda v: np.rint(v[:6] * 1000).astype("<i2").tobytes())


SAMPLES = IQ + " SELECT capture_id, n, round(i, 6) + 0.0 AS i, round(q, 6) + 0.0 AS q FROM iq"
SIXTEEN = "SELECT vec_id AS capture_id, n::INT AS n, round_even(embedding[2 * n + 1] * 1000::FLOAT, 0)::DOUBLE + 0.0 AS i, round_even(embedding[2 * n + 2] * 1000::FLOAT, 0)::DOUBLE + 0.0 AS q FROM embeddings, range(3) t(n)"


def src4_numeric_text(spark, sf):
    folder = working_folder(spark)
    iq = captures(spark, sf).select(F.explode("iq").alias("s"))
    iq.select(F.concat_ws(",", F.col("s.i").cast("string"), F.col("s.q").cast("string"))).write.text(folder)
    return tab.read_numeric_text(spark, folder).select(r6(F.col("i")).alias("i"), r6(F.col("q")).alias("q"))


def src5_decoded_frames(spark, sf):
    """16-bit frames of two channels, of which the first is kept."""
    both = lambda v: np.rint(v.reshape(-1, 1, 2).repeat(2, 1) * 32767).astype("<i2").tobytes()
    frames = encoded(spark, sf, both).select(F.col("vec_id").alias("capture_id"), F.lit("cs16").alias("iq_format"), F.lit(2).alias("channels"), F.col("content").alias("payload"))
    rows = src.decoded_frames(frames).select("capture_id", F.posexplode(F.arrays_zip("i", "q")).alias("n", "s"))
    return rows.select("capture_id", "n", r6(F.col("s.i")).alias("i"), r6(F.col("s.q")).alias("q"))


SRC5 = "SELECT vec_id AS capture_id, n::INT AS n, round(round_even(embedding[2 * n + 1] * 32767::FLOAT, 0)::DOUBLE / 32768, 6) + 0.0 AS i, round(round_even(embedding[2 * n + 2] * 32767::FLOAT, 0)::DOUBLE / 32768, 6) + 0.0 AS q FROM embeddings, range(32) t(n)"


def daily(spark, sf):
    return predictions(spark, sf).groupBy("condition").agg(F.count(F.lit(1)).alias("events"), r6(F.avg("value")).alias("mean_value"))


DAILY = PRED + " SELECT condition, count(*) AS events, round(avg(value), 6) + 0.0 AS mean_value FROM predictions GROUP BY 1"


def src6_csv_round_trip(spark, sf):
    """Written with six digits, and read with its required columns checked."""
    folder = working_folder(spark)
    tab.write_csv(daily(spark, sf), folder)
    return tab.read_csv(spark, folder, "condition string, events long, mean_value double", ("condition", "events"))


def src7_metrics(spark, sf):
    """Metrics written as JSON; a file that is missing is passed over."""
    folder = working_folder(spark)
    rows = daily(spark, sf).select(F.lit("events").alias("dataset"), F.col("condition").alias("model"), F.format_string("%.6f", "mean_value").alias("accuracy"))
    tab.write_json(rows, folder)
    return tab.read_metrics(spark, folder, folder + "-missing").select("dataset", "model", F.col("accuracy").cast("double").alias("accuracy"))


def src8_clip_metadata(spark, sf):
    folder = working_folder(spark)
    rows = predictions(spark, sf).groupBy(F.col("y_true").alias("drone"), (F.col("snr") + 2400).alias("center_mhz")).agg(F.count(F.lit(1)).cast("double").alias("snr_db"))
    rows.write.format("xml").option("rootTag", "Clips").option("rowTag", "Clip").save(folder)
    return tab.read_clip_metadata(spark, folder).select("drone", "center_mhz", "snr_db")


def src9_class_file(spark, sf):
    folder = working_folder(spark)
    names = predictions(spark, sf).select("y_true").distinct().agg(F.array_sort(F.collect_list("y_true")).alias("names"))
    names.select(F.concat(F.lit("classes = ['"), F.array_join("names", "', '"), F.lit("']"))).write.text(folder)
    return tab.read_class_file(spark, folder + "/*.txt").select("class_idx", "class_name")


def snk3_cached(spark, sf):
    """The days of one half of the month are in the cache when all are asked for."""
    folder = working_folder(spark)
    days = predictions(spark, sf).select("condition").distinct()
    compute = lambda new: new.withColumn("key", tab.cache_key(F.col("condition"), F.lit("params")))
    tab.cached(days.filter("substring(condition, 9, 2) <= '15'"), "condition", folder, compute)
    return tab.cached(days, "condition", folder, compute, F.col("key").isNotNull())


def agg28_checksums(spark, sf):
    """Checksums of one text file per class, of ordered ids, and of a file that is missing."""
    folder = working_folder(spark)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("value"), "vec_id", "label")
    rows.repartition("label").sortWithinPartitions("label", "vec_id").select("value", "label").write.partitionBy("label").text(folder)
    base = folder.removeprefix("file:").lstrip("/")
    files = src.list_files(spark, folder, "*.txt").filter("length > 0").select(F.regexp_replace("path", f"^file:/+{base}/", "").alias("path"))
    expected = files.union(files.limit(0)).unionByName(spark.createDataFrame([("label=99/missing.txt",)], "path string"))
    out = src.checksums(spark, expected, folder)
    return out.select(F.regexp_extract("path", r"label=(\d+)", 1).cast("int").alias("label"), "sha256")


AGG28 = "SELECT label::INT AS label, sha256(string_agg(vec_id::VARCHAR, chr(10) ORDER BY vec_id) || chr(10)) AS sha256 FROM embeddings GROUP BY 1 UNION ALL SELECT 99, NULL"


def cln1_clean_numbers(spark, sf):
    """Days whose ratio is 0 / 0, -1 / 0 or 1 / 0 among others."""
    top = F.col("value") - F.lit(100.0)
    x = F.when(F.col("snr") == 0, F.lit(float("nan"))).when(F.col("snr") == 2, F.lit(float("inf"))).when(F.col("snr") == 4, F.lit(float("-inf"))).when(F.col("snr") == 6, F.lit(None).cast("double")).otherwise(top)
    return predictions(spark, sf).select("capture_id", r6(cat.clean_number(x)).alias("x"))


CLN1 = PRED + " SELECT capture_id, CASE snr WHEN 0 THEN 0.0 WHEN 2 THEN 3.4028234663852886e38 WHEN 4 THEN -3.4028234663852886e38 WHEN 6 THEN 0.0 ELSE round(value - 100, 6) + 0.0 END::DOUBLE AS x FROM predictions"


def cln3_existing_files(spark, sf):
    files = paths(spark, sf)
    return cat.existing_files(files.select("doc_id", F.col("path").alias("filepath")), listing_of(files))


def arr1_coerced(spark, sf):
    """From interleaved numbers and, for odd ids, from two channels."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("capture_id"), "embedding")
    halves = F.array(F.filter("embedding", lambda x, k: k % 2 == 0), F.filter("embedding", lambda x, k: k % 2 == 1))
    return long(v.withColumn("iq", F.when(F.col("capture_id") % 2 == 0, win.complex_from_flat(F.col("embedding"))).otherwise(win.complex_from_channels(halves))), "capture_id")


def arr19_augmented(spark, sf):
    """Originals stay in all samples, and copies are near them: within the furthest number that can be drawn."""
    noise = 0.005
    rows = win.augmented(captures(spark, sf).select("capture_id", "iq"), 2, 5, noise)
    own = rows.filter("copy = 0").select("capture_id", F.col("iq").alias("own"))
    away = F.array_max(F.zip_with("iq", "own", lambda a, b: F.greatest(F.abs(a.i - b.i), F.abs(a.q - b.q))))
    return rows.join(own, "capture_id").select("capture_id", "copy", (F.col("iq") == F.col("own")).alias("same"), (away <= noise * win.FURTHEST + 1e-9).alias("near"))


def arr20_progressive(spark, sf):
    """In the last epoch nothing is changed; before, originals stay and a copy at most is added."""
    rows = captures(spark, sf).select("capture_id", "iq")
    first, last = (win.progressively_augmented(rows, e, 10, 5).groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")) for e in (2, 10))
    both = first.withColumnRenamed("n", "early").join(last.withColumnRenamed("n", "late"), "capture_id")
    return both.select("capture_id", F.col("early").between(1, 2).alias("early_fits"), "late")


def arr19_noise(spark, sf):
    """Copies with noise, a random factor and a circular shift, sample by sample."""
    rows = win.augmented(captures(spark, sf).select("capture_id", "iq"), 2, 5, 0.05, 0.1, 3)
    return long(rows, "capture_id", "copy")


def arr20_faded(spark, sf):
    """What the third of ten epochs adds, sample by sample."""
    rows = win.progressively_augmented(captures(spark, sf).select("capture_id", "iq"), 3, 10, 5)
    return long(rows, "capture_id", "copy")


def drawn(copies: str, seed: int, noise: float, scale: float, shift: int, kept: str) -> str:
    """Augmented samples from the hashes that their numbers are drawn from."""
    own = [("int", seed), ("long", "capture_id"), ("int", "copy")]
    rows = Hashed(f"(SELECT DISTINCT capture_id, c::INT AS copy FROM iq, {copies})")
    rows.hash("s1", *own, ("text", "scale"), ("int", 1)).hash("s2", *own, ("text", "scale"), ("int", 2)).hash("turn", *own, ("text", "shift")).hash("share", ("int", seed), ("long", "capture_id"), ("text", "share"))
    samples = Hashed("moved")
    for c in ("i", "q"):
        samples.hash(f"{c}1", *own, ("int", "n"), ("text", c), ("int", 1)).hash(f"{c}2", *own, ("int", "n"), ("text", c), ("int", 2))
    # The remainder of the hash as a signed number, moved to 0 and above.
    signed = "(CASE WHEN turn >= 9223372036854775808::UHUGEINT THEN turn::HUGEINT - 18446744073709551616::HUGEINT ELSE turn::HUGEINT END)"
    by = f"((({signed} % {2 * shift + 1}) + {2 * shift + 1}) % {2 * shift + 1} - {shift})" if shift else "0"
    value = lambda c: f"round(CASE WHEN copy = 0 THEN {c} ELSE {c} * (1 + {scale!r}::DOUBLE * {normal('s1', 's2')}) + {noise!r}::DOUBLE * {normal(c + '1', c + '2')} END, 6) + 0.0 AS {c}"
    return f"""{IQ}, draws AS ({rows.sql}), wanted AS (SELECT * EXCLUDE (turn, share), CASE WHEN copy = 0 THEN 0 ELSE {by} END AS by_ FROM draws WHERE copy = 0 OR {kept}),
moved AS (SELECT w.*, ((iq.n - by_ + 64) % 32)::INT AS n, i, q FROM wanted w JOIN iq USING (capture_id)) SELECT capture_id, copy, n, {value("i")}, {value("q")} FROM ({samples.sql})"""


def dec1_scored(spark, sf):
    """A model that is made once a task: loud or not, by the mean power of a window."""

    def model():
        return lambda frame: pd.DataFrame({"capture_id": frame["capture_id"], "loud": [bool(np.mean(np.square(v)) > 1 / 64 + 1e-9) or bool(np.max(v) > 0.3) for v in frame["v"]]})

    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("capture_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return sc.scored(v, model, "capture_id long, loud boolean")


DEC1 = "SELECT vec_id AS capture_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 64 > 1.0 / 64 + 1e-9 OR list_max(embedding)::DOUBLE > 0.3::DOUBLE AS loud FROM embeddings"


def dec4_decisions(spark, sf):
    rows = sc.decided(probs_of(spark, sf).withColumn("probs", F.transform("probs", lambda p: F.round(p, 9))), LABELS10)
    pick = lambda mode: sc.decision(mode, *[F.col(c) for c in ("prediction", "confidence", "best_non_noise", "non_noise_confidence")])
    rows = rows.select("capture_id", pick("raw").alias("raw"), pick("non-noise").alias("other"))
    return rows.select("capture_id", F.col("raw.label").alias("raw"), F.col("other.label").alias("other"), r6(F.col("raw.confidence")).alias("raw_confidence"), r6(F.col("other.confidence")).alias("other_confidence"))


DEC4 = NAMED + """, o AS (SELECT vec_id, sum(p) AS mass FROM named WHERE label <> 4 GROUP BY 1), a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS k FROM named), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS k FROM named WHERE label <> 4)
SELECT a.vec_id AS capture_id, a.name AS raw, b.name AS other, round(a.p, 6) + 0.0 AS raw_confidence, round(b.p / mass, 6) + 0.0 AS other_confidence FROM a JOIN b USING (vec_id) JOIN o USING (vec_id) WHERE a.k = 1 AND b.k = 1"""


def dec6_window_scores(spark, sf):
    """The score of a window by mode: the largest probability, a target's, or the largest that isn't background."""
    rows = probs_of(spark, sf)
    modes = {"raw": sc.window_score("raw", LABELS10), "target": sc.window_score("target", LABELS10, "class_3"), "other": sc.window_score("non-noise", LABELS10)}
    return rows.select("capture_id", *[r6(x).alias(n) for n, x in modes.items()])


def jn5_models_without_dataset(spark, sf):
    models = predictions(spark, sf).select(F.col("y_true").alias("dataset"), F.col("y_pred").alias("model")).distinct()
    datasets = predictions(spark, sf).filter("value > 480").select(F.col("y_true").alias("name")).distinct()
    return cat.models_without_dataset(models, datasets)


def str1_decoded(spark, sf):
    """Single-precision frames of a stream."""
    frames = encoded(spark, sf, lambda v: v.tobytes()).select(F.col("vec_id").alias("stream_id"), F.lit(0).cast("long").alias("seq"), F.lit("cf32").alias("iq_format"), F.lit(1).alias("channels"), F.col("content").alias("payload"))
    rows = drained(live.decoded(recorded(frames))).select(F.col("stream_id").alias("capture_id"), F.posexplode(F.arrays_zip("i", "q")).alias("n", "s"))
    return rows.select("capture_id", "n", r6(F.col("s.i")).alias("i"), r6(F.col("s.q")).alias("q"))


def str10_json_events(spark, sf):
    """Events through the JSON sink, and read again."""
    folder = working_folder(spark)
    rows = predictions(spark, sf).select("capture_id", "y_pred")
    live.json_sink(recorded(rows), folder, working_folder(spark)).awaitTermination()
    return spark.read.schema("capture_id long, y_pred string").json(folder)


def str11_replayed(spark, sf):
    """Recorded files as a stream, one a batch."""
    folder = working_folder(spark)
    chunks(spark, sf).select("stream_id", "seq", "power_db").repartition(3, "stream_id").write.parquet(folder)
    return rounded(drained(live.replayed(spark, folder, "stream_id long, seq long, power_db double")))


QUERIES = {n: f for n, f in list(globals().items()) if re.match(r"(src|snk|agg|cln|arr|dec|jn|str)\d", n) and getattr(f, "__module__", "") == __name__}
ORACLES = {
    "arr19_noise": drawn("range(3) t(c)", 5, 0.05, 0.1, 3, "true"),
    "arr20_faded": drawn("range(2) t(c)", 8, 0.05 * 0.7, 0.1 * 0.7, 5, f"{uniform('share')} <= 0.5 * 0.7::DOUBLE"),
    "src1_listed_files": "SELECT DISTINCT label::INT AS label, 1::BIGINT AS files FROM embeddings", "src2_complex_files": SAMPLES, "src3_interleaved_files": SAMPLES, "src3_sixteen_bit_files": SIXTEEN,
    "src4_numeric_text": IQ + " SELECT round(i, 6) + 0.0 AS i, round(q, 6) + 0.0 AS q FROM iq", "src5_decoded_frames": SRC5, "src6_csv_round_trip": DAILY,
    "src7_metrics": PRED + " SELECT 'events' AS dataset, condition AS model, round(avg(value), 6) + 0.0 AS accuracy FROM predictions GROUP BY condition",
    "src8_clip_metadata": PRED + " SELECT y_true AS drone, (snr + 2400)::INT AS center_mhz, count(*)::DOUBLE AS snr_db FROM predictions GROUP BY ALL",
    "src9_class_file": PRED + " SELECT (row_number() OVER (ORDER BY y_true) - 1)::INT AS class_idx, y_true AS class_name FROM (SELECT DISTINCT y_true FROM predictions)",
    "snk3_cached": PRED + " SELECT DISTINCT condition, sha1(condition || '|params') AS key FROM predictions", "agg28_checksums": AGG28, "cln1_clean_numbers": CLN1,
    "cln3_existing_files": f"WITH {PATHS} SELECT doc_id, path AS filepath FROM paths WHERE path IN (SELECT CASE WHEN doc_id % 2 = 0 THEN path ELSE 'files/' || path END FROM paths)", "arr1_coerced": SAMPLES,
    "arr19_augmented": "SELECT vec_id AS capture_id, c::INT AS copy, c = 0 AS same, true AS near FROM embeddings, range(3) t(c)", "arr20_progressive": "SELECT vec_id AS capture_id, true AS early_fits, 1::BIGINT AS late FROM embeddings",
    "dec1_scored": DEC1, "dec4_decisions": DEC4,
    "dec6_window_scores": NAMED.replace("round(p, 9) AS p", "p") + " SELECT vec_id AS capture_id, round(max(p), 6) + 0.0 AS raw, round(max(p) FILTER (label = 3), 6) + 0.0 AS target, round(max(p) FILTER (label <> 4), 6) + 0.0 AS other FROM named GROUP BY 1",
    "jn5_models_without_dataset": PRED + " SELECT DISTINCT y_true AS dataset, y_pred AS model FROM predictions WHERE y_true NOT IN (SELECT y_true FROM predictions WHERE value > 480)",
    "str1_decoded": SAMPLES, "str10_json_events": PRED + " SELECT capture_id, y_pred FROM predictions", "str11_replayed": CHUNKS + " SELECT stream_id, seq, round(power_db, 6) + 0.0 AS power_db FROM chunks",
}
