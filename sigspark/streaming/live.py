"""The live path: frames to exact chunks, noise floor, energy trigger, capture, decision, event summary.

State is kept per stream and bounded (``stateful``): a remainder, the first floor readings, a ring of chunks. The
order inside a stream matters, so one stream is one key; streams are independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.arrays import mean_of
from ..sources.frames import decoded_frames
from .stateful import Trigger, fixed_captures, level, power_of, rechunked, triggered

__all__ = ["CalibrationListener", "Trigger", "chunk_powers", "decoded", "fixed_captures", "json_sink", "level", "observed_calibration", "power_of", "rechunked", "replayed", "rolling_summary", "skipped", "streamed_event_summary", "triggered", "windowed_powers"]
CHUNKS = "stream_id long, seq long, i array<double>, q array<double>, power_db double"


def decoded(stream: DataFrame) -> DataFrame:
    """Frames (stream_id, seq, iq_format, channels, payload) with i and q instead of the payload."""
    return decoded_frames(stream.select("stream_id", "seq", "iq_format", "channels", "payload"))


def chunk_powers(chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, power_db) of each chunk: no state, no shuffle."""
    square = F.zip_with("i", "q", lambda a, b: a * a + b * b)
    return chunks.select("stream_id", "seq", F.when(F.size("i") > 0, 10 * F.log10(mean_of(square) + F.lit(1e-12))).otherwise(-120.0).alias("power_db"))


def windowed_powers(readings: DataFrame, every: str, late: str = "10 minutes") -> DataFrame:
    """Mean power in dB per stream and window of event time, from (stream_id, ts, power_db); readings later than the watermark are dropped."""
    linear = F.pow(F.lit(10.0), F.col("power_db") / 10)
    rows = readings.withWatermark("ts", late).groupBy(F.window("ts", every), "stream_id").agg(F.count(F.lit(1)).alias("chunks"), (10 * F.log10(F.avg(linear))).alias("power_db"), F.max("power_db").alias("peak_db"))
    return rows.select("stream_id", F.col("window.start").alias("start"), "chunks", "power_db", "peak_db")


def skipped(chunks: DataFrame, first: int) -> DataFrame:
    """Without the first chunks of each stream; chunk numbers are dense, so no state is needed."""
    return chunks.filter(F.col("seq") >= first).withColumn("seq", F.col("seq") - first)


def rolling_summary(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per condition and window of event time: events, alerts and means; events later than the watermark are dropped.
    Confidences are summed as decimals, so that a mean doesn't depend on the order of its events."""
    exact = F.col("confidence").cast("decimal(28,12)")
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", every), "condition")
        .agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("alert").cast("int")).alias("alerts"), (F.sum(exact).cast("double") / F.count("confidence")).alias("mean_confidence"))
        .select(F.col("window.start").alias("start"), "condition", "events", "alerts", "mean_confidence")
    )


def streamed_event_summary(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", by: str = "condition") -> DataFrame:
    """Per condition and window of event time, all figures of ``metrics.event_summary``: counts, alert rate, largest non-noise
    confidence, means of snr_db, e2e_ms and infer_ms where they are there, and label:count of the predictions, commonest first.

    Two aggregations, one after the other: per prediction, then per condition, so that state has a row a prediction and not
    a list of events. Both give a window out once the watermark has passed it (append mode); later events are dropped.
    Sums are of decimals, so that a mean doesn't depend on the order of its events.
    """
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,12)"))
    means = [c for c in ("snr_db", "e2e_ms", "infer_ms") if c in events.columns]
    each = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", every), by, "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("alert").cast("int")).alias("alerts"), F.count("alert").alias("judged"), F.max("non_noise_confidence").alias("most"),
        *[exact(c).alias(f"sum_{c}") for c in means], *[F.count(c).alias(f"n_{c}") for c in means],
    )
    label = F.struct(-F.col("n"), "prediction", F.concat_ws(":", "prediction", F.col("n").cast("string")).alias("text"))
    whole = each.groupBy("window", by).agg(
        F.sum("n").alias("events"), F.sum("alerts").alias("alerts"), F.sum("judged").alias("judged"), F.max("most").alias("max_non_noise_confidence"),
        *[(F.sum(f"sum_{c}").cast("double") / F.sum(f"n_{c}")).alias(f"mean_{c}") for c in means], F.sort_array(F.collect_list(label)).alias("labels"),
    )
    return whole.select(
        F.col("window.start").alias("start"), by, "events", "alerts", (F.col("judged") - F.col("alerts")).alias("no_alerts"), (F.col("alerts") / F.col("judged") * 100).alias("alert_rate_pct"),
        "max_non_noise_confidence", *[f"mean_{c}" for c in means], F.concat_ws(",", F.transform("labels", lambda x: x.text)).alias("top_predictions"),
    )


def observed_calibration(events: DataFrame, name: str = "calibration") -> DataFrame:
    """The events of ``triggered``, which also report each floor with its trigger level as it is found, under a name: what is reported
    of a batch are its floors, one a stream and round. ``CalibrationListener`` hands them on."""
    found = F.collect_list(F.when(F.col("kind") == "floor", F.struct("stream_id", "seq", "floor", "trigger")))
    return events.observe(name, found.alias("found"))


class CalibrationListener(StreamingQueryListener):
    """Calls ``calibrated(stream_id, floor, trigger)`` on the driver once for each floor that an observed stream finds.
    Add it by ``spark.streams.addListener``. A batch that is repeated after a failure reports again."""

    def __init__(self, calibrated: Callable[[int, float, float], None], name: str = "calibration"):
        self.calibrated, self.name = calibrated, name

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        metrics = event.progress.observedMetrics.get(self.name)
        for row in metrics.found if metrics else ():
            self.calibrated(row.stream_id, row.floor, row.trigger)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def json_sink(events: DataFrame, path: str, checkpoint: str):
    """One JSON line per event, until no input is left."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replayed(spark, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Recorded Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
