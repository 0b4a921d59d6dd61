"""Registered queries on streams that go by event time, with their SQL for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..streaming import live
from ..streaming.run import drained, recorded
from .catalogue_queries import rounded
from .kernel_queries import live_chunks
from .tables import predictions, with_tables

CHUNKS, PRED = (with_tables(t).replace("WITH ", "WITH RECURSIVE ", 1) for t in ("chunks", "predictions"))
DAY = 86_400.0


def timed_chunks(spark, sf):
    return live_chunks(spark, sf, "ts")


def plain(name: str):
    return F.col(name).cast("timestamp_ntz").alias(name)


def str8_timed_cooldown(spark, sf):
    """After a capture, two days without another."""
    t = live.Trigger(above_db=4.0, pretrigger=0, window=1, rest=2 * DAY)
    events = drained(live.triggered(recorded(timed_chunks(spark, sf)), t))
    return events.filter("kind = 'capture'").select("stream_id", "seq", plain("ts"))


def str5_timeouts(spark, sf):
    """A wait is over after a day and a half, and the next one begins six hours after that or a capture. Streams that have fallen
    silent time out by the watermark."""
    t = live.Trigger(above_db=4.0, pretrigger=0, window=1, timeout=1.5 * DAY, rest=0.25 * DAY)
    events = drained(live.triggered(recorded(timed_chunks(spark, sf)), t))
    return events.filter("kind <> 'floor'").select("stream_id", "kind", plain("ts"))


def str8_recalibrated(spark, sf):
    """Each round finds its floor anew, from the three chunks behind its cool-down of two days."""
    t = live.Trigger(floor_chunks=3, absolute_db=24.0, pretrigger=0, window=1, rest=2 * DAY, recalibrate=True)
    events = drained(live.triggered(recorded(timed_chunks(spark, sf)), t))
    return rounded(events.select("stream_id", "seq", "kind", "floor"))


HITS = CHUNKS + """, fl AS (SELECT stream_id, median(power_db) AS floor FROM chunks WHERE seq < 20 GROUP BY 1 HAVING count(*) = 20), hits AS (SELECT stream_id, seq, ts FROM chunks JOIN fl USING (stream_id) WHERE seq >= 20 AND power_db >= floor + 4)"""


def str9_event_summary(spark, sf):
    """The whole summary of each day and class, as far as the watermark has come."""
    k = predictions(spark, sf)
    events = k.select(
        "ts", F.col("y_true").alias("condition"), F.col("y_pred").alias("prediction"), (F.col("y_pred") != "view").alias("alert"),
        F.when(F.col("y_pred") == "view", 1 - F.col("confidence")).otherwise(F.col("confidence")).alias("non_noise_confidence"),
        F.col("snr").cast("double").alias("snr_db"), F.round("value", 6).alias("e2e_ms"), F.round(F.col("value") / 3, 6).alias("infer_ms"),
    )
    out = drained(live.streamed_event_summary(recorded(events), "1 day"))
    return rounded(out.withColumn("start", plain("start")))


QUERIES = {n: f for n, f in list(globals().items()) if re.match(r"str\d", n) and getattr(f, "__module__", "") == __name__}
ORACLES = {
    "str8_timed_cooldown": HITS + """, step AS (SELECT stream_id, min(seq) AS s, arg_min(ts, seq) AS t FROM hits GROUP BY 1 UNION ALL
SELECT p.stream_id, min(h.seq), arg_min(h.ts, h.seq) FROM step p JOIN hits h ON h.stream_id = p.stream_id AND h.seq > p.s AND h.ts >= p.t + INTERVAL 2 DAY GROUP BY p.stream_id, p.s)
SELECT stream_id, s AS seq, t AS ts FROM step""",
    "str5_timeouts": HITS + """, ends AS (SELECT stream_id, max(ts) AS last, (SELECT max(ts) FROM chunks) - INTERVAL 10 SECOND AS watermark FROM chunks GROUP BY 1),
step AS (SELECT stream_id, 'floor' AS kind, ts, ts AS wait FROM chunks WHERE seq = 19 UNION ALL
SELECT stream_id, CASE WHEN hit IS NULL THEN 'timeout' ELSE 'capture' END, coalesce(hit, due), coalesce(hit, due) + INTERVAL 6 HOUR FROM (
    SELECT p.stream_id, p.wait + INTERVAL 36 HOUR AS due, min(h.ts) AS hit FROM step p LEFT JOIN hits h ON h.stream_id = p.stream_id AND h.ts >= p.wait AND h.ts <= p.wait + INTERVAL 36 HOUR GROUP BY ALL)
JOIN ends USING (stream_id) WHERE hit IS NOT NULL OR due < last OR due <= watermark)
SELECT stream_id, kind, ts FROM step WHERE kind <> 'floor'""",
    "str8_recalibrated": CHUNKS + """, start AS (SELECT stream_id, min(seq) AS s FROM chunks GROUP BY 1),
step AS (SELECT stream_id, s AS open, 0 AS kind, s AS seq FROM start UNION ALL
SELECT stream_id, open, kind, seq FROM (
    SELECT p.stream_id, CASE WHEN p.kind = 0 THEN p.open ELSE NULL END AS open, 1 AS kind, min(c.seq) AS seq FROM step p JOIN chunks c ON c.stream_id = p.stream_id AND c.seq >= p.open + 3 AND c.power_db >= 24 WHERE p.kind = 0 GROUP BY ALL
    UNION ALL
    SELECT p.stream_id, min(c.seq), 0, min(c.seq) FROM step p JOIN chunks h ON h.stream_id = p.stream_id AND h.seq = p.seq JOIN chunks c ON c.stream_id = p.stream_id AND c.seq > p.seq AND c.ts >= h.ts + INTERVAL 2 DAY WHERE p.kind = 1 GROUP BY p.stream_id, p.seq)),
floors AS (SELECT s.stream_id, s.open, s.open + 2 AS seq, median(c.power_db) AS floor FROM step s JOIN chunks c ON c.stream_id = s.stream_id AND c.seq BETWEEN s.open AND s.open + 2 WHERE s.kind = 0 GROUP BY ALL HAVING count(*) = 3)
SELECT stream_id, seq, 'floor' AS kind, round(floor, 6) + 0.0 AS floor FROM floors UNION ALL
SELECT s.stream_id, s.seq, 'capture', round(f.floor, 6) + 0.0 FROM step s JOIN floors f ON f.stream_id = s.stream_id AND f.open = s.open WHERE s.kind = 1""",
    "str9_event_summary": PRED + """, e AS (SELECT date_trunc('day', ts) AS start, y_true AS condition, y_pred, (y_pred <> 'view')::INT AS alert, CASE WHEN y_pred = 'view' THEN 1 - confidence ELSE confidence END AS c, snr, round(value, 6)::DECIMAL(28, 12) AS v, round(value / 3, 6)::DECIMAL(28, 12) AS w FROM predictions),
k AS (SELECT start, condition, y_pred, count(*) AS n FROM e GROUP BY ALL), top AS (SELECT start, condition, string_agg(y_pred || ':' || n, ',' ORDER BY n DESC, y_pred) AS top_predictions FROM k GROUP BY ALL)
SELECT start, condition, count(*) AS events, sum(alert)::BIGINT AS alerts, sum(1 - alert)::BIGINT AS no_alerts, round(100 * avg(alert), 6) + 0.0 AS alert_rate_pct, round(max(c), 6) + 0.0 AS max_non_noise_confidence,
round(avg(snr), 6) + 0.0 AS mean_snr_db, round(sum(v)::DOUBLE / count(*), 6) + 0.0 AS mean_e2e_ms, round(sum(w)::DOUBLE / count(*), 6) + 0.0 AS mean_infer_ms, any_value(top_predictions) AS top_predictions
FROM e JOIN top USING (start, condition) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM predictions) GROUP BY start, condition""",
}
