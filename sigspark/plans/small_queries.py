"""Registered queries on class counts, checkpoints and per-sample stacks, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as met
from ..operators import windows as win
from .catalogue_queries import light, rounded
from .tables import captures, predictions, r6, with_tables

CAP, PRED, CAPIQ = with_tables("captures"), with_tables("predictions"), with_tables("captures", "iq")


def checkpoints(spark, sf):
    """One checkpoint per stream and day, a third of them without a figure."""
    rows = predictions(spark, sf).groupBy(F.col("stream_id").alias("run"), F.concat("condition", F.lit(".ckpt")).alias("checkpoint")).agg(F.avg("confidence").alias("a"))
    return rows.select("run", "checkpoint", F.when(F.col("run") % 3 > 0, F.round("a", 4)).alias("accuracy"))


CKPT = PRED + ", ckpt AS (SELECT stream_id AS run, condition || '.ckpt' AS checkpoint, CASE WHEN stream_id % 3 > 0 THEN round(avg(confidence), 4) END AS accuracy FROM predictions GROUP BY stream_id, condition)"


def agg2_class_counts(spark, sf):
    return light(spark, sf).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))


def agg4_class_coverage(spark, sf):
    return met.class_coverage(light(spark, sf), "class_name", 10)


def agg24_best_checkpoint(spark, sf):
    return rounded(met.best_checkpoint(checkpoints(spark, sf), "run"))


AGG24 = CKPT + ", r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY accuracy DESC NULLS LAST, checkpoint) AS k FROM ckpt) SELECT run, CASE WHEN accuracy IS NOT NULL THEN checkpoint END AS checkpoint, round(accuracy, 6) + 0.0 AS accuracy FROM r WHERE k = 1"


def jn7_predictions_with_captures(spark, sf):
    caps = light(spark, sf).select("capture_id", "class_name")
    return predictions(spark, sf).select("capture_id", "y_pred").join(caps, "capture_id")


def jn8_checkpoint_metadata(spark, sf):
    meta = predictions(spark, sf).filter("snr > 10").groupBy(F.concat("condition", F.lit(".ckpt")).alias("checkpoint")).agg(F.max("snr").alias("max_snr"))
    best = met.best_checkpoint(checkpoints(spark, sf), "run")
    return rounded(met.checkpoint_table(best, meta))


JN8 = AGG24.replace(" SELECT run, CASE", ", b AS (SELECT run, CASE", 1) + "), m AS (SELECT condition || '.ckpt' AS checkpoint, max(snr) AS max_snr FROM predictions WHERE snr > 10 GROUP BY 1) SELECT b.*, m.max_snr FROM b LEFT JOIN m USING (checkpoint)"


def top4_head(spark, sf):
    return predictions(spark, sf).orderBy("capture_id").limit(100).select("capture_id", "y_true")


def ft17_feature_stack(spark, sf):
    rows = captures(spark, sf).withColumn("label", F.when(F.col("target_raw") > 4, F.col("target_raw")))
    out = win.feature_stack(rows, ["label"]).select("capture_id", F.posexplode("stack").alias("n", "s"))
    return out.select("capture_id", "n", *[r6(F.col("s")[k]).alias(c) for k, c in enumerate(("i", "q", "snr", "label"))])


FT17 = CAPIQ + """, m AS (SELECT *, max(abs(i)) OVER (PARTITION BY capture_id) AS di, max(abs(q)) OVER (PARTITION BY capture_id) AS dq FROM iq)
SELECT capture_id, n, round(i / di, 6) + 0.0 AS i, round(q / dq, 6) + 0.0 AS q, snr::DOUBLE AS snr, CASE WHEN target_raw > 4 THEN target_raw ELSE 0 END::DOUBLE AS label FROM m JOIN captures USING (capture_id)"""

QUERIES = {f.__name__: f for f in (agg2_class_counts, agg4_class_coverage, agg24_best_checkpoint, jn7_predictions_with_captures, jn8_checkpoint_metadata, top4_head, ft17_feature_stack)}
ORACLES = {
    "agg2_class_counts": CAP + " SELECT class_name, count(*) AS n FROM captures GROUP BY 1", "agg4_class_coverage": CAP + " SELECT count(DISTINCT class_name) AS classes, count(DISTINCT class_name) >= 10 AS enough FROM captures",
    "agg24_best_checkpoint": AGG24, "jn7_predictions_with_captures": with_tables("predictions", "captures") + " SELECT p.capture_id, y_pred, class_name FROM predictions p JOIN captures USING (capture_id)",
    "jn8_checkpoint_metadata": JN8, "top4_head": PRED + " SELECT capture_id, y_true FROM predictions ORDER BY capture_id LIMIT 100", "ft17_feature_stack": FT17,
}
