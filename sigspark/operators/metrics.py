"""Metrics over predictions: confusion counts first, everything else from the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(preds: DataFrame, *by: str, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(by..., y_true, y_pred, n): the only pass over the predictions."""
    return preds.groupBy(*by, F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(conf: DataFrame, *by: str) -> DataFrame:
    """(by..., label, tp, support, predicted) of the union of true and predicted classes."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    rows = conf.select(*by, F.col("y_true").alias("label"), hit.alias("tp"), F.col("n").alias("support"), none.alias("predicted")).unionByName(
        conf.select(*by, F.col("y_pred").alias("label"), none.alias("tp"), none.alias("support"), F.col("n").alias("predicted"))
    )
    return rows.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def per_class(conf: DataFrame, *by: str) -> DataFrame:
    """(by..., label, precision, recall, f1, support)."""
    tp, n, m = F.col("tp"), F.col("support"), F.col("predicted")
    return class_counts(conf, *by).select(
        *by, "label", ratio(tp, m).alias("precision"), ratio(tp, n).alias("recall"), ratio(2 * tp, n + m).alias("f1"), "support", "tp"
    )


def classification_metrics(preds: DataFrame, *by: str) -> DataFrame:
    """(by..., accuracy, macro_f1, weighted_f1, n), zero where a class has no predictions."""
    rows = per_class(confusion(preds, *by), *by)
    n = F.sum("support")
    return rows.groupBy(*by).agg(
        (F.sum("tp") / n).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), n.alias("n")
    )


def classification_report(preds: DataFrame) -> DataFrame:
    """Rows per class, then accuracy, macro avg and weighted avg."""
    rows = per_class(confusion(preds))
    columns = ["precision", "recall", "f1"]
    n = F.sum("support")
    macro = rows.agg(*[F.avg(c).alias(c) for c in columns], n.alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = rows.agg(*[(F.sum(F.col(c) * F.col("support")) / n).alias(c) for c in columns], n.alias("support")).withColumn("label", F.lit("weighted avg"))
    accuracy = rows.agg((F.sum("tp") / n).alias("f1"), n.alias("support")).withColumn("label", F.lit("accuracy"))
    return rows.drop("tp").unionByName(macro).unionByName(weighted).unionByName(accuracy, allowMissingColumns=True)


def confusion_matrix(preds: DataFrame, labels: list[str]) -> DataFrame:
    """One row per label with a column per label, zeros filled; for small fixed label sets."""
    spark = preds.sparkSession
    wide = confusion(preds).groupBy("y_true").pivot("y_pred", labels).agg(F.sum("n"))
    every = spark.createDataFrame([(x,) for x in labels], "y_true string")
    return every.join(wide, "y_true", "left").na.fill(0, labels)


def accuracy(preds: DataFrame, *by: str, percent: bool = False) -> DataFrame:
    """(by..., accuracy, samples)."""
    hit = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    return preds.groupBy(*by).agg((hit * 100 if percent else hit).alias("accuracy"), F.count(F.lit(1)).alias("samples"))


def class_snr_grid(preds: DataFrame, snrs: list[int]) -> DataFrame:
    """One row per class, one column per ratio; cells without rows are null."""
    hit = F.avg((F.col("y_true") == F.col("y_pred")).cast("double")) * 100
    return preds.groupBy("y_true").pivot("snr", snrs).agg(hit)


def peak_by_class(preds: DataFrame) -> DataFrame:
    """(y_true, peak, peak_snr): the best accuracy and the lowest ratio that has it, null where the peak is 0."""
    cells = accuracy(preds, "y_true", "snr", percent=True)
    best = F.min(F.struct(-F.col("accuracy"), F.col("snr"))).alias("best")
    rows = cells.groupBy("y_true").agg(best).select("y_true", (-F.col("best")["col1"]).alias("peak"), F.col("best.snr").alias("peak_snr"))
    return rows.withColumn("peak_snr", F.when(F.col("peak") > 0, F.col("peak_snr")))


def ranked_peaks(preds: DataFrame, top: int = 6, bottom: int = 5) -> DataFrame:
    """Classes by falling peak (ties by name), with flags for the first and last ones."""
    peaks = peak_by_class(preds)
    order = Window.orderBy(F.desc("peak"), "y_true")
    ranked = peaks.withColumn("rank", F.row_number().over(order)).crossJoin(F.broadcast(peaks.agg(F.count(F.lit(1)).alias("classes"))))
    return ranked.withColumn("is_top", F.col("rank") <= top).withColumn("is_bottom", F.col("rank") > F.col("classes") - bottom).drop("classes")


def order_calibration(preds: DataFrame, orders: dict[str, str]) -> DataFrame:
    """Accuracy under several label orders (name: column of the true index), in one pass; the first best wins.

    One row: a column per order, best_order, dominant_ratio (share of the commonest prediction).
    """
    hits = [F.avg((F.col(c) == F.col("y_pred")).cast("double")).alias(name) for name, c in orders.items()]
    common = preds.groupBy("y_pred").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("dominant_ratio"))
    best = F.array_max(F.array(*[F.struct(F.col(name).alias("a"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, name in enumerate(orders)]))
    return preds.agg(*hits).withColumn("best_order", best["name"]).crossJoin(F.broadcast(common))


def balanced_weights(df: DataFrame, column: str, doubled: str | None = None) -> DataFrame:
    """(column, n, weight): n of all / (classes * n), one named class twice as heavy."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    weight = F.col("total") / (F.col("k") * F.col("n"))
    weight = weight if doubled is None else F.when(F.col(column) == doubled, weight * 2).otherwise(weight)
    return counts.crossJoin(F.broadcast(totals)).select(column, "n", weight.alias("weight"))


def sweep_summary(trials: DataFrame) -> DataFrame:
    """Per target class, from the text columns of trials."""
    number = lambda c: F.col(c).try_cast("double")
    passed = F.sum((F.col("passed") == "1").cast("int"))
    return trials.groupBy(F.coalesce("target_class", F.lit("?")).alias("class")).agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(passed, F.lit(0)).alias("passed"),
        (F.coalesce(passed, F.lit(0)) / F.count(F.lit(1))).alias("accuracy"),
        F.min(number("target_non_noise_confidence")).alias("min_target_confidence"), F.avg(number("target_non_noise_confidence")).alias("mean_target_confidence"),
        F.avg(number("capture_power_db")).alias("mean_capture_power_db"), F.max(number("mag_fullscale_pct")).alias("max_fullscale_pct"),
    )


def event_summary(events: DataFrame, *by: str) -> DataFrame:
    """Counts, alert rate, largest non-noise confidence, means, and label:count of the predictions, commonest first."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("snr_db", "e2e_ms", "infer_ms") if c in events.columns]
    alert = F.col("alert").cast("int")
    base = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"), F.sum(alert).alias("alerts"), F.sum(1 - alert).alias("no_alerts"), (F.avg(alert) * 100).alias("alert_rate_pct"),
        F.max("non_noise_confidence").alias("max_non_noise_confidence"), *means,
    )
    counts = events.groupBy(*by, "prediction").agg(F.count(F.lit(1)).alias("n"))
    top = F.sort_array(F.collect_list(F.struct(-F.col("n"), "prediction", F.concat_ws(":", "prediction", "n").alias("text"))))
    names = counts.groupBy(*by).agg(F.concat_ws(",", F.transform(top, lambda x: x.text)).alias("top_predictions"))
    return base.join(names, list(by))


def phase_card(reports: DataFrame) -> DataFrame:
    """Per phase and for all (phase null): reports, correct, alerts, no_alerts, passed."""
    correct, alert = (F.col("prediction") == F.col("expected")).cast("int"), F.col("alert").cast("int")
    return reports.rollup("phase").agg(
        F.count(F.lit(1)).alias("reports"), F.sum(correct).alias("correct"), F.sum(alert).alias("alerts"), F.sum(1 - alert).alias("no_alerts"),
        (F.sum(correct) == F.count(F.lit(1))).alias("passed"),
    )


def best_epoch(history: DataFrame, *by: str) -> DataFrame:
    """Last epoch, best validation accuracy, and the first epoch of the best metric (macro F1, else accuracy)."""
    metric = F.coalesce(*[F.col(c) for c in ("val_macro_f1", "val_accuracy") if c in history.columns])
    rows = history.withColumn("metric", metric)
    return rows.groupBy(*by).agg(
        F.max("epoch").alias("last_epoch"), F.max("val_accuracy").alias("best_val_accuracy"),
        F.min(F.when(F.col("metric").isNotNull(), F.struct(-F.col("metric"), F.col("epoch")))).alias("best"),
    ).select(*by, "last_epoch", "best_val_accuracy", F.col("best.epoch").alias("best_epoch"))


def global_epochs(history: DataFrame) -> DataFrame:
    """Numbers the epochs of successive runs through: (run_id, epoch, global_epoch)."""
    lengths = history.groupBy("run_id").agg(F.max("epoch").alias("length"))
    before = F.coalesce(F.sum("length").over(Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return history.join(lengths.select("run_id", before.alias("start")), "run_id").withColumn("global_epoch", F.col("start") + F.col("epoch")).drop("start")


def event_counts(preds: DataFrame) -> DataFrame:
    """(label, predicted, truth): counts side by side."""
    p = preds.groupBy(F.col("y_pred").alias("label")).agg(F.count(F.lit(1)).alias("predicted"))
    t = preds.groupBy(F.col("y_true").alias("label")).agg(F.count(F.lit(1)).alias("truth"))
    return p.join(t, "label", "full").na.fill(0)


def comparison_table(rows: DataFrame) -> DataFrame:
    """Comparison rows from loosely typed metrics: fallback keys, numbers or null, in order of dataset, split, accuracy."""
    number = lambda *names: F.coalesce(*[F.col(n).try_cast("double") for n in names if n in rows.columns], F.lit(None).cast("double"))
    text = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in rows.columns], F.lit(""))
    return rows.select(
        text("dataset").alias("dataset"), text("model", "model_name", "name").alias("model"), text("family").alias("family"), text("split", "eval_split").alias("split"),
        number("accuracy", "test_accuracy", "acc").alias("accuracy"), number("macro_f1", "f1_macro").alias("macro_f1"), number("weighted_f1", "f1_weighted").alias("weighted_f1"),
        text("notes").alias("notes"),
    ).orderBy("dataset", "split", F.desc_nulls_last("accuracy"))


def parity(a: DataFrame, b: DataFrame, rtol: float = 1e-3, atol: float = 1e-4) -> DataFrame:
    """Two sets of probability vectors on capture_id: top-1 agreement, largest and mean error, and whether all are close."""
    both = a.select("capture_id", F.col("probs").alias("x")).join(b.select("capture_id", F.col("probs").alias("y")), "capture_id")
    error = F.zip_with("x", "y", lambda x, y: F.abs(x - y))
    close = F.forall(F.zip_with("x", "y", lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: ok)
    top = lambda c: F.array_position(c, F.array_max(c))
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.avg((top("x") == top("y")).cast("double")).alias("top1_agreement"), F.max(F.array_max(error)).alias("max_abs_error"),
        (F.sum(F.aggregate(error, F.lit(0.0), lambda s, e: s + e)) / F.sum(F.size("x"))).alias("mean_abs_error"), F.bool_and(close).alias("all_close"),
    )


def class_coverage(df: DataFrame, column: str, least: int) -> DataFrame:
    """One row: the number of classes and whether it reaches ``least``."""
    return df.agg(F.countDistinct(column).alias("classes")).withColumn("enough", F.col("classes") >= least)


def checkpoint_table(metrics: DataFrame, metadata: DataFrame, key: str = "checkpoint") -> DataFrame:
    """Checkpoint metrics with their metadata, nulls where there is none."""
    return metrics.join(metadata, key, "left")


def best_checkpoint(metrics: DataFrame, *by: str, key: str = "checkpoint") -> DataFrame:
    """(by..., checkpoint, accuracy): the best by evaluation accuracy, the first by name of equals; rows without one don't count."""
    best = F.min(F.when(F.col("accuracy").isNotNull(), F.struct((-F.col("accuracy")).alias("a"), F.col(key).alias("k")))).alias("best")
    return metrics.groupBy(*by).agg(best).select(*by, F.col("best.k").alias(key), (-F.col("best.a")).alias("accuracy"))
