"""Scores and decisions: prototypes, probabilities, calibration, ensembles, thresholds, trial logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import softmax, total, unit
from .metrics import per_class



def prototypes(vectors: DataFrame, label: str = "label", column: str = "embedding") -> DataFrame:
    """(label, prototype): the mean of unit vectors per class, at unit length. Partial sums by position, then one row per class."""
    rows = vectors.select(label, F.posexplode(unit(F.col(column))).alias("pos", "value"))
    means = rows.groupBy(label, "pos").agg(F.avg("value").alias("value"))
    listed = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s.value).alias("prototype"))
    return listed.withColumn("prototype", unit(F.col("prototype")))


def prototype_logits(vectors: DataFrame, protos: DataFrame, temperature: float = 0.1, key: str = "capture_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """Adds logits: cosines with every prototype, in label order, by temperature. All prototypes come in one broadcast row."""
    table = protos.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(label), "prototype"))), lambda s: s.prototype).alias("prototypes"))
    x = unit(F.col(column))
    dot = lambda p: total(F.zip_with("unit", p, lambda a, b: a * b)) / temperature
    rows = vectors.withColumn("unit", x).crossJoin(F.broadcast(table))
    return rows.withColumn("logits", F.transform("prototypes", dot)).drop("unit", "prototypes")


def scored(windows: DataFrame, model: Callable, schema: str) -> DataFrame:
    """Batch scoring: ``model()`` is made once per task and maps pandas frames of windows to frames of ``schema``."""

    def run(frames: Iterator) -> Iterator:
        score = model()
        for frame in frames:
            yield score(frame)

    return windows.mapInPandas(run, schema)


def argmax(probs: Column) -> Column:
    """Place of the first largest entry, from 0."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def decided(df: DataFrame, labels: list[str], noise: str = "Noise", probs: str = "probs") -> DataFrame:
    """Adds prediction, confidence, non_noise_mass, best_non_noise and its conditional confidence."""
    names = F.array(*map(F.lit, labels))
    place = labels.index(noise) if noise in labels else -1
    others = F.transform(probs, lambda p, k: F.when(k == place, -1.0).otherwise(p))
    mass = total(F.transform(probs, lambda p, k: F.when(k == place, 0.0).otherwise(p)))
    best = F.array_max(others)
    df = df.withColumns({"prediction": F.element_at(names, argmax(F.col(probs)) + 1), "confidence": F.array_max(probs), "non_noise_mass": mass})
    return df.withColumns({"best_non_noise": F.element_at(names, argmax(others) + 1), "non_noise_confidence": F.when(F.col("non_noise_mass") > 0, best / F.col("non_noise_mass")).otherwise(best)})


def decision(mode: str, prediction: Column, confidence: Column, best: Column, best_confidence: Column) -> Column:
    """struct(label, confidence) by mode: raw or non-noise."""
    raw = F.struct(prediction.alias("label"), confidence.alias("confidence"))
    return raw if mode == "raw" else F.struct(best.alias("label"), best_confidence.alias("confidence"))


def hybrid_decision(prediction: Column, signal: Column, best: Column, best_confidence: Column, target: Column | None = None, target_confidence: Column | None = None, threshold: float = 0.55, noise: str = "Noise") -> Column:
    """A background prediction with a signal present is promoted to the target, or to the best other class, from a threshold on."""
    promoted = F.when(best_confidence >= threshold, best)
    if target is not None:
        promoted = F.when(target.isNotNull() & (target_confidence >= threshold), target).otherwise(promoted)
    return F.when((prediction == noise) & signal, F.coalesce(promoted, prediction)).otherwise(prediction)


def signal_present(power: Column, floor: Column, margin_db: float = 4.0) -> Column:
    return power >= floor + margin_db


def noise_floor(chunks: DataFrame, first: int = 20, *by: str) -> DataFrame:
    """(by..., floor): the median power of the first chunks of each stream."""
    by = by or ("stream_id",)
    return chunks.filter(F.col("seq") < first).groupBy(*by).agg(F.median("power_db").alias("floor"))


def best_windows(df: DataFrame, score: Column, *columns: str) -> DataFrame:
    """The first window of each capture with the largest score."""
    best = F.max_by(F.struct("start", *columns), F.struct(score, -F.col("start"))).alias("best")
    return df.groupBy("capture_id").agg(best).select("capture_id", "best.*")


def window_score(mode: str, labels: list[str], target: str | None = None, noise: str = "Noise") -> Column:
    """Score of a window's probabilities: raw, target or non-noise; auto is the target's if there is one."""
    mode = ("target" if target else "non-noise") if mode == "auto" else mode
    if mode == "raw":
        return F.array_max("probs")
    if mode == "target":
        return F.element_at("probs", labels.index(target) + 1)
    return F.array_max(F.transform("probs", lambda p, k: F.when(k == labels.index(noise), -1.0).otherwise(p)))


def top_k(probs: Column, labels: list[str], k: int = 3) -> Column:
    """The k most likely labels as structs, without a shuffle; ties in label order."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("key"), i.alias("i")))
    names = F.array(*map(F.lit, labels))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(F.element_at(names, s.i + 1).alias("label"), (-s.key).alias("prob")))


def mean_probs(df: DataFrame, *by: str) -> DataFrame:
    """(by..., probs): the mean vector over views of a capture."""
    by = by or ("capture_id",)
    rows = df.select(*by, F.posexplode("probs").alias("pos", "p")).groupBy(*by, "pos").agg(F.avg("p").alias("p"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s.p).alias("probs"))


def ensemble(scores: DataFrame, models: int) -> DataFrame:
    """(capture_id, label, score) by the mean over ``models`` of (capture_id, model, label, score) rows, missing ones as 0; the first best by name."""
    mean = scores.groupBy("capture_id", "label").agg((F.sum("score") / models).alias("score"))
    return mean.groupBy("capture_id").agg(F.min(F.struct(-F.col("score"), F.col("label"))).alias("b")).select("capture_id", F.col("b.label").alias("label"), (-F.col("b")["col1"]).alias("score"))


def prior_shift(probs: DataFrame, truth: DataFrame) -> DataFrame:
    """(class_idx, shift): log of the true share over the log of the mean predicted probability, both smoothed by 1e-6 and renormalised.

    ``probs`` has (capture_id, probs), ``truth`` (capture_id, class_idx).
    """
    mean = probs.select(F.posexplode("probs").alias("class_idx", "p")).groupBy("class_idx").agg(F.avg("p").alias("p"))
    counts = truth.groupBy("class_idx").agg(F.count(F.lit(1)).alias("n"))
    rows = mean.join(F.broadcast(counts), "class_idx", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = rows.agg(F.sum("n").alias("sn"), F.sum("p").alias("sp"))
    return rows.crossJoin(F.broadcast(sums)).select("class_idx", (F.log(F.col("n") / F.col("sn") + 1e-6) - F.log(F.col("p") / F.col("sp") + 1e-6)).alias("shift"))


def calibrated(probs: Column, shift: Column, alpha: Column, temperature: Column) -> Column:
    """softmax(log(p) / T + alpha * shift), p at least 1e-8."""
    logits = F.zip_with(probs, shift, lambda p, s: F.log(F.greatest(p, F.lit(1e-8))) / temperature + alpha * s)
    return softmax(logits)


def calibration_sweep(probs: DataFrame, shift: DataFrame, alphas: list[float], temperatures: list[float]) -> DataFrame:
    """(alpha, temperature, accuracy, macro_f1, classes, is_best) over a grid, in one pass over (capture_id, y_true, probs).

    The grid is a literal array; rows are reduced to confusion counts before anything else moves. Best:
    macro F1, then accuracy, then classes, all falling; then the grid's order.
    """
    shifts = shift.agg(F.transform(F.array_sort(F.collect_list(F.struct("class_idx", "shift"))), lambda s: s.shift).alias("shifts"))
    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(t).alias("temperature")) for a in alphas for t in temperatures])
    logits = F.zip_with("probs", "shifts", lambda p, s: F.log(F.greatest(p, F.lit(1e-8))) / F.col("g.temperature") + F.col("g.alpha") * s)
    rows = probs.crossJoin(F.broadcast(shifts)).withColumn("g", F.explode(grid)).select("g.alpha", "g.temperature", "y_true", argmax(F.transform(logits, lambda x: F.round(x, 9))).alias("y_pred"))
    counts = rows.groupBy("alpha", "temperature", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.groupBy("alpha", "temperature").agg(F.countDistinct("y_pred").alias("classes"))
    out = weighted_metrics(counts, "alpha", "temperature").join(kinds, ["alpha", "temperature"])
    order = Window.orderBy(F.desc(F.round("macro_f1", 9)), F.desc(F.round("accuracy", 9)), F.desc("classes"), "alpha", "temperature")
    return out.withColumn("is_best", F.row_number().over(order) == 1)


def weighted_metrics(counts: DataFrame, *by: str) -> DataFrame:
    """classification_metrics of rows that are counts already."""
    rows = per_class(counts, *by)
    n = F.sum("support")
    return rows.groupBy(*by).agg((F.sum("tp") / n).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"))


def generated_audit(samples: DataFrame) -> DataFrame:
    """Per requested class: accuracy, mean confidence and count of (requested, predicted, confidence) rows."""
    hit = F.avg((F.col("requested") == F.col("predicted")).cast("double"))
    return samples.groupBy("requested").agg(hit.alias("accuracy"), F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("n"))


def audit_matrix(samples: DataFrame, labels: list[str]) -> DataFrame:
    """(requested, predicted, n, share of the requested class) of (requested, predicted) rows for all pairs of labels, zeros too."""
    names = F.array(*map(F.lit, labels))
    spark = samples.sparkSession
    every = spark.range(1).select(F.explode(names).alias("requested")).select("requested", F.explode(names).alias("predicted"))
    found = samples.groupBy("requested", "predicted").agg(F.count(F.lit(1)).alias("n"))
    rows = every.join(found, ["requested", "predicted"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("requested"))
    return rows.select("requested", "predicted", "n", F.when(total > 0, F.col("n") / total).otherwise(0.0).alias("share"))


# Lines of a trial's log, in the order in which they are tried.
LOG_LINES = (
    ((("tx_sample", 1),), r"^TX sample: (.+)$"),
    ((("tx_file_prediction", 1), ("tx_file_confidence", 2), ("tx_file_best_non_noise", 3), ("tx_file_non_noise_confidence", 4)),
     r"^TX file model prediction=(\S+) confidence=([0-9.]+) best_non_noise=(\S+) non_noise_confidence=([0-9.]+)"),
    ((("selected_window_start", 1), ("raw_capture_samples", 2)), r"^Selected .* window start=(\d+) from raw_capture_samples=(\d+)"),
    ((("capture_power_db", 1), ("capture_peak", 2), ("i_clip_pct", 3), ("q_clip_pct", 4), ("mag_fullscale_pct", 5)),
     r"^Capture power (-?[0-9.]+) dB, peak ([0-9.]+), I clip ([0-9.]+)%, Q clip ([0-9.]+)%, \|IQ\|>=1 ([0-9.]+)%"),
    ((("best_non_noise", 1), ("best_non_noise_confidence", 2)), r"^best_non_noise=(\S+) non_noise_confidence=([0-9.]+)"),
    ((("target_class", 1), ("target_non_noise_confidence", 2)), r"^target_class=(\S+) target_non_noise_confidence=([0-9.]+)"),
    ((("prediction", 1), ("confidence", 2), ("top", 3)), r"^\S+ prediction=(\S+) confidence=([0-9.]+) top=(.+)$"),
)


def parsed_trials(lines: DataFrame) -> DataFrame:
    """One row per trial from (trial, line_no, line): each field from the last line that gives it, null if none does.

    Of a line only the first pattern that fits counts; lines that begin with decision= are kept whole.
    """
    line, free, fields = F.col("line"), ~F.col("line").startswith("decision="), {}
    for names, pattern in LOG_LINES:
        hit = F.regexp_like(line, F.lit(pattern))
        for name, group in names:
            fields[name] = F.when(free & hit, F.regexp_extract(line, pattern, group))
        free = free & ~hit
    fields["decision"] = F.when(line.startswith("decision="), line)
    rows = lines.select("trial", "line_no", *[c.alias(n) for n, c in fields.items()])
    last = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in fields]
    return rows.groupBy("trial").agg(*last)


def forest_importances(features: DataFrame, columns: list[str], label: str = "label", trees: int = 20, seed: int = 7):
    """A random forest on feature columns, and (feature, importance) rows in falling order."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(features)
    model = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=seed).fit(rows)
    pairs = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)]
    return model, features.sparkSession.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def held_out_accuracy(model, rows: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """One row (rows, right, majority): how many rows, how many of them a fitted forest gets right, and how many the commonest label would."""
    from pyspark.ml.feature import VectorAssembler

    scored = model.transform(VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(rows))
    each = scored.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("prediction") == F.col(label)).cast("int")).alias("right"))
    return each.agg(F.sum("n").alias("rows"), F.sum("right").alias("right"), F.max("n").alias("majority"))
