"""Registered queries on catalogues, samples and metrics, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as cat
from ..operators import metrics as met
from ..operators import sampling as smp
from .tables import TYPES, captures, predictions, r6, table, with_tables

SEED = 1961
KEY = f"md5(concat_ws('|', '{SEED}', capture_id))"
CAP, PRED = with_tables("captures"), with_tables("predictions")
SNRS = list(range(-20, 20, 2))
PATHS = "paths AS (SELECT doc_id, source AS label, source || '/pack' || (doc_id % 7) || '_0-1s' || CASE WHEN doc_id % 3 = 0 THEN '_snr' || (doc_id % 20 - 5) WHEN doc_id % 3 = 1 THEN '_' || (doc_id % 9) || '.5 dB' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '.xml' ELSE '.iq' END AS path FROM documents)"


def light(spark, sf):
    """Captures without their samples."""
    return captures(spark, sf).drop("iq")


def paths(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    snr = F.when(d % 3 == 0, F.concat(F.lit("_snr"), d % 20 - 5)).when(d % 3 == 1, F.concat(F.lit("_"), d % 9, F.lit(".5 dB"))).otherwise("")
    path = F.concat("source", F.lit("/pack"), d % 7, F.lit("_0-1s"), snr, F.when(d % 5 == 0, ".xml").otherwise(".iq"))
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("label"), path.alias("path"))


def prj1_parse_names(spark, sf):
    df = cat.parse_noisy_names(light(spark, sf).select("capture_id", "filepath"))
    return df.select("capture_id", "sample_id", "target_raw", "snr")


PRJ1 = CAP + " SELECT capture_id, capture_id::INT AS sample_id, target_raw, snr FROM captures"


def prj2_rml_names(spark, sf):
    names = predictions(spark, sf).select("capture_id", F.concat(F.lit("RML2016_"), "y_true", F.lit("_snr"), "snr", F.lit("_sample"), "capture_id").alias("name"))
    return cat.parse_rml_names(names).drop("name")


PRJ2 = PRED + " SELECT capture_id, y_true AS modulation, snr, capture_id::INT AS sample FROM predictions"


def prj3_infer_snr(spark, sf):
    return paths(spark, sf).select("doc_id", cat.infer_snr(F.col("path"), F.col("label")).alias("snr"))


INFERRED = "SELECT doc_id, coalesce(nullif(regexp_extract(path, '(?i)snr[_=\\- ]*(-?\\d+(?:\\.\\d+)?)', 1), '')::DOUBLE, nullif(regexp_extract(path, '(?i)(-?\\d+(?:\\.\\d+)?)\\s*dB', 1), '')::DOUBLE) AS snr FROM paths"
PRJ3 = f"WITH {PATHS} {INFERRED}"


def prj4_safe_labels(spark, sf):
    names = table(spark, sf, "pages").select("page_id", F.concat(F.col("url"), F.lit(" pack é.rar")).alias("archive"))
    return names.select("page_id", cat.safe_label(F.col("archive")).alias("label"))


PRJ4 = """SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(trim(regexp_replace(regexp_extract(url || ' pack é.rar', '([^/]*)$', 1), '\\.[^.]*$', '')), '\\s+', '_', 'g'), '[^A-Za-z0-9_-]', '', 'g'), ''), 'unknown') AS label FROM pages"""


def prj5_label_index(spark, sf):
    return cat.label_index(cat.snr_slice(light(spark, sf), low=0)).select("capture_id", "target_raw", "label_idx")


PRJ5 = CAP + " SELECT capture_id, target_raw, dense_rank() OVER (ORDER BY target_raw) - 1 AS label_idx FROM captures WHERE snr >= 0"


def prj6_onehot(spark, sf):
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == F.col("label"), 1).otherwise(0))
    return table(spark, sf, "embeddings").select("vec_id", cat.onehot_index(hot).alias("class_idx"))


def flt1_snr_slices(spark, sf):
    caps = light(spark, sf)
    parts = {"min": cat.snr_slice(caps, low=4), "open": cat.snr_slice(caps, above=4, high=10), "closed": cat.snr_slice(caps, low=-6, high=6)}
    return smp.union_all(*[p.groupBy("class_name").agg(F.count(F.lit(1)).alias("n")).withColumn("slice", F.lit(k)) for k, p in parts.items()])


FLT1 = CAP + """ SELECT class_name, count(*) AS n, 'min' AS slice FROM captures WHERE snr >= 4 GROUP BY 1
UNION ALL SELECT class_name, count(*), 'open' FROM captures WHERE snr > 4 AND snr <= 10 GROUP BY 1 UNION ALL SELECT class_name, count(*), 'closed' FROM captures WHERE snr >= -6 AND snr <= 6 GROUP BY 1"""


def flt2_max_snr(spark, sf):
    return cat.at_max_snr(predictions(spark, sf)).select("capture_id", "y_true", "snr")


def flt3_top_levels(spark, sf):
    rows = paths(spark, sf).withColumn("snr", cat.infer_snr(F.col("path")))
    return cat.top_snr_levels(rows, 8).select("doc_id", "snr")


FLT3 = f"WITH {PATHS}, inferred AS ({INFERRED}) SELECT doc_id, snr FROM inferred WHERE snr IN (SELECT DISTINCT snr FROM inferred WHERE snr IS NOT NULL ORDER BY snr DESC LIMIT 8)"


def flt4_iq_files(spark, sf):
    return cat.iq_files(paths(spark, sf), "path").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def flt5_high_snr_metrics(spark, sf):
    return rounded(met.classification_metrics(cat.snr_slice(predictions(spark, sf), above=5)))


def cln_strict_numbers(spark, sf):
    pages = table(spark, sf, "pages")
    text = F.regexp_extract("url", r"/(\d+)[^/]*$", 1)
    value = F.when(F.col("page_id") % 4 == 0, "NaN").when(F.col("page_id") % 4 == 1, "1e39").otherwise(text)
    return pages.select("page_id", cat.strict_number(value).alias("value"), cat.padded_row(F.array(value, text), 3).alias("padded")).select("page_id", "value", F.col("padded")[1].alias("second"), F.col("padded")[2].alias("third"))


CLN = """WITH t AS (SELECT page_id, regexp_extract(url, '/(\\d+)[^/]*$', 1) AS txt FROM pages), v AS (SELECT page_id, txt, CASE page_id % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN '1e39' ELSE txt END AS raw FROM t)
SELECT page_id, CASE WHEN try_cast(raw AS DOUBLE) IS NULL OR isnan(try_cast(raw AS DOUBLE)) OR abs(try_cast(raw AS DOUBLE)) > 3.4028234663852886e38 THEN 0.0 ELSE try_cast(raw AS DOUBLE) END AS value,
coalesce(try_cast(txt AS DOUBLE), 0.0) AS second, 0.0::DOUBLE AS third FROM v"""


def jn1_named_classes(spark, sf):
    classes = spark.createDataFrame([(k, f"class {k}") for k in range(7)], "class_idx int, class_name string")
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("class_int"))
    return cat.named_classes(rows, classes)


def listing_of(files):
    """The files that exist: half of them at another place, below files/."""
    return files.select(F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("files/"), "path")).alias("path"), "label")


def jn2_repaired_manifest(spark, sf):
    files = paths(spark, sf)
    manifest = files.select("doc_id", F.col("path").alias("filepath"), F.when(F.col("doc_id") % 11 == 0, "src0").otherwise(F.col("label")).alias("label"))
    return cat.repaired(manifest, listing_of(files))


JN2 = f"""WITH {PATHS}, listing AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN path ELSE 'files/' || path END AS path, label FROM paths),
manifest AS (SELECT doc_id, path AS filepath, CASE WHEN doc_id % 11 = 0 THEN 'src0' ELSE label END AS label FROM paths)
SELECT m.doc_id, m.filepath, m.label FROM manifest m JOIN listing l ON l.path = m.filepath AND l.label = m.label
UNION ALL SELECT m.doc_id, f.found, m.label FROM manifest m JOIN (SELECT regexp_extract(path, '([^/]*)$', 1) AS base, label, min(path) AS found FROM listing GROUP BY ALL) f
ON f.base = regexp_extract(m.filepath, '([^/]*)$', 1) AND f.label = m.label WHERE m.filepath NOT IN (SELECT path FROM listing)"""


def jn3_remapped_classes(spark, sf):
    rows = predictions(spark, sf)
    one = cat.indexed(rows, "y_true", "class_idx").withColumnRenamed("y_true", "class_name")
    other = one.select("class_name", (F.lit(len(TYPES) - 1) - F.col("class_idx")).alias("class_idx"))
    remap = cat.remapped_classes(one, other)
    return rows.join(F.broadcast(remap.withColumnRenamed("class_name", "y_true")), "y_true").groupBy("class_idx", "new_idx").agg(F.count(F.lit(1)).alias("n"))


JN3 = PRED + " SELECT dense_rank() OVER (ORDER BY y_true) - 1 AS class_idx, 5 - dense_rank() OVER (ORDER BY y_true) AS new_idx, count(*) AS n FROM predictions GROUP BY y_true"


def jn4_global_labels(spark, sf):
    a = cat.indexed(predictions(spark, sf), "y_true", "class_idx").withColumnRenamed("y_true", "class_name")
    b = cat.indexed(light(spark, sf), "class_name", "class_idx")
    return cat.global_labels(("events", a), ("captures", b))


JN4 = with_tables("predictions", "captures") + """, a AS (SELECT DISTINCT 'events' AS dataset, y_true AS c FROM predictions UNION SELECT DISTINCT 'captures', class_name FROM captures),
b AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY c) - 1 AS class_idx, dataset || ':' || c AS global_label FROM a) SELECT *, row_number() OVER (ORDER BY global_label) - 1 AS global_idx FROM b"""


def jn5_missing_artifacts(spark, sf):
    files = paths(spark, sf)
    return cat.missing_artifacts(files.select("doc_id", "path"), listing_of(files))


JN5 = f"WITH {PATHS} SELECT doc_id, path FROM paths WHERE path NOT IN (SELECT CASE WHEN doc_id % 2 = 0 THEN path ELSE 'files/' || path END FROM paths)"


def agg1_dataset_counts(spark, sf):
    cells = light(spark, sf).groupBy("class_name", "snr").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("class_name").agg(F.sum("n").alias("captures"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.concat_ws(",", F.sort_array(F.collect_set("snr"))).alias("snrs"))


AGG1 = CAP + """, cells AS (SELECT class_name, snr, count(*) AS n FROM captures GROUP BY ALL)
SELECT class_name, sum(n)::BIGINT AS captures, min(n) AS fewest, max(n) AS most, string_agg(snr::VARCHAR, ',' ORDER BY snr) AS snrs FROM cells GROUP BY 1"""


def agg3_label_conflicts(spark, sf):
    rows = paths(spark, sf).select(cat.basename(F.col("path")).alias("filepath"), "label")
    return cat.label_conflicts(rows).withColumn("labels", F.concat_ws(",", "labels"))


AGG3 = f"""WITH {PATHS}, r AS (SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) AS filepath, label FROM paths), c AS (SELECT filepath, count(*) AS n_labels, list(label ORDER BY label) AS l FROM r GROUP BY 1 HAVING count(*) > 1 ORDER BY filepath LIMIT 5)
SELECT filepath, n_labels, array_to_string(l[1:8], ',') AS labels FROM c"""


def rounded(df, *keep):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def agg5_metrics(spark, sf):
    return rounded(met.classification_metrics(predictions(spark, sf)))


def f1_sql(by: str = "", source: str = "predictions", where: str = "") -> str:
    """Metrics per group of ``by``, through counts per class."""
    g = f"{by}, " if by else ""
    on = " AND ".join([f"t.{c.strip()} = p.{c.strip()}" for c in by.split(",") if c] + ["t.label = p.label"])
    keys = "".join(f"coalesce(t.{c.strip()}, p.{c.strip()}) AS {c.strip()}, " for c in by.split(",") if c)
    return f"""t AS (SELECT {g}y_true AS label, count(*) AS n, sum((y_true = y_pred)::INT) AS tp FROM {source} {where} GROUP BY ALL), p AS (SELECT {g}y_pred AS label, count(*) AS m FROM {source} {where} GROUP BY ALL),
j AS (SELECT {keys}coalesce(t.label, p.label) AS label, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp, coalesce(m, 0) AS m FROM t FULL JOIN p ON {on}),
c AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE tp / m END AS precision, CASE WHEN n = 0 THEN 0 ELSE tp / n END AS recall, 2.0 * tp / (n + m) AS f1 FROM j)"""


METRICS = "round(sum(tp) / sum(n), 6) + 0.0 AS accuracy, round(avg(f1), 6) + 0.0 AS macro_f1, round(sum(f1 * n) / sum(n), 6) + 0.0 AS weighted_f1, sum(n)::BIGINT AS n"
AGG5 = f"{PRED}, {f1_sql()} SELECT {METRICS} FROM c"
FLT5 = f"{PRED}, {f1_sql(where='WHERE snr > 5')} SELECT {METRICS} FROM c"


def agg5_skewed_metrics(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred"))
    return rounded(met.classification_metrics(rows))


AGG5B = f"WITH skewed AS (SELECT quality AS y_true, 1 - toxic AS y_pred FROM labels), {f1_sql(source='skewed')} SELECT {METRICS} FROM c"


def agg6_report(spark, sf):
    return rounded(met.classification_report(predictions(spark, sf)))


AGG6 = f"""{PRED}, {f1_sql()}, r AS (SELECT label, precision, recall, f1, n FROM c UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(n) FROM c
UNION ALL SELECT 'weighted avg', sum(precision * n) / sum(n), sum(recall * n) / sum(n), sum(f1 * n) / sum(n), sum(n) FROM c UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(n), sum(n) FROM c)
SELECT label, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1, n::BIGINT AS support FROM r"""


def agg7_confusion(spark, sf):
    return met.confusion_matrix(predictions(spark, sf), [*TYPES, "unknown"])


AGG7 = PRED + ", l AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'unknown']) AS y_true) SELECT l.y_true, " + ", ".join(
    f"count(*) FILTER (y_pred = '{t}') AS {t}" for t in [*TYPES, "unknown"]
) + " FROM l LEFT JOIN predictions p ON p.y_true = l.y_true GROUP BY l.y_true"


def agg8_class_accuracy(spark, sf):
    return rounded(met.accuracy(predictions(spark, sf), "y_true"))


AGG8 = PRED + " SELECT y_true, round(avg((y_true = y_pred)::INT), 6) + 0.0 AS accuracy, count(*) AS samples FROM predictions GROUP BY 1"


def agg9_snr_accuracy(spark, sf):
    return rounded(met.accuracy(predictions(spark, sf), "snr", percent=True))


AGG9 = PRED + " SELECT snr, round(100 * avg((y_true = y_pred)::INT), 6) + 0.0 AS accuracy, count(*) AS samples FROM predictions GROUP BY 1"


def agg10_class_snr_grid(spark, sf):
    return rounded(met.class_snr_grid(predictions(spark, sf), SNRS))


AGG10 = PRED + " SELECT y_true, " + ", ".join(f"round(100 * avg((y_true = y_pred)::INT) FILTER (snr = {s}), 6) + 0.0 AS \"{s}\"" for s in SNRS) + " FROM predictions GROUP BY 1"
CELLS = PRED + ", cells AS (SELECT y_true, snr, 100 * avg((y_true = y_pred)::INT) AS a FROM predictions GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY a DESC, snr) AS k FROM cells)"


def agg11_peaks(spark, sf):
    return rounded(met.ranked_peaks(predictions(spark, sf), 2, 2))


AGG11 = CELLS + ", p AS (SELECT y_true, round(a, 6) + 0.0 AS peak, CASE WHEN a > 0 THEN snr END AS peak_snr, row_number() OVER (ORDER BY a DESC, y_true) AS rank FROM b WHERE k = 1) SELECT *, rank <= 2 AS is_top, rank > (SELECT count(*) FROM p) - 2 AS is_bottom FROM p"


def agg12_peak_overall(spark, sf):
    cells = met.accuracy(predictions(spark, sf), "snr", percent=True)
    best = F.min(F.struct(-F.col("accuracy"), F.col("snr"))).alias("b")
    return cells.agg(best).select(r6(-F.col("b")["col1"]).alias("accuracy"), F.col("b.snr").alias("snr"))


AGG12 = PRED + ", c AS (SELECT snr, round(100 * avg((y_true = y_pred)::INT), 6) + 0.0 AS accuracy FROM predictions GROUP BY 1) SELECT accuracy, snr FROM c ORDER BY accuracy DESC, snr LIMIT 1"


def agg13_order_calibration(spark, sf):
    place = lambda c: (F.array_position(F.array(*map(F.lit, TYPES)), F.col(c)) - 1).cast("int")
    rows = predictions(spark, sf).select(place("y_true").alias("fixed"), (4 - place("y_true")).alias("reversed"), ((place("y_true") + 1) % 5).alias("shifted"), place("y_pred").alias("y_pred"))
    return rounded(met.order_calibration(rows, {"reversed": "reversed", "fixed": "fixed", "shifted": "shifted"}))


AGG13 = PRED + """, r AS (SELECT list_position(['click', 'error', 'purchase', 'signup', 'view'], y_true) - 1 AS t, list_position(['click', 'error', 'purchase', 'signup', 'view'], y_pred) - 1 AS p FROM predictions),
a AS (SELECT avg((4 - t = p)::INT) AS reversed, avg((t = p)::INT) AS fixed, avg(((t + 1) % 5 = p)::INT) AS shifted FROM r), d AS (SELECT max(n) / sum(n) AS dominant_ratio FROM (SELECT count(*) AS n FROM r GROUP BY p))
SELECT round(reversed, 6) + 0.0 AS reversed, round(fixed, 6) + 0.0 AS fixed, round(shifted, 6) + 0.0 AS shifted, CASE WHEN reversed >= fixed AND reversed >= shifted THEN 'reversed' WHEN fixed >= shifted THEN 'fixed' ELSE 'shifted' END AS best_order,
round(dominant_ratio, 6) + 0.0 AS dominant_ratio FROM a, d"""


def agg16_class_weights(spark, sf):
    return rounded(met.balanced_weights(light(spark, sf), "class_name", "Noise"))


AGG16 = CAP + ", c AS (SELECT class_name, count(*) AS n FROM captures GROUP BY 1) SELECT class_name, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) * CASE WHEN class_name = 'Noise' THEN 2 ELSE 1 END, 6) + 0.0 AS weight FROM c"


def events_of(spark, sf):
    return predictions(spark, sf).select(
        "condition", F.col("y_pred").alias("prediction"), "confidence", (F.col("y_pred") != "view").alias("alert"),
        F.when(F.col("y_pred") == "view", 1 - F.col("confidence")).otherwise(F.col("confidence")).alias("non_noise_confidence"),
        F.col("snr").cast("double").alias("snr_db"), F.col("value").alias("e2e_ms"), (F.col("value") / 3).alias("infer_ms"), "y_true",
    )


def agg20_event_summary(spark, sf):
    return rounded(met.event_summary(events_of(spark, sf), "condition"))


AGG20 = PRED + """, e AS (SELECT condition, y_pred, (y_pred <> 'view')::INT AS alert, CASE WHEN y_pred = 'view' THEN 1 - confidence ELSE confidence END AS c, snr, value FROM predictions),
k AS (SELECT condition, y_pred, count(*) AS n FROM e GROUP BY ALL), top AS (SELECT condition, string_agg(y_pred || ':' || n, ',' ORDER BY n DESC, y_pred) AS top_predictions FROM k GROUP BY 1)
SELECT condition, count(*) AS events, sum(alert)::BIGINT AS alerts, sum(1 - alert)::BIGINT AS no_alerts, round(100 * avg(alert), 6) + 0.0 AS alert_rate_pct, round(max(c), 6) + 0.0 AS max_non_noise_confidence,
round(avg(snr), 6) + 0.0 AS mean_snr_db, round(avg(value), 6) + 0.0 AS mean_e2e_ms, round(avg(value / 3), 6) + 0.0 AS mean_infer_ms, any_value(top_predictions) AS top_predictions FROM e JOIN top USING (condition) GROUP BY condition"""


def agg21_phase_card(spark, sf):
    rows = events_of(spark, sf).select(F.col("condition").alias("phase"), F.col("y_true").alias("expected"), "prediction", "alert")
    return met.phase_card(rows)


AGG21 = PRED + """ SELECT condition AS phase, count(*) AS reports, sum((y_true = y_pred)::INT)::BIGINT AS correct, sum((y_pred <> 'view')::INT)::BIGINT AS alerts, sum((y_pred = 'view')::INT)::BIGINT AS no_alerts,
sum((y_true = y_pred)::INT) = count(*) AS passed FROM predictions GROUP BY ROLLUP (condition)"""


def agg22_clip_summary(spark, sf):
    clips = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("drone"), (F.lit(2400) + F.col("o_custkey") % 5 * 10).cast("int").alias("center_mhz"), (F.col("o_custkey") % 3 * 5e7 + 5e7).alias("sample_rate_hz"),
        F.lit(1e8).alias("bandwidth_hz"), F.round(F.col("o_totalprice") / 1e4).alias("snr_db"),
    )
    out = cat.clip_summary(clips)
    return out.withColumn("centers", F.concat_ws(",", F.transform(F.map_entries("centers"), lambda e: F.concat_ws(":", e.key, e.value))))


AGG22 = """WITH c AS (SELECT o_orderpriority AS drone, (2400 + o_custkey % 5 * 10)::INT AS m, o_custkey % 3 * 5e7 + 5e7 AS r, round(o_totalprice / 1e4) AS s FROM orders), k AS (SELECT drone, m, count(*) AS n FROM c GROUP BY ALL),
t AS (SELECT drone, string_agg(m || ':' || n, ',' ORDER BY m) AS centers FROM k GROUP BY 1) SELECT drone, count(*) AS clips, min(r) AS min_sample_rate_hz, max(r) AS max_sample_rate_hz, 1e8::DOUBLE AS min_bandwidth_hz, 1e8::DOUBLE AS max_bandwidth_hz,
min(s) AS min_snr_db, max(s) AS max_snr_db, any_value(centers) AS centers FROM c JOIN t USING (drone) GROUP BY drone"""


def history(spark, sf):
    return predictions(spark, sf).groupBy(F.col("condition").alias("run_id"), ((F.col("snr") + 20) / 2 + 1).cast("int").alias("epoch")).agg(
        F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), 6).alias("val_accuracy"),
        F.round(F.avg("confidence"), 6).alias("c"),
    ).select("run_id", "epoch", "val_accuracy", F.when(F.col("epoch") % 4 > 0, F.col("c")).alias("val_macro_f1"))


HISTORY = PRED + """, h0 AS (SELECT condition AS run_id, ((snr + 20) // 2 + 1)::INT AS epoch, round(avg((y_true = y_pred)::INT), 6) AS val_accuracy, round(avg(confidence), 6) AS c FROM predictions GROUP BY ALL),
h AS (SELECT run_id, epoch, val_accuracy, CASE WHEN epoch % 4 > 0 THEN c END AS val_macro_f1 FROM h0)"""


def agg23_best_epoch(spark, sf):
    return met.best_epoch(history(spark, sf), "run_id")


AGG23 = HISTORY + ", b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(val_macro_f1, val_accuracy) DESC, epoch) AS k FROM h) SELECT run_id, max(epoch) AS last_epoch, max(val_accuracy) AS best_val_accuracy, max(epoch) FILTER (k = 1) AS best_epoch FROM b GROUP BY 1"


def win6_global_epochs(spark, sf):
    return met.global_epochs(history(spark, sf)).select("run_id", "epoch", "global_epoch")


WIN6 = HISTORY + ", l AS (SELECT run_id, max(epoch) AS n FROM h GROUP BY 1), s AS (SELECT run_id, coalesce(sum(n) OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l) SELECT run_id, epoch, (start + epoch)::BIGINT AS global_epoch FROM h JOIN s USING (run_id)"


def top5_last_runs(spark, sf):
    runs = history(spark, sf).groupBy("run_id").agg(F.max("epoch").alias("epochs"))
    return runs.orderBy(F.desc("run_id")).limit(10)


def agg29_event_counts(spark, sf):
    return met.event_counts(predictions(spark, sf))


AGG29 = PRED + ", p AS (SELECT y_pred AS label, count(*) AS predicted FROM predictions GROUP BY 1), t AS (SELECT y_true AS label, count(*) AS truth FROM predictions GROUP BY 1) SELECT coalesce(p.label, t.label) AS label, coalesce(predicted, 0) AS predicted, coalesce(truth, 0) AS truth FROM p FULL JOIN t USING (label)"


def indexed_caps(spark, sf):
    return light(spark, sf).withColumn("label_idx", F.col("target_raw"))


def smp1_fraction(spark, sf):
    return smp.stratified_fraction(indexed_caps(spark, sf), 0.25, SEED).select("capture_id", "label_idx")


RANKED = CAP + f", r AS (SELECT *, target_raw AS label_idx, row_number() OVER (PARTITION BY target_raw ORDER BY {KEY}, capture_id) AS rn, count(*) OVER (PARTITION BY target_raw) AS n FROM captures)"
SMP1 = RANKED + " SELECT capture_id, label_idx FROM r WHERE rn <= greatest(1, round_even(n * 0.25::DOUBLE, 0))"


def smp2_fraction_up(spark, sf):
    return smp.stratified_fraction(indexed_caps(spark, sf), 0.1, SEED, up=True).select("capture_id", "label_idx")


SMP2 = RANKED + " SELECT capture_id, label_idx FROM r WHERE rn <= ceil(n * 0.1::DOUBLE)"


def smp3_cap(spark, sf):
    return smp.capped(indexed_caps(spark, sf), 40, ["label_idx"], seed=SEED).select("capture_id", "label_idx")


def smp4_arrival_cap(spark, sf):
    return smp.capped(predictions(spark, sf).select("capture_id", "y_true"), 100, ["y_true"])


SMP4 = PRED + ", r AS (SELECT capture_id, y_true, row_number() OVER (PARTITION BY y_true ORDER BY capture_id) AS rn FROM predictions) SELECT capture_id, y_true FROM r WHERE rn <= 100"


def smp5_cell_cap(spark, sf):
    return smp.capped(predictions(spark, sf).select("capture_id", "y_true", "snr"), 5, ["y_true", "snr"])


SMP5 = PRED + ", r AS (SELECT capture_id, y_true, snr, row_number() OVER (PARTITION BY y_true, snr ORDER BY capture_id) AS rn FROM predictions) SELECT capture_id, y_true, snr FROM r WHERE rn <= 5"


def smp6_max_snr_sample(spark, sf):
    return smp.capped(cat.at_max_snr(predictions(spark, sf)).select("capture_id", "y_true"), 25, ["y_true"], seed=SEED)


SMP6 = PRED + f", r AS (SELECT capture_id, y_true, row_number() OVER (PARTITION BY y_true ORDER BY {KEY}, capture_id) AS rn FROM predictions WHERE snr = (SELECT max(snr) FROM predictions)) SELECT capture_id, y_true FROM r WHERE rn <= 25"


def smp7_stratified_split(spark, sf):
    return smp.stratified_split(indexed_caps(spark, sf), SEED).select("capture_id", "label_idx", "split")


def quota_sql(source: str, name: str, share: str, seed: int) -> str:
    return f"""{name}_n AS (SELECT label_idx, count(*) AS n, (SELECT count(*) FROM {source}) AS total FROM {source} GROUP BY 1),
{name}_w AS (SELECT *, ceil(total * {share}::DOUBLE) * n / total AS want FROM {name}_n), {name}_b AS (SELECT *, floor(want) AS base, row_number() OVER (ORDER BY round(want - floor(want), 9) DESC, label_idx) AS place FROM {name}_w),
{name}_q AS (SELECT label_idx, base + (place <= (SELECT any_value(ceil(total * {share}::DOUBLE)) - sum(base) FROM {name}_b))::INT AS quota FROM {name}_b),
{name} AS (SELECT s.capture_id, s.label_idx, row_number() OVER (PARTITION BY s.label_idx ORDER BY md5(concat_ws('|', '{seed}', s.capture_id)), s.capture_id) <= quota AS held FROM {source} s JOIN {name}_q USING (label_idx))"""


SMP7 = CAP + f""", base AS (SELECT capture_id, target_raw AS label_idx FROM captures), {quota_sql('base', 'h1', '0.2', SEED)}, rest AS (SELECT capture_id, label_idx FROM h1 WHERE NOT held), {quota_sql('rest', 'h2', '0.2', SEED + 1)}
SELECT capture_id, label_idx, 'test' AS split FROM h1 WHERE held UNION ALL SELECT capture_id, label_idx, CASE WHEN held THEN 'val' ELSE 'train' END FROM h2"""


def smp8_plain_split(spark, sf):
    return smp.plain_split(predictions(spark, sf), SEED).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("capture_id").alias("ids"))


SMP8 = PRED + f", s AS (SELECT capture_id, CASE WHEN row_number() OVER (ORDER BY {KEY}, capture_id) <= ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM predictions) SELECT split, count(*) AS n, sum(capture_id)::BIGINT AS ids FROM s GROUP BY 1"


def smp9_class_split(spark, sf):
    return smp.class_split(indexed_caps(spark, sf), SEED).select("capture_id", "label_idx", "split")


SMP9 = RANKED + """, q AS (SELECT *, greatest(1, round_even(n * 0.7::DOUBLE, 0)) AS a, greatest(1, round_even(n * 0.15::DOUBLE, 0)) AS b FROM r), s AS (SELECT *, CASE WHEN a + b >= n THEN greatest(1, n - 2) ELSE a END AS t, CASE WHEN a + b >= n THEN 1 ELSE b END AS v FROM q)
SELECT capture_id, label_idx, CASE WHEN n < 3 OR rn <= t THEN 'train' WHEN rn <= t + v THEN 'val' ELSE 'test' END AS split FROM s"""


def smp10_view_split(spark, sf):
    return smp.view_split(light(spark, sf).select("capture_id"), 3)


SMP10 = "SELECT vec_id AS capture_id, split, (base + k)::INT AS view_idx FROM embeddings, (VALUES ('train', 0), ('val', 100), ('test', 200)) s(split, base), range(3) t(k)"


def smp11_balanced_replay(spark, sf):
    return smp.balanced_replay(indexed_caps(spark, sf), SEED)


SMP11 = RANKED + f""", c AS (SELECT label_idx, count(*) AS n, max(count(*)) OVER () AS target FROM r GROUP BY 1), d AS (SELECT label_idx, n, target, unnest(range(target)) AS replay_idx FROM c),
e AS (SELECT *, CASE WHEN n < target THEN 1 + ('0x' || substr(md5(concat_ws('|', '{SEED}', label_idx, replay_idx)), 1, 8))::BIGINT % n ELSE replay_idx + 1 END AS rn FROM d)
SELECT e.label_idx, replay_idx::INT AS replay_idx, capture_id FROM e JOIN r ON r.label_idx = e.label_idx AND r.rn = e.rn"""


def smp12_balanced_down(spark, sf):
    return smp.balanced_down(indexed_caps(spark, sf), SEED).select("capture_id", "label_idx")


SMP12 = RANKED + " SELECT capture_id, label_idx FROM r WHERE rn <= (SELECT min(n) FROM r)"


def smp13_sweep_selection(spark, sf):
    return smp.sweep_selection(light(spark, sf), ["Noise", "class_1", "class_7"], 2, SEED, 11)


SMP13 = CAP + f""", r AS (SELECT capture_id, class_name, list_position(['Noise', 'class_1', 'class_7'], class_name) AS pos, row_number() OVER (PARTITION BY class_name ORDER BY {KEY}, capture_id) AS rn FROM captures WHERE class_name IN ('Noise', 'class_1', 'class_7')),
p AS (SELECT *, row_number() OVER (ORDER BY rn > 2, CASE WHEN rn > 2 THEN rn ELSE 0 END, pos, rn) - 1 AS place FROM r) SELECT place::INT AS place, class_name, capture_id FROM p WHERE place < 11"""


def top2_comparison(spark, sf):
    rows = met.classification_metrics(predictions(spark, sf), "condition").select(
        F.lit("events").alias("dataset"), F.col("condition").alias("model_name"), F.lit("eval").alias("eval_split"), F.round("accuracy", 6).cast("string").alias("acc"), F.round("macro_f1", 6).cast("string").alias("macro_f1"), F.lit("n/a").alias("weighted_f1"))
    return met.comparison_table(rows)


TOP2 = f"{PRED}, {f1_sql('condition')} SELECT 'events' AS dataset, condition AS model, '' AS family, 'eval' AS split, round(sum(tp) / sum(n), 6) + 0.0 AS accuracy, round(avg(f1), 6) + 0.0 AS macro_f1, NULL::DOUBLE AS weighted_f1, '' AS notes FROM c GROUP BY condition"


def set1_union_histories(spark, sf):
    new, old = history(spark, sf).drop("val_macro_f1"), history(spark, sf).drop("val_accuracy")
    return smp.union_all(old, new)


SET1 = HISTORY + " SELECT run_id, epoch, NULL::DOUBLE AS val_accuracy, val_macro_f1 FROM h UNION ALL SELECT run_id, epoch, val_accuracy, NULL FROM h"


def set2_distinct_files(spark, sf):
    return paths(spark, sf).select("path").dropDuplicates(["path"])


def set3_class_union(spark, sf):
    return predictions(spark, sf).select(F.col("y_true").alias("class_name")).union(light(spark, sf).select("class_name")).distinct()


def set4_missing(spark, sf):
    files = paths(spark, sf)
    return files.select("path").exceptAll(listing_of(files).select("path"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:3] in ("prj", "flt", "cln", "jn1", "jn2", "jn3", "jn4", "jn5", "agg", "smp", "win", "top", "set") and callable(f) and "_" in n}
ORACLES = {
    "prj1_parse_names": PRJ1, "prj2_rml_names": PRJ2, "prj3_infer_snr": PRJ3, "prj4_safe_labels": PRJ4, "prj5_label_index": PRJ5,
    "prj6_onehot": "SELECT vec_id, label AS class_idx FROM embeddings", "flt1_snr_slices": FLT1,
    "flt2_max_snr": PRED + " SELECT capture_id, y_true, snr FROM predictions WHERE snr = (SELECT max(snr) FROM predictions)", "flt3_top_levels": FLT3,
    "flt4_iq_files": f"WITH {PATHS} SELECT label, count(*) AS n FROM paths WHERE path LIKE '%.iq' GROUP BY 1", "flt5_high_snr_metrics": FLT5, "cln_strict_numbers": CLN,
    "jn1_named_classes": "SELECT label AS class_int, vec_id, CASE WHEN label < 7 THEN 'class ' || label ELSE 'target_' || label END AS class_name FROM embeddings",
    "jn2_repaired_manifest": JN2, "jn3_remapped_classes": JN3, "jn4_global_labels": JN4, "jn5_missing_artifacts": JN5, "agg1_dataset_counts": AGG1, "agg3_label_conflicts": AGG3,
    "agg5_metrics": AGG5, "agg5_skewed_metrics": AGG5B, "agg6_report": AGG6, "agg7_confusion": AGG7, "agg8_class_accuracy": AGG8, "agg9_snr_accuracy": AGG9, "agg10_class_snr_grid": AGG10,
    "agg11_peaks": AGG11, "agg12_peak_overall": AGG12, "agg13_order_calibration": AGG13, "agg16_class_weights": AGG16, "agg20_event_summary": AGG20, "agg21_phase_card": AGG21,
    "agg22_clip_summary": AGG22, "agg23_best_epoch": AGG23, "agg29_event_counts": AGG29, "win6_global_epochs": WIN6,
    "smp1_fraction": SMP1, "smp2_fraction_up": SMP2, "smp3_cap": RANKED + " SELECT capture_id, label_idx FROM r WHERE rn <= 40", "smp4_arrival_cap": SMP4, "smp5_cell_cap": SMP5, "smp6_max_snr_sample": SMP6,
    "smp7_stratified_split": SMP7, "smp8_plain_split": SMP8, "smp9_class_split": SMP9, "smp10_view_split": SMP10, "smp11_balanced_replay": SMP11, "smp12_balanced_down": SMP12, "smp13_sweep_selection": SMP13,
    "top2_comparison": TOP2, "top5_last_runs": HISTORY + " SELECT run_id, max(epoch) AS epochs FROM h GROUP BY 1 ORDER BY run_id DESC LIMIT 10", "set1_union_histories": SET1,
    "set2_distinct_files": f"WITH {PATHS} SELECT DISTINCT path FROM paths", "set3_class_union": with_tables("predictions", "captures") + " SELECT y_true AS class_name FROM predictions UNION SELECT class_name FROM captures",
    "set4_missing": f"WITH {PATHS} SELECT path FROM paths EXCEPT ALL SELECT CASE WHEN doc_id % 2 = 0 THEN path ELSE 'files/' || path END FROM paths",
}
