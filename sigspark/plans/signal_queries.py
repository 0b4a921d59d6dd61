"""Registered queries on windows, time-domain features, scores and decisions, with their SQL for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions.arrays import mean_of
from ..operators import scoring as sc
from ..operators import windows as win
from .catalogue_queries import light, rounded
from .tables import TYPES, captures, chunks, predictions, r6, table, with_tables

IQ = with_tables("iq")
CAPIQ = with_tables("captures", "iq")
PRED, CHUNKS = with_tables("predictions"), with_tables("chunks")
LABELS10 = [f"class_{k}" if k != 4 else "Noise" for k in range(10)]


def long(df, *keys):
    """One row per sample of the column iq."""
    rows = df.select(*keys, F.posexplode("iq").alias("n", "s"))
    return rows.select(*keys, "n", *[r6(F.col(f"s.{c}")).alias(c) for c in ("i", "q")])


def arr2_zero_padding(spark, sf):
    return long(captures(spark, sf).withColumn("iq", win.zero_padded(F.col("iq"), 40)), "capture_id")


def arr3_normalised(spark, sf):
    return long(win.normalised(captures(spark, sf).select("capture_id", "iq")), "capture_id")


ARR3 = IQ + """, m AS (SELECT *, i - avg(i) OVER (PARTITION BY capture_id) AS ci, q - avg(q) OVER (PARTITION BY capture_id) AS cq FROM iq), s AS (SELECT *, sqrt(avg((ci * ci + cq * cq) / 2) OVER (PARTITION BY capture_id) + 1e-8) AS d FROM m)
SELECT capture_id, n, round(ci / d, 6) + 0.0 AS i, round(cq / d, 6) + 0.0 AS q FROM s"""


def arr4_max_abs(spark, sf):
    return long(captures(spark, sf).withColumn("iq", win.max_abs_normalised(F.col("iq"))), "capture_id")


ARR4 = IQ + ", m AS (SELECT *, max(greatest(abs(i), abs(q))) OVER (PARTITION BY capture_id) + 1e-12 AS d FROM iq) SELECT capture_id, n, round(i / d, 6) + 0.0 AS i, round(q / d, 6) + 0.0 AS q FROM m"


def arr4_per_channel(spark, sf):
    return long(captures(spark, sf).withColumn("iq", win.channel_normalised(F.col("iq"))), "capture_id")


ARR4B = IQ + ", m AS (SELECT *, max(abs(i)) OVER (PARTITION BY capture_id) AS di, max(abs(q)) OVER (PARTITION BY capture_id) AS dq FROM iq) SELECT capture_id, n, round(i / di, 6) + 0.0 AS i, round(q / dq, 6) + 0.0 AS q FROM m"


def arr5_rms_clipped(spark, sf):
    return long(captures(spark, sf).withColumn("iq", win.rms_clipped(F.col("iq"), 48, 1.5)), "capture_id")


ARR5 = IQ + """, t AS (SELECT capture_id, k::INT AS n, i, q FROM range(48) r(k), iq WHERE iq.n = k % 32), m AS (SELECT *, i - avg(i) OVER (PARTITION BY capture_id) AS ci, q - avg(q) OVER (PARTITION BY capture_id) AS cq FROM t),
s AS (SELECT *, sqrt(avg(ci * ci + cq * cq) OVER (PARTITION BY capture_id) + 1e-12) AS d FROM m) SELECT capture_id, n, round(greatest(-1.5::DOUBLE, least(1.5::DOUBLE, ci / d)), 6) + 0.0 AS i, round(greatest(-1.5::DOUBLE, least(1.5::DOUBLE, cq / d)), 6) + 0.0 AS q FROM s"""


def arr6_snr_channel(spark, sf):
    rows = captures(spark, sf).withColumn("iq", win.with_snr(F.col("iq"), F.col("snr")))
    return rows.select("capture_id", F.posexplode("iq").alias("n", "s")).select("capture_id", "n", r6(F.col("s.i")).alias("i"), r6(F.col("s.c")).alias("c"))


def arr7_envelope_channel(spark, sf):
    rows = captures(spark, sf).withColumn("iq", win.with_envelope(F.col("iq")))
    return rows.select("capture_id", F.posexplode("iq").alias("n", "s")).select("capture_id", "n", r6(F.col("s.c")).alias("c"))


def arr8_candidate_starts(spark, sf):
    n = (F.col("user_id") % 90).cast("int")
    return table(spark, sf, "events").select("event_id", n.alias("n"), F.explode(win.candidate_starts(n, 16, 7)).alias("start"))


ARR8 = "WITH e AS (SELECT event_id, (user_id % 90)::INT AS n FROM events) SELECT DISTINCT event_id, n, start::INT AS start FROM e, (SELECT unnest(CASE WHEN n > 16 THEN list_concat(range(0, n - 15, 7), [n - 16]) ELSE [0] END) AS start)"


def arr9_starts_around(spark, sf):
    n, at = (F.col("user_id") % 90 + 10).cast("int"), (F.col("event_id") % 70).cast("int")
    return table(spark, sf, "events").select("event_id", F.explode(win.starts_around(at, n, 16, 5)).alias("start"))


ARR9 = "SELECT DISTINCT event_id, greatest(0, least(greatest(0, (user_id % 90 + 10 - 16)), trunc(event_id % 70 + (k - 2) * 2)))::INT AS start FROM events, range(5) t(k)"


def arr11_frames(spark, sf):
    rows = captures(spark, sf).select("capture_id", "iq", F.explode(win.frame_starts(F.size("iq"), 8, 5)).alias("start"))
    rows = rows.withColumn("iq", win.cut(F.col("iq"), F.col("start"), 8))
    return rows.select("capture_id", "start", r6(win.mean_square(F.col("iq"))).alias("power"))


ARR11 = IQ + " SELECT capture_id, start::INT AS start, round(avg((i * i + q * q) / 2), 6) + 0.0 AS power FROM iq, range(0, 25, 5) t(start) WHERE n >= start AND n < start + 8 GROUP BY ALL"


def jn6_window_samples(spark, sf):
    starts = F.array(F.lit(0), (F.col("capture_id") % 17).cast("int"))
    rows = win.window_samples(captures(spark, sf), starts, 12).select("capture_id", "view_idx", F.posexplode("iq").alias("n", "s"))
    return rows.select("capture_id", "view_idx", "n", r6(F.col("s.i")).alias("i"))


JN6 = IQ + ", w AS (SELECT DISTINCT capture_id, v::INT AS view_idx, (CASE WHEN v = 0 THEN 0 ELSE capture_id % 17 END)::INT AS start FROM iq, range(2) t(v)) SELECT capture_id, view_idx, n - start AS n, round(i, 6) + 0.0 AS i FROM iq JOIN w USING (capture_id) WHERE n >= start AND n < start + 12"


def arr18_rotated_views(spark, sf):
    return long(win.rotated_views(captures(spark, sf).select("capture_id", "iq"), 3), "capture_id", "view_idx")


ARR18 = IQ + f", v AS (SELECT *, k::INT AS view_idx, cos(k * {2 * math.pi / 3}) AS c, sin(k * {2 * math.pi / 3}) AS s FROM iq, range(3) t(k)) SELECT capture_id, view_idx, n, round(i * c - q * s, 6) + 0.0 AS i, round(i * s + q * c, 6) + 0.0 AS q FROM v"


def arr21_replay_ready(spark, sf):
    return long(captures(spark, sf).withColumn("iq", win.replay_ready(F.col("iq"), 50, 0.8, 4)), "capture_id")


ARR21 = IQ + """, m AS (SELECT *, i - avg(i) OVER (PARTITION BY capture_id) AS ci, q - avg(q) OVER (PARTITION BY capture_id) AS cq FROM iq), s AS (SELECT *, max(sqrt(ci * ci + cq * cq)) OVER (PARTITION BY capture_id) + 1e-12 AS d FROM m),
u AS (SELECT capture_id, n + 4 AS p, ci / d * 0.8 AS i, cq / d * 0.8 AS q FROM s UNION ALL SELECT capture_id, unnest([0, 1, 2, 3, 36, 37, 38, 39]), 0, 0 FROM (SELECT DISTINCT capture_id FROM iq))
SELECT capture_id, k::INT AS n, round(i, 6) + 0.0 AS i, round(q, 6) + 0.0 AS q FROM u, range(50) t(k) WHERE p = k % 40"""


def arr22_three_tap(spark, sf):
    return long(captures(spark, sf).withColumn("iq", win.three_tap(F.col("iq"), 2)), "capture_id")


ARR22 = IQ + """, w AS (SELECT capture_id, n, sum(i) OVER x / 3 AS i, sum(q) OVER x / 3 AS q FROM iq WINDOW x AS (PARTITION BY capture_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT capture_id, n, round(sum(i) OVER x / 3, 6) + 0.0 AS i, round(sum(q) OVER x / 3, 6) + 0.0 AS q FROM w WINDOW x AS (PARTITION BY capture_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""


def arr23_cubic(spark, sf):
    return long(captures(spark, sf).withColumn("iq", win.powered(F.col("iq"), "cubic")), "capture_id")


ARR23 = IQ + " SELECT capture_id, n, round(i ** 3 - 3 * i * q * q, 6) + 0.0 AS i, round(3 * i * i * q - q ** 3, 6) + 0.0 AS q FROM iq"


def arr24_seeded_starts(spark, sf):
    caps = light(spark, sf).withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return caps.select("capture_id", "view", win.seeded_start(F.col("filepath"), F.col("view"), 7, F.lit(32), 10, F.lit(5)).alias("start"))


ARR24 = with_tables("captures") + " SELECT capture_id, v::INT AS view, (CASE WHEN v = 0 THEN 5 ELSE ('0x' || substr(sha1(concat_ws('|', filepath, v::VARCHAR, '7')), 1, 8))::BIGINT % 23 END)::INT AS start FROM captures, range(3) t(v)"


def win2_burst_starts(spark, sf):
    return ft.burst_starts(captures(spark, sf), 12, 3)


WIN2 = IQ + """, p AS (SELECT capture_id, n, sum((i * i + q * q) / 2) OVER (PARTITION BY capture_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s FROM iq), b AS (SELECT capture_id, n, row_number() OVER (PARTITION BY capture_id ORDER BY s DESC, n) AS k FROM p)
SELECT capture_id, greatest(0, least(n - 6, 20))::INT AS start FROM b WHERE k = 1"""


def win3_active_windows(spark, sf):
    return ft.burst_starts(captures(spark, sf), 12, 4, total=True)


WIN3 = WIN2.replace("(i * i + q * q) / 2", "i * i + q * q").replace("1 PRECEDING AND 1 FOLLOWING) / 3", "2 PRECEDING AND 1 FOLLOWING) / 4")


def win4_differences(spark, sf):
    rows = captures(spark, sf).select("capture_id", win.differences(F.transform("iq", lambda s: s.i)).alias("d1")).withColumn("d2", win.differences(F.col("d1")))
    return rows.select("capture_id", *[r6(mean_of(F.transform(d, F.abs))).alias(f"mean_{d}") for d in ("d1", "d2")])


WIN4 = IQ + ", d AS (SELECT *, i - lag(i) OVER (PARTITION BY capture_id ORDER BY n) AS d1 FROM iq), e AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY capture_id ORDER BY n) AS d2 FROM d) SELECT capture_id, round(avg(abs(d1)), 6) + 0.0 AS mean_d1, round(avg(abs(d2)), 6) + 0.0 AS mean_d2 FROM e GROUP BY 1"


def win5_unwrapped_phase(spark, sf):
    rows = ft.unwrapped_rows(captures(spark, sf)).select("capture_id", F.posexplode("unwrapped").alias("n", "unwrapped"))
    return rows.select("capture_id", "n", r6(F.col("unwrapped")).alias("unwrapped"))


TAU = repr(2 * math.pi)
UNWRAP = f""", ph AS (SELECT capture_id, n, atan2(q, i) AS phase FROM iq), st AS (SELECT *, phase - lag(phase) OVER (PARTITION BY capture_id ORDER BY n) AS step FROM ph),
un AS (SELECT capture_id, n, phase, phase + {TAU} * sum(CASE WHEN step >= pi() THEN -1 WHEN step <= -pi() THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY n) AS u FROM st)"""
WIN5 = IQ + UNWRAP + " SELECT capture_id, n, round(u, 6) + 0.0 AS unwrapped FROM un"


def agg25_noise_floor(spark, sf):
    return rounded(sc.noise_floor(chunks(spark, sf)))


AGG25 = CHUNKS + " SELECT stream_id, round(median(power_db), 6) + 0.0 AS floor FROM chunks WHERE seq < 20 GROUP BY 1"


def agg26_capture_stats(spark, sf):
    louder = F.transform("iq", lambda s: F.struct((s.i * 4).alias("i"), (s.q * 4).alias("q")))
    return rounded(win.capture_stats(captures(spark, sf).withColumn("iq", louder)))


AGG26 = IQ + """, s AS (SELECT capture_id, 4 * i AS i, 4 * q AS q FROM iq), a AS (SELECT capture_id, 10 * log10(avg(i * i + q * q) + 1e-12) AS power_db, max(sqrt(i * i + q * q)) AS peak, 100 * avg((abs(i) >= 0.99)::INT) AS i_clip_pct, 100 * avg((abs(q) >= 0.99)::INT) AS q_clip_pct,
100 * avg((sqrt(i * i + q * q) >= 1.0)::INT) AS fullscale_pct FROM s GROUP BY 1) SELECT capture_id, round(power_db, 6) + 0.0 AS power_db, round(peak, 6) + 0.0 AS peak, round(i_clip_pct, 6) + 0.0 AS i_clip_pct, round(q_clip_pct, 6) + 0.0 AS q_clip_pct, round(fullscale_pct, 6) + 0.0 AS fullscale_pct,
i_clip_pct > 0.1 OR q_clip_pct > 0.1 OR fullscale_pct > 0.5 AS warning FROM a"""
UNIT = """unit AS (SELECT vec_id, label, k::INT AS pos, embedding[k + 1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12) AS v FROM embeddings, range(64) t(k)),
mean AS (SELECT label, pos, avg(v) AS v FROM unit GROUP BY ALL), proto AS (SELECT label, pos, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS v FROM mean)"""
LOGITS = f"WITH {UNIT}, logits AS (SELECT u.vec_id, any_value(u.label) AS y_true, p.label, sum(u.v * p.v) / 0.1::DOUBLE AS logit FROM unit u JOIN proto p USING (pos) GROUP BY u.vec_id, p.label), powers AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM logits), probs AS (SELECT vec_id, y_true, label, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM powers)"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("capture_id"), "label", "embedding")


def probs_of(spark, sf):
    """capture_id, y_true, snr, probs by nearest prototypes."""
    v = vectors(spark, sf)
    rows = sc.prototype_logits(v, sc.prototypes(v))
    snr = (F.pmod("capture_id", F.lit(20)) * 2 - 20).cast("int")
    return rows.select("capture_id", F.col("label").alias("y_true"), snr.alias("snr"), sc.softmax(F.col("logits")).alias("probs"))


def agg27_prototypes(spark, sf):
    return sc.prototypes(vectors(spark, sf)).select("label", F.posexplode("prototype").alias("pos", "v")).select("label", "pos", r6(F.col("v")).alias("v"))


def jn9_logits(spark, sf):
    v = vectors(spark, sf)
    rows = sc.prototype_logits(v, sc.prototypes(v)).select("capture_id", F.posexplode("logits").alias("label", "logit"))
    return rows.select("capture_id", "label", r6(F.col("logit")).alias("logit"))


def dec9_nearest_prototype(spark, sf):
    rows = probs_of(spark, sf)
    return rows.select("capture_id", "y_true", sc.argmax(F.transform("probs", lambda p: F.round(p, 9))).alias("y_pred"), r6(F.array_max("probs")).alias("confidence"))


DEC9 = LOGITS + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 9) DESC, label) AS k FROM probs) SELECT vec_id AS capture_id, y_true, label AS y_pred, round(p, 6) + 0.0 AS confidence FROM r WHERE k = 1"


def entry_accuracy_by_snr(spark, sf):
    """Captures to prototypes to predictions to accuracy by ratio: the flagship."""
    from ..operators.metrics import accuracy

    rows = probs_of(spark, sf).select("snr", "y_true", sc.argmax(F.transform("probs", lambda p: F.round(p, 9))).alias("y_pred"))
    return rounded(accuracy(rows, "snr", percent=True))


ENTRY = LOGITS + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 9) DESC, label) AS k FROM probs) SELECT (vec_id % 20 * 2 - 20)::INT AS snr, round(100 * avg((y_true = label)::INT), 6) + 0.0 AS accuracy, count(*) AS samples FROM r WHERE k = 1 GROUP BY 1"


def dec3_non_noise(spark, sf):
    rows = probs_of(spark, sf).withColumn("probs", F.transform("probs", lambda p: F.round(p, 9)))
    out = sc.decided(rows, LABELS10)
    return out.select("capture_id", "prediction", "best_non_noise", *[r6(F.col(c)).alias(c) for c in ("confidence", "non_noise_mass", "non_noise_confidence")])


NAMED = LOGITS + ", named AS (SELECT vec_id, label, CASE WHEN label = 4 THEN 'Noise' ELSE 'class_' || label END AS name, round(p, 9) AS p FROM probs)"
DEC3 = NAMED + """, o AS (SELECT vec_id, sum(p) AS mass FROM named WHERE label <> 4 GROUP BY 1), a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS k FROM named), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS k FROM named WHERE label <> 4)
SELECT a.vec_id AS capture_id, a.name AS prediction, b.name AS best_non_noise, round(a.p, 6) + 0.0 AS confidence, round(mass, 6) + 0.0 AS non_noise_mass, round(b.p / mass, 6) + 0.0 AS non_noise_confidence FROM a JOIN b USING (vec_id) JOIN o USING (vec_id) WHERE a.k = 1 AND b.k = 1"""


def dec5_hybrid(spark, sf):
    rows = predictions(spark, sf)
    follows = F.col("y_true")
    final = sc.hybrid_decision(F.when(F.col("y_pred") == "view", "Noise").otherwise(F.col("y_pred")), F.col("value") > 20, follows, F.col("confidence"), F.lit("click"), F.col("confidence") / 2)
    return rows.select("capture_id", final.alias("decision"))


DEC5 = PRED + " SELECT capture_id, CASE WHEN y_pred = 'view' THEN CASE WHEN value > 20 THEN CASE WHEN confidence / 2 >= 0.55 THEN 'click' WHEN confidence >= 0.55 THEN y_true ELSE 'Noise' END ELSE 'Noise' END ELSE y_pred END AS decision FROM predictions"


def dec6_best_windows(spark, sf):
    rows = predictions(spark, sf).select(F.col("stream_id").alias("capture_id"), F.col("capture_id").alias("start"), "y_pred", "confidence")
    return sc.best_windows(rows, F.col("confidence"), "y_pred")


DEC6 = PRED + ", r AS (SELECT stream_id, capture_id, y_pred, row_number() OVER (PARTITION BY stream_id ORDER BY confidence DESC, capture_id) AS k FROM predictions) SELECT stream_id AS capture_id, capture_id AS start, y_pred FROM r WHERE k = 1"


def dec7_signal_present(spark, sf):
    rows = chunks(spark, sf)
    floor = sc.noise_floor(rows)
    return rows.join(floor, "stream_id").select("stream_id", "seq", sc.signal_present(F.col("power_db"), F.col("floor")).alias("present"))


DEC7 = CHUNKS + ", f AS (SELECT stream_id, median(power_db) AS floor FROM chunks WHERE seq < 20 GROUP BY 1) SELECT stream_id, seq, power_db >= floor + 4.0 AS present FROM chunks JOIN f USING (stream_id)"


def shift_of(rows):
    return sc.prior_shift(rows.select("capture_id", "probs"), rows.select("capture_id", F.col("y_true").alias("class_idx")))


def agg14_prior_shift(spark, sf):
    return rounded(shift_of(probs_of(spark, sf)))


SHIFT = ", pm AS (SELECT label, avg(p) AS p FROM probs GROUP BY 1), tm AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), sh AS (SELECT label, ln(coalesce(n, 0) / sum(coalesce(n, 0)) OVER () + 1e-6) - ln(p / sum(p) OVER () + 1e-6) AS s FROM pm LEFT JOIN tm USING (label))"


def dec8_calibrated(spark, sf):
    rows = probs_of(spark, sf)
    shift = shift_of(rows).agg(F.transform(F.array_sort(F.collect_list(F.struct("class_idx", "shift"))), lambda s: s.shift).alias("shifts"))
    out = rows.crossJoin(F.broadcast(shift)).withColumn("p", sc.calibrated(F.col("probs"), F.col("shifts"), F.lit(0.5), F.lit(2.0)))
    return out.select("capture_id", F.posexplode("p").alias("label", "p")).select("capture_id", "label", r6(F.col("p")).alias("p"))


DEC8 = LOGITS + SHIFT + ", l AS (SELECT vec_id, label, ln(greatest(p, 1e-8)) / 2 + 0.5 * s AS x FROM probs JOIN sh USING (label)), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS y FROM l) SELECT vec_id AS capture_id, label, round(y / sum(y) OVER (PARTITION BY vec_id), 6) + 0.0 AS p FROM e"
ALPHAS, TEMPERATURES = [0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5], [0.7, 1.0, 1.5, 2.0]


def agg15_calibration_sweep(spark, sf):
    rows = probs_of(spark, sf)
    return rounded(sc.calibration_sweep(rows, shift_of(rows), ALPHAS, TEMPERATURES), "alpha", "temperature").drop("weighted_f1")


AGG15 = LOGITS + SHIFT + f""", g AS (SELECT a::DOUBLE AS alpha, t::DOUBLE AS temperature FROM (SELECT unnest({ALPHAS}) AS a), (SELECT unnest({TEMPERATURES}) AS t)), l AS (SELECT alpha, temperature, vec_id, y_true, label, round(ln(greatest(p, 1e-8)) / temperature + alpha * s, 9) AS x FROM probs JOIN sh USING (label), g),
predictions AS (SELECT alpha, temperature, y_true, label AS y_pred FROM (SELECT *, row_number() OVER (PARTITION BY alpha, temperature, vec_id ORDER BY x DESC, label) AS k FROM l) WHERE k = 1),
k AS (SELECT alpha, temperature, count(DISTINCT y_pred) AS classes FROM predictions GROUP BY ALL),
t AS (SELECT alpha, temperature, y_true AS label, count(*) AS n, sum((y_true = y_pred)::INT) AS tp FROM predictions GROUP BY ALL), p AS (SELECT alpha, temperature, y_pred AS label, count(*) AS m FROM predictions GROUP BY ALL),
c AS (SELECT alpha, temperature, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp, 2.0 * coalesce(tp, 0) / (coalesce(n, 0) + coalesce(m, 0)) AS f1 FROM t FULL JOIN p USING (alpha, temperature, label)),
o AS (SELECT alpha, temperature, sum(tp) / sum(n) AS accuracy, avg(f1) AS macro_f1 FROM c GROUP BY ALL)
SELECT alpha, temperature, round(accuracy, 6) + 0.0 AS accuracy, round(macro_f1, 6) + 0.0 AS macro_f1, classes, row_number() OVER (ORDER BY round(macro_f1, 9) DESC, round(accuracy, 9) DESC, classes DESC, alpha, temperature) = 1 AS is_best FROM o JOIN k USING (alpha, temperature)"""


def agg17_mean_probs(spark, sf):
    rows = probs_of(spark, sf).withColumn("capture_id", F.floor(F.col("capture_id") / 3))
    return sc.mean_probs(rows).select("capture_id", F.posexplode("probs").alias("label", "p")).select("capture_id", "label", r6(F.col("p")).alias("p"))


AGG17 = LOGITS + " SELECT vec_id // 3 AS capture_id, label, round(avg(p), 6) + 0.0 AS p FROM probs GROUP BY vec_id // 3, label"


def agg18_ensemble(spark, sf):
    rows = probs_of(spark, sf).select("capture_id", F.posexplode("probs").alias("k", "p"))
    scores = rows.select("capture_id", F.when(F.col("k") < 6, "a").otherwise("b").alias("model"), F.concat(F.when(F.col("k") < 6, "a:").otherwise("b:"), "k").alias("label"), F.round("p", 9).alias("score"))
    return rounded(sc.ensemble(scores, 2))


AGG18 = LOGITS + ", s AS (SELECT vec_id, CASE WHEN label < 6 THEN 'a:' ELSE 'b:' END || label AS name, round(p, 9) / 2 AS score FROM probs), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, name) AS k FROM s) SELECT vec_id AS capture_id, name AS label, round(score, 6) + 0.0 AS score FROM r WHERE k = 1"


def agg30_generated_audit(spark, sf):
    rows = predictions(spark, sf).select(F.col("y_true").alias("requested"), F.col("y_pred").alias("predicted"), "confidence")
    return rounded(sc.generated_audit(rows))


AGG30 = PRED + " SELECT y_true AS requested, round(avg((y_true = y_pred)::INT), 6) + 0.0 AS accuracy, round(avg(confidence), 6) + 0.0 AS mean_confidence, count(*) AS n FROM predictions GROUP BY 1"


def agg30_audit_matrix(spark, sf):
    rows = predictions(spark, sf).select(F.col("y_true").alias("requested"), F.col("y_pred").alias("predicted"))
    return rounded(sc.audit_matrix(rows, list(TYPES)))


AGG30M = PRED + ", t AS (SELECT DISTINCT y_true AS c FROM predictions), m AS (SELECT a.c AS requested, b.c AS predicted, (SELECT count(*) FROM predictions p WHERE p.y_true = a.c AND p.y_pred = b.c) AS n FROM t a, t b) SELECT requested, predicted, n, round(n / sum(n) OVER (PARTITION BY requested), 6) + 0.0 AS share FROM m"


def top1_top_classes(spark, sf):
    rows = probs_of(spark, sf).withColumn("probs", F.transform("probs", lambda p: F.round(p, 9)))
    out = rows.select("capture_id", F.posexplode(sc.top_k(F.col("probs"), LABELS10, 3)).alias("place", "t"))
    return out.select("capture_id", "place", "t.label")


TOP1 = NAMED + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) - 1 AS place FROM named) SELECT vec_id AS capture_id, place::INT AS place, name AS label FROM r WHERE place < 3"


def top3_scan_log(spark, sf):
    rows = predictions(spark, sf)
    order = Window.partitionBy("stream_id").orderBy(F.desc("confidence"), "capture_id")
    return rows.withColumn("place", F.row_number().over(order)).filter("place <= 12").select("stream_id", "place", "capture_id")


def trial_lines(spark, sf):
    """Log lines of trials: one trial per event."""
    p = predictions(spark, sf)
    head = F.concat(F.lit("Capture power "), F.format_string("%.2f", F.col("value") - 50), F.lit(" dB, peak 0.5, I clip 0.10%, Q clip 0.20%, |IQ|>=1 0.00%"))
    lines = F.array(
        F.concat(F.lit("TX sample: "), "y_true", F.lit(" x")), head, F.concat(F.lit("best_non_noise="), "y_true", F.lit(" non_noise_confidence="), F.format_string("%.3f", F.col("confidence"))),
        F.concat(F.lit("target_class="), "y_true", F.lit(" target_non_noise_confidence="), F.when(F.col("snr") > 0, F.format_string("%.2f", F.col("confidence"))).otherwise("bad")),
        F.concat(F.lit("RF prediction="), "y_pred", F.lit(" confidence=0.100 top=a:b")), F.concat(F.lit("RF prediction="), "y_pred", F.lit(" confidence="), F.format_string("%.3f", F.col("confidence")), F.lit(" top="), "y_pred"),
        F.concat(F.lit("decision="), "y_pred"),
    )
    return p.select(F.col("capture_id").alias("trial"), F.posexplode(lines).alias("line_no", "line"))


def dec11_parsed_trials(spark, sf):
    return sc.parsed_trials(trial_lines(spark, sf)).select("trial", "tx_sample", "capture_power_db", "target_class", "target_non_noise_confidence", "best_non_noise_confidence", "prediction", "confidence", "top", "decision", "tx_file_prediction")


DEC11 = PRED + " SELECT capture_id AS trial, y_true || ' x' AS tx_sample, printf('%.2f', value - 50) AS capture_power_db, CASE WHEN snr > 0 THEN y_true END AS target_class, CASE WHEN snr > 0 THEN printf('%.2f', confidence) END AS target_non_noise_confidence, printf('%.3f', confidence) AS best_non_noise_confidence, y_pred AS prediction, printf('%.3f', confidence) AS confidence, y_pred AS top, 'decision=' || y_pred AS decision, NULL::VARCHAR AS tx_file_prediction FROM predictions"


def agg19_sweep_summary(spark, sf):
    from ..operators.metrics import sweep_summary

    trials = sc.parsed_trials(trial_lines(spark, sf)).withColumn("passed", F.when(F.col("prediction") == F.col("target_class"), "1").otherwise("0"))
    return rounded(sweep_summary(trials))


AGG19 = PRED + """ SELECT CASE WHEN snr > 0 THEN y_true ELSE '?' END AS class, count(*) AS total, sum((snr > 0 AND y_true = y_pred)::INT)::BIGINT AS passed, round(avg((snr > 0 AND y_true = y_pred)::INT), 6) + 0.0 AS accuracy,
round(min(CASE WHEN snr > 0 THEN round(confidence, 2) END), 6) + 0.0 AS min_target_confidence, round(avg(CASE WHEN snr > 0 THEN round(confidence, 2) END), 6) + 0.0 AS mean_target_confidence, round(avg(printf('%.2f', value - 50)::DOUBLE), 6) + 0.0 AS mean_capture_power_db, 0.0::DOUBLE AS max_fullscale_pct FROM predictions GROUP BY 1"""


def dec12_parity(spark, sf):
    from ..operators.metrics import parity

    a = probs_of(spark, sf).select("capture_id", F.transform("probs", lambda p: F.round(p, 9)).alias("probs"))
    b = a.withColumn("probs", F.transform("probs", lambda p: F.round(p, 3)))
    return rounded(parity(a, b, 1e-3, 1e-3))


DEC12 = LOGITS + """, x AS (SELECT vec_id, label, round(p, 9) AS a, round(round(p, 9), 3) AS b FROM probs), ta AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, label) AS k FROM x), tb AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY b DESC, label) AS k FROM x)
SELECT (SELECT count(DISTINCT vec_id) FROM x) AS n, (SELECT round(avg((ta.label = tb.label)::INT), 6) + 0.0 FROM ta JOIN tb USING (vec_id) WHERE ta.k = 1 AND tb.k = 1) AS top1_agreement, round(max(abs(a - b)), 6) + 0.0 AS max_abs_error, round(avg(abs(a - b)), 6) + 0.0 AS mean_abs_error, bool_and(abs(a - b) <= 1e-3 + 1e-3 * abs(b)) AS all_close FROM x"""

QUERIES = {n: f for n, f in list(globals().items()) if n.split("_")[0].rstrip("0123456789") in ("arr", "jn", "win", "agg", "dec", "top", "entry") and callable(f) and getattr(f, "__module__", "") == __name__}
ORACLES = {
    "arr2_zero_padding": IQ + " SELECT capture_id, n, round(i, 6) + 0.0 AS i, round(q, 6) + 0.0 AS q FROM iq UNION ALL SELECT capture_id, k::INT, 0, 0 FROM (SELECT DISTINCT capture_id FROM iq), range(32, 40) t(k)",
    "arr3_normalised": ARR3, "arr4_max_abs": ARR4, "arr4_per_channel": ARR4B, "arr5_rms_clipped": ARR5,
    "arr6_snr_channel": IQ + " SELECT capture_id, n, round(i, 6) + 0.0 AS i, round((capture_id % 20 * 2 - 20) / 20.0, 6)::DOUBLE + 0.0 AS c FROM iq", "arr7_envelope_channel": IQ + " SELECT capture_id, n, round(sqrt(i * i + q * q), 6) + 0.0 AS c FROM iq",
    "arr8_candidate_starts": ARR8, "arr9_starts_around": ARR9, "arr11_frames": ARR11, "jn6_window_samples": JN6, "arr18_rotated_views": ARR18, "arr21_replay_ready": ARR21, "arr22_three_tap": ARR22, "arr23_cubic": ARR23, "arr24_seeded_starts": ARR24,
    "win2_burst_starts": WIN2, "win3_active_windows": WIN3, "win4_differences": WIN4, "win5_unwrapped_phase": WIN5, "agg25_noise_floor": AGG25, "agg26_capture_stats": AGG26,
    "agg27_prototypes": f"WITH {UNIT} SELECT label, pos, round(v, 6) + 0.0 AS v FROM proto", "jn9_logits": LOGITS + " SELECT vec_id AS capture_id, label, round(logit, 6) + 0.0 AS logit FROM logits", "dec9_nearest_prototype": DEC9, "entry_accuracy_by_snr": ENTRY,
    "dec3_non_noise": DEC3, "dec5_hybrid": DEC5, "dec6_best_windows": DEC6, "dec7_signal_present": DEC7, "agg14_prior_shift": LOGITS + SHIFT + " SELECT label AS class_idx, round(s, 6) + 0.0 AS shift FROM sh", "dec8_calibrated": DEC8, "agg15_calibration_sweep": AGG15,
    "agg17_mean_probs": AGG17, "agg18_ensemble": AGG18, "agg30_generated_audit": AGG30, "agg30_audit_matrix": AGG30M, "top1_top_classes": TOP1,
    "top3_scan_log": PRED + ", r AS (SELECT stream_id, capture_id, row_number() OVER (PARTITION BY stream_id ORDER BY confidence DESC, capture_id) AS place FROM predictions) SELECT stream_id, place, capture_id FROM r WHERE place <= 12",
    "dec11_parsed_trials": DEC11, "agg19_sweep_summary": AGG19, "dec12_parity": DEC12,
}
