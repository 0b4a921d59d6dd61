"""Canonical tables of the library, derived from the provided tables by plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class 4 plays the background.
NOISE, NOISE_LABEL = "Noise", 4
#: Event types in alphabetical order.
TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    """Rounded to six digits, with no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, filepath, target_raw, snr, class_name, iq (array of complex samples)."""
    emb = table(spark, sf_dir, "embeddings")
    snr = (F.pmod("vec_id", F.lit(20)) * 2 - 20).cast("int")
    part = lambda n: F.element_at("embedding", n.cast("int")).cast("double")  # noqa: E731 (a cast of the whole vector would be made again for each sample)
    return emb.select(
        F.col("vec_id").alias("capture_id"),
        F.concat(F.lit("IQdata_sample"), "vec_id", F.lit("_target"), "label", F.lit("_snr"), snr, F.lit(".pt")).alias("filepath"),
        F.col("label").alias("target_raw"), snr.alias("snr"),
        F.when(F.col("label") == NOISE_LABEL, NOISE).otherwise(F.concat(F.lit("class_"), "label")).alias("class_name"),
        F.transform(F.sequence(F.lit(0), F.expr("size(embedding) div 2 - 1")), lambda k: F.struct(part(2 * k + 1).alias("i"), part(2 * k + 2).alias("q"))).alias("iq"),
    )


def iq_samples(caps: DataFrame) -> DataFrame:
    """Long form: capture_id, n, i, q."""
    return caps.select("capture_id", F.posexplode("iq").alias("n", "s")).select("capture_id", "n", "s.i", "s.q")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, stream_id, y_true, y_pred, snr, confidence, condition, ts."""
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")
    types = F.array(*map(F.lit, TYPES))
    place = F.array_position(types, F.col("event_type"))
    follows = F.element_at(types, F.when(place == len(TYPES), 1).otherwise(place + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("capture_id"), F.col("user_id").alias("stream_id"), F.col("event_type").alias("y_true"),
        F.when(k < 70, F.col("event_type")).otherwise(follows).alias("y_pred"), (k % 20 * 2 - 20).alias("snr"),
        (k / 100).alias("confidence"), F.date_format("ts", "yyyy-MM-dd").alias("condition"), "ts", "value",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, seq, ts, power_db: one row per fixed-size chunk of a stream."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"), "ts", power_db(F.col("value")).alias("power_db")
    )


def power_db(mean_square: Column) -> Column:
    return 10 * F.log10(mean_square + F.lit(1e-12))


#: The same tables for DuckDB.
SQL = {
    "captures": """captures AS (SELECT vec_id AS capture_id, 'IQdata_sample' || vec_id || '_target' || label || '_snr' || ((vec_id % 20) * 2 - 20) || '.pt' AS filepath,
  label AS target_raw, ((vec_id % 20) * 2 - 20)::INT AS snr, CASE WHEN label = 4 THEN 'Noise' ELSE 'class_' || label END AS class_name FROM embeddings)""",
    "iq": """iq AS (SELECT vec_id AS capture_id, n::INT AS n, embedding[2 * n + 1]::DOUBLE AS i, embedding[2 * n + 2]::DOUBLE AS q FROM embeddings, range(32) t(n))""",
    "predictions": """raw_events AS (SELECT *, regexp_extract(props, '"k": *(\\d+)', 1)::INT AS k FROM events),
predictions AS (SELECT event_id AS capture_id, user_id AS stream_id, event_type AS y_true,
  CASE WHEN k < 70 THEN event_type WHEN event_type = 'click' THEN 'error' WHEN event_type = 'error' THEN 'purchase' WHEN event_type = 'purchase' THEN 'signup'
    WHEN event_type = 'signup' THEN 'view' ELSE 'click' END AS y_pred,
  k % 20 * 2 - 20 AS snr, k / 100.0::DOUBLE AS confidence, strftime(ts, '%Y-%m-%d') AS condition, ts, value FROM raw_events)""",
    "chunks": """chunks AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, ts,
  10 * log10(value + 1e-12) AS power_db FROM events)""",
}


def with_tables(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
