"""The supplied tables seen as recordings, windows and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# an annotation is [t, t + value] of one event; error stands for a sound, signup for an artifact
LABELS = {"error": "sound", "signup": "artifact"}

EV = "ev AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value, event_type, props, ts FROM events)"
WIN = "win AS (SELECT DISTINCT user_id, floor(t / 900) * 900.0 AS start_s, floor(t / 900) * 900.0 + 900.0 AS end_s FROM ev)"
ANN = "ann AS (SELECT event_id, user_id, t AS event_start, t + value AS event_end, CASE event_type WHEN 'error' THEN 'sound' WHEN 'signup' THEN 'artifact' ELSE event_type END AS label FROM ev)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") / 1e6


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", seconds())


def windows(ev: DataFrame) -> DataFrame:
    start = F.floor(F.col("t") / 900) * 900.0
    return ev.select("user_id", start.cast("double").alias("start_s")).distinct().withColumn("end_s", F.col("start_s") + 900.0)


def annotations(ev: DataFrame) -> DataFrame:
    label = F.when(F.col("event_type") == "error", "sound").when(F.col("event_type") == "signup", "artifact").otherwise(F.col("event_type"))
    return ev.select("event_id", "user_id", F.col("t").alias("event_start"), (F.col("t") + F.col("value")).alias("event_end"), label.alias("label"))
