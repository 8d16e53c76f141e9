"""Meter readings, for queries: the driver's events seen as readings, in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that the events table lacks follow from its ids; some are null or out of range on purpose.
READINGS_SQL = """readings AS (
  SELECT event_id, user_id, ts AS reading_timestamp, event_type, props,
    'MET-' || CASE user_id % 4 WHEN 0 THEN 'NOR' WHEN 1 THEN 'SOU' WHEN 2 THEN 'EAS' ELSE 'WES' END || '-' || CASE user_id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'C' ELSE 'I' END || '-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS meter_id,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE value / 10 END AS consumption_kwh,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(195 + event_id % 66 AS DOUBLE) END AS voltage_v,
    CAST(event_id % 50 AS DOUBLE) / 2 AS current_a,
    CAST(75 + event_id % 26 AS DOUBLE) / 100 AS power_factor,
    CASE WHEN event_id % 83 = 0 THEN NULL ELSE CAST(490 + event_id % 21 AS DOUBLE) / 10 END AS frequency_hz,
    CAST(event_id % 60 - 15 AS DOUBLE) AS temperature_c,
    CAST(20 + event_id % 81 AS DOUBLE) AS humidity,
    CAST(event_id % 25 AS DOUBLE) AS wind,
    CAST(event_id % 9 AS DOUBLE) AS precipitation,
    CAST((event_id * 7) % 101 AS DOUBLE) / 100 AS quality_score,
    CAST(event_id % 100 AS DOUBLE) / 100 AS anomaly_score,
    event_type = 'error' AS is_anomaly,
    CASE event_id % 4 WHEN 0 THEN 'TIME_OF_USE' WHEN 1 THEN 'FLAT_RATE' WHEN 2 THEN 'TIERED' ELSE 'OTHER' END AS tariff_type,
    CAST(45 + user_id % 11 AS DOUBLE) AS latitude, CAST(user_id % 21 - 10 AS DOUBLE) AS longitude
  FROM events)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, u = F.col("event_id"), F.col("user_id")
    number = lambda c: c.cast("double")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    return e.select(
        "event_id", "user_id", F.col("ts").alias("reading_timestamp"), "event_type", "props",
        F.concat(F.lit("MET-"), pick(u % 4, "NOR", "SOU", "EAS", "WES"), F.lit("-"), pick(u % 3, "R", "C", "I"), F.lit("-"), F.lpad(u.cast("string"), 6, "0")).alias("meter_id"),
        F.when(i % 89 != 0, F.col("value") / 10).alias("consumption_kwh"),
        F.when(i % 97 != 0, number(195 + i % 66)).alias("voltage_v"),
        (number(i % 50) / 2).alias("current_a"),
        (number(75 + i % 26) / 100).alias("power_factor"),
        F.when(i % 83 != 0, number(490 + i % 21) / 10).alias("frequency_hz"),
        number(i % 60 - 15).alias("temperature_c"),
        number(20 + i % 81).alias("humidity"),
        number(i % 25).alias("wind"),
        number(i % 9).alias("precipitation"),
        (number((i * 7) % 101) / 100).alias("quality_score"),
        (number(i % 100) / 100).alias("anomaly_score"),
        (F.col("event_type") == "error").alias("is_anomaly"),
        pick(i % 4, "TIME_OF_USE", "FLAT_RATE", "TIERED", "OTHER").alias("tariff_type"),
        number(45 + u % 11).alias("latitude"), number(u % 21 - 10).alias("longitude"),
    )
