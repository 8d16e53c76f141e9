"""Read-side queries over meters: ratings, calibration, maintenance, nearness, statistics of a period."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaic.functions import meters
from voltaic.plans.readings import READINGS_SQL, readings
from voltaic.plans.registry import query

AS_OF = "2024-01-20"


@query("meter_ratings", "WITH " + READINGS_SQL + f"""
SELECT event_id, voltage_v BETWEEN 230 * 0.9::DOUBLE AND 230 * 1.1::DOUBLE AS volts_ok, current_a BETWEEN (10 + user_id % 3 * 5) * 0.001::DOUBLE AND (10 + user_id % 3 * 5) * 1.2::DOUBLE AS amperes_ok, power_factor BETWEEN 0.5 AND 1 AS power_factor_ok,
  CASE WHEN user_id % 4 > 0 THEN CAST(user_id % 4 AS DOUBLE) END AS tolerance, coalesce(due <= DATE '{AS_OF}', false) AS calibration_due, CAST(due - DATE '{AS_OF}' AS INTEGER) AS days_left
FROM (SELECT *, CASE WHEN user_id % 5 > 0 THEN DATE '2024-01-01' + CAST(user_id % 40 AS INTEGER) END AS due FROM readings)""")  # fmt: skip
def meter_ratings(spark, sf_dir):
    u = F.col("user_id")
    due = F.when(u % 5 > 0, F.date_add(F.to_date(F.lit("2024-01-01")), (u % 40).cast("int")))
    checks = meters.rating_checks(F.col("voltage_v"), F.col("current_a"), F.col("power_factor"), F.lit(230.0), (10 + u % 3 * 5).cast("double"))
    columns = checks | {"tolerance": meters.accuracy_tolerance((u % 4).cast("string"))} | meters.calibration(due, AS_OF)
    return readings(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in columns.items()])


_METERS = "WITH " + READINGS_SQL + """, m AS (SELECT meter_id, max(latitude) AS latitude, max(longitude) AS longitude, max(reading_timestamp) AS last_reading, CASE WHEN avg(quality_score) < 0.45 THEN 'POOR' ELSE 'GOOD' END AS tier, CASE WHEN max(user_id) % 9 = 0 THEN 'MAINTENANCE' ELSE 'ACTIVE' END AS status FROM readings GROUP BY meter_id)"""


def _meters(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("meter_id").agg(
        F.max("latitude").alias("latitude"), F.max("longitude").alias("longitude"), F.max("reading_timestamp").alias("last_reading"),
        F.when(F.avg("quality_score") < 0.45, "POOR").otherwise("GOOD").alias("tier"), F.when(F.max("user_id") % 9 == 0, "MAINTENANCE").otherwise("ACTIVE").alias("status"),
    )


@query("filter_maintenance", _METERS + f" SELECT meter_id, tier, status, last_reading FROM m WHERE tier = 'POOR' OR last_reading < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY OR status = 'MAINTENANCE'")
def filter_maintenance(spark, sf_dir):
    due = meters.needs_maintenance(F.col("tier"), F.col("last_reading"), F.col("status"), AS_OF)
    return _meters(spark, sf_dir).filter(due).select("meter_id", "tier", "status", "last_reading")


@query("filter_location", _METERS + """
SELECT meter_id, latitude BETWEEN 50 - 300 / 111.0::DOUBLE AND 50 + 300 / 111.0::DOUBLE AND longitude BETWEEN 2 - 300 / (111.0::DOUBLE * cos(radians(50))) AND 2 + 300 / (111.0::DOUBLE * cos(radians(50))) AS near,
  latitude BETWEEN 50 - 300 / 111.0::DOUBLE AND 50 + 300 / 111.0::DOUBLE AND longitude BETWEEN 2 - 300 / (111.0::DOUBLE * 50) AND 2 + 300 / (111.0::DOUBLE * 50) AS near_as_published FROM m""")  # fmt: skip
def filter_location(spark, sf_dir):
    place = (F.col("latitude"), F.col("longitude"), (50, 2), 300)
    return _meters(spark, sf_dir).select("meter_id", meters.near(*place).alias("near"), meters.near(*place, as_published=True).alias("near_as_published"))


@query("period_quality", "WITH " + READINGS_SQL + """
SELECT count(*) AS total, count(*) FILTER (voltage_v IS NULL) AS missing, count(*) FILTER (consumption_kwh < 0.5) AS invalid, count(*) FILTER (is_anomaly) AS outliers, round(avg(quality_score), 6) AS avg_score,
  round(greatest(0, (count(*) - count(*) FILTER (voltage_v IS NULL) - count(*) FILTER (consumption_kwh < 0.5) - count(*) FILTER (is_anomaly)) / greatest(count(*), 1)) * 100, 6) AS score
FROM readings WHERE reading_timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15'""")  # fmt: skip
def period_quality(spark, sf_dir):
    """Counts of one pass; a reading with several faults counts several times, and the score stops at 0."""
    total, missing = F.count("*"), F.count_if(F.col("voltage_v").isNull())
    invalid, outliers = F.count_if(F.col("consumption_kwh") < 0.5), F.count_if("is_anomaly")
    score = F.greatest(F.lit(0.0), (total - missing - invalid - outliers) / F.greatest(total, F.lit(1))) * 100
    period = F.col("reading_timestamp").between(F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return readings(spark, sf_dir).filter(period).agg(total.alias("total"), missing.alias("missing"), invalid.alias("invalid"), outliers.alias("outliers"), F.round(F.avg("quality_score"), 6).alias("avg_score"), F.round(score, 6).alias("score"))
