"""Queries of the metering models and the scalar library over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaic.functions import energy, ladders, text
from voltaic.plans import models
from voltaic.plans.readings import READINGS_SQL, readings
from voltaic.plans.registry import query

AS_OF = "2024-02-01"

_STAGED = (
    "WITH "
    + READINGS_SQL
    + """,
flags AS (
  SELECT *, hour(reading_timestamp) AS hr, dayofweek(reading_timestamp) AS dow,
    consumption_kwh BETWEEN 0 AND 1000 AS v1, coalesce(voltage_v BETWEEN 200 AND 250, true) AS v2, current_a >= 0 AS v3,
    power_factor BETWEEN 0 AND 1 AS v4, coalesce(frequency_hz BETWEEN 45 AND 65, true) AS v5
  FROM readings WHERE consumption_kwh IS NOT NULL),
staged AS (
  SELECT *, CASE WHEN v1 AND v2 AND v3 AND v4 AND v5 THEN 'EXCELLENT' WHEN v1 AND v2 AND v3 THEN 'GOOD' WHEN v1 THEN 'FAIR' ELSE 'POOR' END AS tier,
    hr BETWEEN 17 AND 21 AS peak, hr >= 22 OR hr <= 6 AS off_peak, dow IN (0, 6) AS weekend FROM flags)"""
)

_CATEGORY = "CASE WHEN {0} = 0 THEN 'ZERO_CONSUMPTION' WHEN {0} < {1} THEN 'VERY_LOW' WHEN {0} < {2} THEN 'LOW' WHEN {0} < {3} THEN 'MEDIUM' WHEN {0} < {4} THEN 'HIGH' ELSE 'VERY_HIGH' END"
_ANOMALY = "CASE WHEN {0} >= 20 THEN 'HIGH_ANOMALY' WHEN {0} >= 10 THEN 'MEDIUM_ANOMALY' WHEN {0} > 0 THEN 'LOW_ANOMALY' ELSE 'NO_ANOMALY' END"
_SPREAD = "CASE WHEN {0} >= 80 THEN 'EXCELLENT' WHEN {1} >= 70 THEN 'GOOD' WHEN {2} >= 50 THEN 'FAIR' ELSE 'POOR' END"

_HOURLY = (
    _STAGED
    + """,
hours AS (
  SELECT meter_id, date_trunc('hour', reading_timestamp) AS date_hour, count(*) AS n, sum(consumption_kwh) AS total_kwh, avg(consumption_kwh) AS avg_kwh,
    min(consumption_kwh) AS min_kwh, max(consumption_kwh) AS max_kwh, stddev(consumption_kwh) AS sd_kwh, avg(voltage_v) AS v, avg(frequency_hz) AS hz, avg(power_factor) AS pf,
    avg(quality_score) AS q, count(*) FILTER (tier = 'EXCELLENT') AS n1, count(*) FILTER (tier = 'GOOD') AS n2, count(*) FILTER (tier = 'FAIR') AS n3, count(*) FILTER (tier = 'POOR') AS n4,
    count(*) FILTER (is_anomaly) AS na, bool_or(peak) AS peak, bool_or(off_peak) AS off_peak, bool_or(weekend) AS weekend, max(tariff_type) AS tariff
  FROM staged GROUP BY 1, 2),
fact AS (SELECT *, 100.0::DOUBLE * n1 / n AS p1, 100.0::DOUBLE * n2 / n AS p2, 100.0::DOUBLE * n3 / n AS p3, 100.0::DOUBLE * na / n AS pa FROM hours)"""
)


def _staged(spark, sf_dir):
    return models.stage_readings(readings(spark, sf_dir))


def _hourly(spark, sf_dir):
    return models.hourly_fact(_staged(spark, sf_dir))


@query(
    "stg_readings",
    _STAGED
    + """
SELECT event_id, meter_id, v1 AS is_valid_consumption, v2 AS is_valid_voltage, v5 AS is_valid_frequency, tier AS calculated_quality_tier,
  """
    + _CATEGORY.format("consumption_kwh", 0.1, 1, 10, 50)
    + """ AS consumption_category,
  CASE WHEN NOT v1 THEN 'INVALID_CONSUMPTION' WHEN NOT v2 THEN 'INVALID_VOLTAGE' WHEN NOT v3 THEN 'INVALID_CURRENT' WHEN NOT v4 THEN 'INVALID_POWER_FACTOR' WHEN NOT v5 THEN 'INVALID_FREQUENCY' ELSE 'VALID' END AS quality_flag,
  CAST((NOT v1)::INT + (NOT v2)::INT + (NOT v3)::INT + (NOT v4)::INT + (NOT v5)::INT AS INTEGER) AS quality_issues, peak AS is_peak_hour, off_peak AS is_off_peak_hour, weekend AS is_weekend
FROM staged""",
)
def stg_readings(spark, sf_dir):
    return _staged(spark, sf_dir).select("event_id", "meter_id", "is_valid_consumption", "is_valid_voltage", "is_valid_frequency", "calculated_quality_tier", "consumption_category", "quality_flag", "quality_issues", "is_peak_hour", "is_off_peak_hour", "is_weekend")


@query(
    "hourly_fact",
    _HOURLY
    + """
SELECT meter_id, date_hour, n AS reading_count, round(total_kwh, 6) AS total_kwh, round(avg_kwh, 6) AS avg_kwh, round(sd_kwh, 6) AS sd_kwh, round(v, 6) AS avg_voltage_v, n1 AS excellent, n2 AS good, na AS anomalies,
  round(p1, 6) AS excellent_percent, """
    + _CATEGORY.format("total_kwh", 0.1, 1, 10, 50)
    + " AS consumption_category, "
    + _SPREAD.format("p1", "p2", "p3")
    + " AS overall_quality_tier, "
    + _ANOMALY.format("pa")
    + """ AS anomaly_classification,
  CASE WHEN peak AND NOT weekend THEN 'PEAK_WEEKDAY' WHEN peak AND weekend THEN 'PEAK_WEEKEND' WHEN off_peak AND NOT weekend THEN 'OFF_PEAK_WEEKDAY' WHEN off_peak AND weekend THEN 'OFF_PEAK_WEEKEND' ELSE 'OTHER' END AS time_period, tariff AS tariff_type
FROM fact""",
)
def hourly_fact(spark, sf_dir):
    r = lambda c: F.round(c, 6)
    return _hourly(spark, sf_dir).select(
        "meter_id", "date_hour", "reading_count", r("total_consumption_kwh").alias("total_kwh"), r("avg_consumption_kwh").alias("avg_kwh"), r("stddev_consumption_kwh").alias("sd_kwh"), r("avg_voltage_v").alias("avg_voltage_v"),
        F.col("excellent_quality_count").alias("excellent"), F.col("good_quality_count").alias("good"), F.col("anomaly_count").alias("anomalies"), r("excellent_quality_percent").alias("excellent_percent"),
        "consumption_category", "overall_quality_tier", "anomaly_classification", "time_period", "tariff_type",
    )


@query(
    "daily_metrics",
    _HOURLY
    + """,
days AS (
  SELECT meter_id, CAST(date_hour AS DATE) AS date, sum(total_kwh) AS kwh, avg(avg_kwh) AS avg_kwh, min(min_kwh) AS min_kwh, max(max_kwh) AS max_kwh, stddev(avg_kwh) AS sd_kwh, CAST(sum(n) AS BIGINT) AS n,
    100.0::DOUBLE * sum(n1) / sum(n) AS p1, 100.0::DOUBLE * sum(n2) / sum(n) AS p2, 100.0::DOUBLE * sum(n3) / sum(n) AS p3, 100.0::DOUBLE * sum(na) / sum(n) AS pa, avg(pf) AS pf, bool_or(peak) AS peak, bool_or(off_peak) AS off_peak
  FROM fact GROUP BY 1, 2)
SELECT meter_id, CAST(date AS VARCHAR) AS date, round(kwh, 6) AS kwh, round(avg_kwh, 6) AS avg_kwh, round(min_kwh, 6) AS min_kwh, round(max_kwh, 6) AS max_kwh, round(sd_kwh, 6) AS sd_kwh, n AS readings, round(pa, 6) AS anomaly_percent,
  """
    + _CATEGORY.format("kwh", 1, 10, 50, 100)
    + " AS consumption_category, "
    + _SPREAD.format("p1", "p2", "p3")
    + " AS overall_quality_tier, "
    + _ANOMALY.format("pa")
    + """ AS anomaly_classification, round(kwh / pf, 6) AS adjusted_kwh,
  CASE WHEN peak AND off_peak THEN 'MIXED' WHEN peak THEN 'PEAK_ONLY' WHEN off_peak THEN 'OFF_PEAK_ONLY' ELSE 'UNKNOWN' END AS consumption_pattern,
  CASE WHEN n >= 24 THEN 'COMPLETE' WHEN n >= 12 THEN 'PARTIAL' ELSE 'INCOMPLETE' END AS data_completeness
FROM days""",
)
def daily_metrics(spark, sf_dir):
    r = lambda c, n: F.round(c, 6).alias(n)
    return models.daily_metrics(_hourly(spark, sf_dir)).select(
        "meter_id", F.col("date").cast("string").alias("date"), r("daily_consumption_kwh", "kwh"), r("avg_hourly_consumption_kwh", "avg_kwh"), r("min_hourly_consumption_kwh", "min_kwh"), r("max_hourly_consumption_kwh", "max_kwh"), r("stddev_hourly_consumption_kwh", "sd_kwh"),
        F.col("total_readings").alias("readings"), r("anomaly_percent", "anomaly_percent"), "consumption_category", "overall_quality_tier", "anomaly_classification", r("efficiency_adjusted_kwh", "adjusted_kwh"), "consumption_pattern", "data_completeness",
    )


_POINTS = "CASE {0} WHEN 'EXCELLENT' THEN 25 WHEN 'OPTIMAL' THEN 25 WHEN 'STABLE' THEN 25 WHEN 'GOOD' THEN 20 WHEN 'ACCEPTABLE' THEN 20 WHEN 'FAIR' THEN 15 WHEN 'MARGINAL' THEN 15 WHEN 'UNSTABLE' THEN 15 WHEN 'POOR' THEN {1} ELSE 5 END"


@query(
    "energy_efficiency",
    _HOURLY
    + """,
tiers AS (
  SELECT *, avg_kwh / nullif(max_kwh, 0) AS lf,
    CASE WHEN pf >= 0.95 THEN 'EXCELLENT' WHEN pf >= 0.9 THEN 'GOOD' WHEN pf >= 0.85 THEN 'FAIR' WHEN pf >= 0.8 THEN 'POOR' ELSE 'VERY_POOR' END AS t1,
    CASE WHEN v BETWEEN 220 AND 240 THEN 'OPTIMAL' WHEN v BETWEEN 210 AND 250 THEN 'ACCEPTABLE' WHEN v BETWEEN 200 AND 260 THEN 'MARGINAL' ELSE 'POOR' END AS t2,
    CASE WHEN hz BETWEEN 49.8 AND 50.2 THEN 'STABLE' WHEN hz BETWEEN 49.5 AND 50.5 THEN 'ACCEPTABLE' WHEN hz BETWEEN 49 AND 51 THEN 'UNSTABLE' ELSE 'CRITICAL' END AS t3,
    CASE WHEN q >= 0.95 THEN 'EXCELLENT' WHEN q >= 0.9 THEN 'GOOD' WHEN q >= 0.8 THEN 'FAIR' WHEN q >= 0.7 THEN 'POOR' ELSE 'VERY_POOR' END AS t4 FROM fact),
points AS (SELECT *, """
    + " + ".join(_POINTS.format(f"t{i}", p) for i, p in ((1, 10), (2, 5), (3, 5), (4, 10)))
    + """ AS s FROM tiers)
SELECT meter_id, date_hour, round(lf, 6) AS load_factor, t1 AS power_factor_tier, t2 AS voltage_tier, t3 AS frequency_tier, t4 AS quality_tier, CAST(s AS INTEGER) AS overall_efficiency_score,
  CASE WHEN s >= 90 THEN 'EXCELLENT' WHEN s >= 75 THEN 'GOOD' WHEN s >= 60 THEN 'FAIR' ELSE 'POOR' END AS efficiency_class,
  coalesce(pf < 0.85 OR v < 210 OR v > 250 OR hz < 49.5 OR hz > 50.5 OR pa > 10, false) AS has_energy_waste,
  CASE WHEN pf < 0.9 AND pf >= 0.85 THEN 'POWER_FACTOR_CORRECTION' WHEN v < 220 OR v > 240 THEN 'VOLTAGE_REGULATION' WHEN hz < 49.8 OR hz > 50.2 THEN 'FREQUENCY_STABILIZATION'
    WHEN pa > 5 THEN 'DATA_QUALITY_IMPROVEMENT' WHEN lf < 0.5 THEN 'LOAD_BALANCING' ELSE 'NO_OPTIMIZATION_NEEDED' END AS opportunity
FROM points""",
)
def energy_efficiency(spark, sf_dir):
    return models.energy_efficiency(_hourly(spark, sf_dir)).select("meter_id", "date_hour", F.round("load_factor", 6).alias("load_factor"), "power_factor_tier", "voltage_tier", "frequency_tier", "quality_tier", "overall_efficiency_score", "efficiency_class", "has_energy_waste", "opportunity")


@query(
    "dim_meters",
    _STAGED
    + f""",
d AS (
  SELECT meter_id, latitude, longitude, min(reading_timestamp) AS first_reading, max(reading_timestamp) AS last_reading, count(*) AS n, avg(consumption_kwh) AS a, sum(consumption_kwh) AS s,
    count(*) FILTER (tier = 'EXCELLENT') AS n1, count(*) FILTER (is_anomaly) AS na FROM staged GROUP BY 1, 2, 3)
SELECT meter_id, first_reading, last_reading, n AS total_readings, round(a, 6) AS avg_kwh, round(s, 6) AS total_kwh, CAST(date_diff('day', first_reading, last_reading) AS INTEGER) AS days_in_service,
  round(CASE WHEN date_diff('day', first_reading, last_reading) > 0 THEN n / date_diff('day', first_reading, last_reading) ELSE 0 END, 6) AS readings_per_day, round(100.0::DOUBLE * n1 / n, 6) AS excellent_percent,
  {_ANOMALY.format("100.0::DOUBLE * na / n")} AS anomaly_classification, split_part(meter_id, '-', 2) AS region,
  CASE WHEN latitude > 50 AND longitude > 0 THEN 'NORTH_EAST' WHEN latitude > 50 THEN 'NORTH_WEST' WHEN longitude > 0 THEN 'SOUTH_EAST' ELSE 'SOUTH_WEST' END AS quadrant,
  CASE WHEN date_diff('day', last_reading, DATE '{AS_OF}') > 7 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
FROM d""",
)
def dim_meters(spark, sf_dir):
    r = lambda c, n: F.round(c, 6).alias(n)
    return models.dim_meters(_staged(spark, sf_dir), AS_OF).select("meter_id", "first_reading", "last_reading", "total_readings", r("avg_consumption_kwh", "avg_kwh"), r("total_consumption_kwh", "total_kwh"), "days_in_service", r("readings_per_day", "readings_per_day"), r("excellent_percent", "excellent_percent"), "anomaly_classification", "region", "quadrant", "status")


@query(
    "grid_performance",
    "WITH "
    + READINGS_SQL
    + """,
g AS (SELECT event_id, frequency_hz AS hz, voltage_v AS v, consumption_kwh * 2 AS load_mw, 90.0::DOUBLE AS cap FROM readings),
s AS (SELECT *, load_mw / cap * 100 AS u,
  CASE WHEN hz BETWEEN 49.8 AND 50.2 THEN 100 WHEN hz BETWEEN 49.5 AND 50.5 THEN 80 WHEN hz BETWEEN 49 AND 51 THEN 60 WHEN hz BETWEEN 48 AND 52 THEN 40 ELSE 20 END AS f,
  CASE WHEN v BETWEEN 220 AND 240 THEN 100 WHEN v BETWEEN 210 AND 250 THEN 80 WHEN v BETWEEN 200 AND 260 THEN 60 ELSE 20 END AS vs,
  CASE WHEN hz IS NULL OR v IS NULL OR load_mw IS NULL THEN NULL WHEN hz BETWEEN 49.5 AND 50.5 AND v BETWEEN 220 AND 240 AND load_mw < cap * 0.8::DOUBLE THEN 1.0::DOUBLE
    WHEN hz BETWEEN 49 AND 51 AND v BETWEEN 210 AND 250 AND load_mw < cap * 0.9::DOUBLE THEN 0.8::DOUBLE WHEN hz BETWEEN 48 AND 52 AND v BETWEEN 200 AND 260 AND load_mw < cap THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS st FROM g)
SELECT event_id, round(u, 6) AS utilization_percent, CAST(f AS INTEGER) AS frequency_score, CAST(vs AS INTEGER) AS voltage_score, round(1 - abs(hz - 50) / 0.5::DOUBLE - abs(v - 230) / 20, 6) AS stability_index,
  CASE WHEN load_mw / cap < 0.3 THEN 'LOW' WHEN load_mw / cap < 0.7 THEN 'NORMAL' WHEN load_mw / cap < 0.9 THEN 'HIGH' ELSE 'CRITICAL' END AS load_category,
  round(0.3::DOUBLE * f + 0.3::DOUBLE * vs + 0.4::DOUBLE * st * 100, 6) AS performance_score
FROM s""",
)
def grid_performance(spark, sf_dir):
    grid = readings(spark, sf_dir).select("event_id", "frequency_hz", "voltage_v", (F.col("consumption_kwh") * 2).alias("load_mw"), F.lit(90.0).alias("capacity_mw"))
    r = lambda c: F.round(c, 6).alias(c)
    return models.grid_performance(grid).select("event_id", r("utilization_percent"), "frequency_score", "voltage_score", r("stability_index"), "load_category", r("performance_score"))


@query(
    "stg_weather",
    "WITH "
    + READINGS_SQL
    + """
SELECT event_id, CASE WHEN temperature_c < -10 THEN 'VERY_COLD' WHEN temperature_c < 0 THEN 'COLD' WHEN temperature_c < 10 THEN 'COOL' WHEN temperature_c < 20 THEN 'MILD' WHEN temperature_c < 30 THEN 'WARM' WHEN temperature_c < 40 THEN 'HOT' ELSE 'VERY_HOT' END AS temperature_category,
  CASE WHEN humidity < 30 THEN 'DRY' WHEN humidity < 50 THEN 'COMFORTABLE' WHEN humidity < 70 THEN 'MODERATE' ELSE 'HUMID' END AS humidity_category,
  CASE WHEN precipitation > 5 AND wind > 15 THEN 'STORMY' WHEN precipitation > 5 THEN 'HEAVY_RAIN' WHEN precipitation > 0 THEN 'RAINY' WHEN humidity > 80 THEN 'CLOUDY' ELSE 'CLEAR' END AS weather_condition,
  CASE WHEN temperature_c < 0 OR temperature_c > 35 THEN 0.8::DOUBLE WHEN humidity > 80 AND wind > 10 THEN 0.6::DOUBLE WHEN precipitation > 5 THEN 0.4::DOUBLE WHEN temperature_c BETWEEN 15 AND 25 AND humidity BETWEEN 40 AND 60 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS weather_impact,
  round(temperature_c * 9 / 5 + 32, 6) AS temperature_f, round(temperature_c - (100 - humidity) / 5, 6) AS dew_point, greatest(0.0::DOUBLE, 18.0::DOUBLE - temperature_c) AS heating_degrees, greatest(0.0::DOUBLE, temperature_c - 25.0::DOUBLE) AS cooling_degrees
FROM readings""",
)
def stg_weather(spark, sf_dir):
    return models.weather_staging(readings(spark, sf_dir)).select("event_id", "temperature_category", "humidity_category", "weather_condition", "weather_impact", F.round("temperature_f", 6).alias("temperature_f"), F.round("dew_point", 6).alias("dew_point"), "heating_degrees", "cooling_degrees")


@query(
    "meter_etl",
    "WITH "
    + READINGS_SQL
    + """
SELECT event_id, round(voltage_v * current_a, 6) AS apparent_power, round(voltage_v * current_a * power_factor, 6) AS active_power,
  CASE WHEN consumption_kwh < 5 THEN 'LOW' WHEN consumption_kwh < 20 THEN 'MEDIUM' WHEN consumption_kwh < 35 THEN 'HIGH' ELSE 'VERY_HIGH' END AS tariff_tier,
  CASE WHEN power_factor >= 0.95 THEN 'EXCELLENT' WHEN power_factor >= 0.85 THEN 'GOOD' WHEN power_factor >= 0.75 THEN 'FAIR' ELSE 'POOR' END AS efficiency_class,
  CASE WHEN voltage_v < 200 THEN 'LOW' WHEN voltage_v > 250 THEN 'HIGH' ELSE 'NORMAL' END AS voltage_class, substr(meter_id, 5, 3) AS region_code,
  CASE substr(meter_id, 9, 1) WHEN 'R' THEN 'RESIDENTIAL' WHEN 'C' THEN 'COMMERCIAL' ELSE 'INDUSTRIAL' END AS meter_kind,
  CASE WHEN is_anomaly AND consumption_kwh > 40 THEN 0.9::DOUBLE WHEN is_anomaly THEN 0.8::DOUBLE WHEN voltage_v > 250 THEN 0.7::DOUBLE WHEN power_factor < 0.8 THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END AS risk,
  (CASE WHEN consumption_kwh IS NULL THEN 0 ELSE 1 END + CASE WHEN voltage_v IS NULL THEN 0 ELSE 1 END + 2 + CASE WHEN frequency_hz IS NULL THEN 0 ELSE 1 END) / 5.0::DOUBLE AS completeness
FROM readings""",
)
def meter_etl(spark, sf_dir):
    return models.meter_etl(readings(spark, sf_dir)).select("event_id", F.round("apparent_power", 6).alias("apparent_power"), F.round("active_power", 6).alias("active_power"), "tariff_tier", "efficiency_class", "voltage_class", "region_code", "meter_kind", "risk", "completeness")


@query(
    "energy_macros",
    "WITH "
    + READINGS_SQL
    + """,
p AS (SELECT *, CASE WHEN dayofweek(reading_timestamp) IN (1,2,3,4,5) AND hour(reading_timestamp) BETWEEN 17 AND 21 THEN 'PEAK_WEEKDAY' WHEN dayofweek(reading_timestamp) IN (0,6) AND hour(reading_timestamp) BETWEEN 17 AND 21 THEN 'PEAK_WEEKEND'
  WHEN dayofweek(reading_timestamp) IN (1,2,3,4,5) AND hour(reading_timestamp) BETWEEN 22 AND 23 OR hour(reading_timestamp) BETWEEN 0 AND 6 THEN 'OFF_PEAK_WEEKDAY' WHEN dayofweek(reading_timestamp) IN (0,6) AND hour(reading_timestamp) BETWEEN 22 AND 23 THEN 'OFF_PEAK_WEEKEND' ELSE 'OTHER' END AS period FROM readings),
r AS (SELECT *, CASE tariff_type WHEN 'TIME_OF_USE' THEN CASE period WHEN 'PEAK_WEEKDAY' THEN 0.25::DOUBLE WHEN 'PEAK_WEEKEND' THEN 0.2::DOUBLE WHEN 'OFF_PEAK_WEEKDAY' THEN 0.1::DOUBLE WHEN 'OFF_PEAK_WEEKEND' THEN 0.08::DOUBLE ELSE 0.15::DOUBLE END
  WHEN 'TIERED' THEN CASE WHEN period LIKE 'PEAK%' THEN 0.2::DOUBLE ELSE 0.12::DOUBLE END ELSE 0.15::DOUBLE END AS rate FROM p)
SELECT event_id, period, rate, round(consumption_kwh * rate, 6) AS cost, round(consumption_kwh * 0.5::DOUBLE, 6) AS carbon, round(CASE WHEN quality_score < 0.8 THEN consumption_kwh * (0.8::DOUBLE - quality_score) ELSE 0 END, 6) AS savings,
  round(CASE WHEN period LIKE 'PEAK%' THEN consumption_kwh * 0.3::DOUBLE ELSE consumption_kwh * 0.1::DOUBLE END, 6) AS demand_response, round(consumption_kwh / power_factor, 6) AS adjusted, round(abs(voltage_v - 230) / 230 * 100, 6) AS voltage_deviation,
  CASE WHEN anomaly_score >= 0.8 THEN 'CRITICAL' WHEN anomaly_score >= 0.6 THEN 'HIGH' WHEN anomaly_score >= 0.4 THEN 'MEDIUM' WHEN anomaly_score >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS severity
FROM r""",
)
def energy_macros(spark, sf_dir):
    c = F.col
    df = readings(spark, sf_dir).withColumn("period", energy.demand_period(F.hour("reading_timestamp"), F.dayofweek("reading_timestamp") - 1))
    df = df.withColumn("rate", energy.tariff_rate(c("period"), c("tariff_type")))
    r = lambda x, n: F.round(x, 6).alias(n)
    kwh = c("consumption_kwh")
    return df.select(
        "event_id", "period", "rate", r(energy.energy_cost(kwh, c("rate")), "cost"), r(energy.carbon_footprint(kwh), "carbon"), r(energy.savings_potential(kwh, c("quality_score")), "savings"), r(energy.demand_response(kwh, c("period")), "demand_response"),
        r(energy.efficiency_adjusted(kwh, c("power_factor")), "adjusted"), r(energy.deviation_percent(c("voltage_v"), 230), "voltage_deviation"), ladders.anomaly_severity(c("anomaly_score")).alias("severity"),
    )


@query(
    "text_macros",
    """
SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), ''), 'UNKNOWN') AS segment, split_part(c_name, '#', 2) AS number, md5(coalesce(CAST(c_custkey AS VARCHAR), '') || '|' || coalesce(c_name, '')) AS row_hash,
  md5(CAST(c_custkey AS VARCHAR) || '-' || CAST(c_nationkey AS VARCHAR)) AS surrogate, upper(trim(c_name)) AS name_upper, c_custkey % 3 = 1 AS flag FROM customer""",
)
def text_macros(spark, sf_dir):
    c = F.col
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    flag = F.element_at(F.array(F.lit("no"), F.lit(" Yes "), F.lit("0")), (c("c_custkey") % 3 + 1).cast("int"))
    return df.select("c_custkey", text.clean_string(c("c_mktsegment")).alias("segment"), text.id_part(c("c_name"), 2, "#").alias("number"), text.row_hash([c("c_custkey"), c("c_name")]).alias("row_hash"), text.surrogate_key([c("c_custkey"), c("c_nationkey")]).alias("surrogate"), text.upper_clean(c("c_name")).alias("name_upper"), text.boolean(flag).alias("flag"))


@query(
    "time_macros",
    """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(dayofweek(ts) AS INTEGER) AS day_of_week, CAST(quarter(ts) AS INTEGER) AS quarter_of_year, CAST(weekofyear(ts) AS INTEGER) AS week_of_year, CAST(dayofyear(ts) AS INTEGER) AS day_of_year,
  strftime(ts, '%A') AS day_name, strftime(ts, '%B') AS month_name, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'WEEKEND' ELSE 'WEEKDAY' END AS day_type, 'WINTER' AS season, round(sin(hour(ts) * (2 * pi() / 24)), 6) AS hour_sin, round(cos(hour(ts) * (2 * pi() / 24)), 6) AS hour_cos,
  json_extract_string(props, '$.k') AS k
FROM events""",
)
def time_macros(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    sin, cos = text.cyclic(F.hour("ts"), 24)
    names = ("hour_of_day", "day_of_week", "quarter_of_year", "week_of_year", "day_of_year", "day_name", "month_name", "day_type", "season")
    features = text.time_features(F.col("ts"))
    return df.select("event_id", *[features[n].alias(n) for n in names], F.round(sin, 6).alias("hour_sin"), F.round(cos, 6).alias("hour_cos"), text.json_field(F.col("props"), "k").alias("k"))


@query(
    "geo_functions",
    "WITH "
    + READINGS_SQL
    + """,
m AS (SELECT DISTINCT meter_id, latitude, longitude FROM readings)
SELECT meter_id, round(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km, round(sqrt((latitude - 51) * (latitude - 51) + (longitude - 9) * (longitude - 9)), 6) AS degrees
FROM (SELECT *, pow(sin(radians(51 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(51)) * pow(sin(radians(9 - longitude) / 2), 2) AS a FROM m)""",
)
def geo_functions(spark, sf_dir):
    m = readings(spark, sf_dir).select("meter_id", "latitude", "longitude").distinct()
    here = (F.col("latitude"), F.col("longitude"))
    there = (F.lit(51.0), F.lit(9.0))
    return m.select("meter_id", F.round(text.haversine_km(*here, *there), 6).alias("km"), F.round(text.degree_distance(*here, *there), 6).alias("degrees"))
