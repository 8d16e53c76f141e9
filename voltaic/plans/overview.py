"""Queries of the grid, station and meter dimensions, the older daily model and the operational overviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.functions import energy, ladders
from voltaic.plans.readings import READINGS_SQL, readings
from voltaic.plans.registry import query

#: The readings seen as states of grid operators (a region each) and as observations of twelve weather stations.
GRID_SQL = READINGS_SQL + """,
grid AS (SELECT event_id, substr(meter_id, 5, 3) AS operator_id, reading_timestamp AS ts, frequency_hz, voltage_v, current_a * 40 AS load_mw, 900.0::DOUBLE AS capacity_mw, quality_score * 100 AS efficiency_percent, is_anomaly FROM readings)"""  # fmt: skip
STATION_SQL = READINGS_SQL + """,
weather AS (SELECT event_id, 'WS-' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS station_id, reading_timestamp AS ts, temperature_c, humidity, wind, precipitation, is_anomaly FROM readings)"""  # fmt: skip


def grid_states(spark, sf_dir) -> DataFrame:
    return readings(spark, sf_dir).select(
        "event_id", F.substring("meter_id", 5, 3).alias("operator_id"), F.col("reading_timestamp").alias("ts"), "frequency_hz", "voltage_v",
        (F.col("current_a") * 40).alias("load_mw"), F.lit(900.0).alias("capacity_mw"), (F.col("quality_score") * 100).alias("efficiency_percent"), "is_anomaly",
    )


def weather_rows(spark, sf_dir) -> DataFrame:
    station = F.concat(F.lit("WS-"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0"))
    return readings(spark, sf_dir).select("event_id", station.alias("station_id"), F.col("reading_timestamp").alias("ts"), "temperature_c", "humidity", "wind", "precipitation", "is_anomaly")


def r(c, n=None):
    return F.round(c, 6).alias(n or c)


def day(c: str):
    return F.to_date(c).cast("string").alias("day")


@query("stg_grid_status", "WITH " + GRID_SQL + """,
f AS (SELECT *, coalesce(frequency_hz BETWEEN 45 AND 65, true) AS ok_f, coalesce(voltage_v BETWEEN 100 AND 500, true) AS ok_v, load_mw >= 0 AS ok_l, efficiency_percent BETWEEN 0 AND 100 AS ok_e FROM grid)
SELECT event_id, operator_id, ok_f AS is_valid_frequency, ok_v AS is_valid_voltage,
  CASE WHEN ok_f AND ok_v AND ok_l AND ok_e THEN 'EXCELLENT' WHEN ok_f AND ok_v THEN 'GOOD' WHEN ok_f THEN 'FAIR' ELSE 'POOR' END AS calculated_quality_tier,
  round(load_mw / capacity_mw * 100, 6) AS utilization_percent,
  CASE WHEN load_mw < 0.3 * capacity_mw THEN 'LOW' WHEN load_mw < 0.7 * capacity_mw THEN 'MEDIUM' WHEN load_mw < 0.9 * capacity_mw THEN 'HIGH' ELSE 'CRITICAL' END AS load_category,
  CASE WHEN NOT ok_f THEN 'INVALID_FREQUENCY' WHEN NOT ok_v THEN 'INVALID_VOLTAGE' WHEN NOT ok_l THEN 'INVALID_LOAD' WHEN NOT ok_e THEN 'INVALID_EFFICIENCY' ELSE 'VALID' END AS quality_flag FROM f""")  # fmt: skip
def stg_grid_status(spark, sf_dir):
    c = F.col
    checks = {"frequency": ladders.in_range(c("frequency_hz"), 45, 65), "voltage": ladders.in_range(c("voltage_v"), 100, 500), "load": F.coalesce(c("load_mw") >= 0, F.lit(True)), "efficiency": ladders.in_range(c("efficiency_percent"), 0, 100)}
    every = lambda n: reduce(ladders.and_, list(checks.values())[:n])
    return grid_states(spark, sf_dir).select(
        "event_id", "operator_id", checks["frequency"].alias("is_valid_frequency"), checks["voltage"].alias("is_valid_voltage"),
        ladders.first_match([(every(4), "EXCELLENT"), (every(2), "GOOD"), (every(1), "FAIR")], "POOR").alias("calculated_quality_tier"),
        r(energy.utilization(c("load_mw"), c("capacity_mw")), "utilization_percent"),
        ladders.first_match([(c("load_mw") < share * c("capacity_mw"), label) for share, label in ((0.3, "LOW"), (0.7, "MEDIUM"), (0.9, "HIGH"))], "CRITICAL").alias("load_category"),
        ladders.quality_flag(checks).alias("quality_flag"),
    )


@query("dim_grid_operators", "WITH " + GRID_SQL + """,
a AS (SELECT operator_id, count(*) AS readings, min(ts) AS first_ts, max(ts) AS last_ts, avg(frequency_hz) AS f, avg(voltage_v) AS v, avg(load_mw / capacity_mw * 100) AS u, count(*) FILTER (frequency_hz BETWEEN 49.8 AND 50.2) AS stable, count(*) FILTER (is_anomaly) AS anomalies FROM grid GROUP BY 1)
SELECT operator_id, readings, first_ts, last_ts, round(f, 6) AS avg_frequency_hz, round(v, 6) AS avg_voltage_v, round(u, 6) AS avg_utilization, round(stable / readings * 100, 6) AS stable_percent, anomalies,
  CASE WHEN stable / readings * 100 >= 95 THEN 'HIGHLY_STABLE' WHEN stable / readings * 100 >= 80 THEN 'STABLE' WHEN stable / readings * 100 >= 50 THEN 'MODERATE' ELSE 'UNSTABLE' END AS stability_class,
  CASE WHEN last_ts < TIMESTAMP '2024-01-30' THEN 'INACTIVE' ELSE 'ACTIVE' END AS status FROM a""")  # fmt: skip
def dim_grid_operators(spark, sf_dir):
    c = F.col
    a = grid_states(spark, sf_dir).groupBy("operator_id").agg(
        F.count("*").alias("readings"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("frequency_hz").alias("f"), F.avg("voltage_v").alias("v"),
        F.avg(energy.utilization(c("load_mw"), c("capacity_mw"))).alias("u"), F.count_if(c("frequency_hz").between(49.8, 50.2)).alias("stable"), F.count_if("is_anomaly").alias("anomalies"),
    ).withColumn("share", ladders.percent(c("stable"), c("readings")))
    status = F.when(c("last_ts") < F.lit("2024-01-30").cast("timestamp_ntz"), "INACTIVE").otherwise("ACTIVE")
    stability = ladders.at_least(c("share"), [(95, "HIGHLY_STABLE"), (80, "STABLE"), (50, "MODERATE")], "UNSTABLE")
    return a.select("operator_id", "readings", "first_ts", "last_ts", r("f", "avg_frequency_hz"), r("v", "avg_voltage_v"), r("u", "avg_utilization"), r("share", "stable_percent"), "anomalies", stability.alias("stability_class"), status.alias("status"))


@query("dim_weather_stations", "WITH " + STATION_SQL + """
SELECT station_id, count(*) AS observations, min(temperature_c) AS min_temperature, max(temperature_c) AS max_temperature, round(avg(temperature_c), 6) AS avg_temperature, round(avg(humidity), 6) AS avg_humidity, max(wind) AS max_wind, sum(precipitation) AS total_precipitation,
  CASE WHEN avg(temperature_c) < 5 THEN 'COLD' WHEN avg(temperature_c) < 15 THEN 'TEMPERATE' WHEN avg(temperature_c) < 25 THEN 'WARM' ELSE 'HOT' END AS climate,
  round(count(*) FILTER (is_anomaly) / count(*) * 100, 6) AS anomaly_percent FROM weather GROUP BY 1""")  # fmt: skip
def dim_weather_stations(spark, sf_dir):
    a = weather_rows(spark, sf_dir).groupBy("station_id").agg(
        F.count("*").alias("observations"), F.min("temperature_c").alias("min_temperature"), F.max("temperature_c").alias("max_temperature"), F.avg("temperature_c").alias("t"),
        r(F.avg("humidity"), "avg_humidity"), F.max("wind").alias("max_wind"), F.sum("precipitation").alias("total_precipitation"), r(F.count_if("is_anomaly") / F.count("*") * 100, "anomaly_percent"),
    )
    return a.withColumns({"avg_temperature": F.round("t", 6), "climate": ladders.below(F.col("t"), [(5, "COLD"), (15, "TEMPERATE"), (25, "WARM")], "HOT")}).drop("t")


@query("hourly_enrichment", "WITH " + READINGS_SQL + """,
h AS (SELECT meter_id, date_trunc('hour', reading_timestamp) AS hour, sum(consumption_kwh) AS kwh FROM readings GROUP BY 1, 2),
w AS (SELECT date_trunc('hour', reading_timestamp) AS hour, avg(temperature_c) AS temp, avg(frequency_hz) AS hz FROM readings WHERE event_type = 'view' GROUP BY 1)
SELECT meter_id, h.hour AS date_hour, round(kwh, 6) AS kwh, round(temp, 6) AS temperature, round(hz, 6) AS grid_frequency,
  CASE WHEN temp < 10 OR temp > 30 THEN 'WEATHER_SENSITIVE' WHEN temp IS NULL THEN 'NO_WEATHER' ELSE 'NORMAL' END AS demand_class FROM h LEFT JOIN w USING (hour)""")  # fmt: skip
def hourly_enrichment(spark, sf_dir):
    """Both sides are aggregated before the join, so it is one row an hour on the right."""
    e = readings(spark, sf_dir).withColumn("date_hour", F.date_trunc("hour", "reading_timestamp").cast("timestamp_ntz"))
    h = e.groupBy("meter_id", "date_hour").agg(r(F.sum("consumption_kwh"), "kwh"))
    w = e.filter("event_type = 'view'").groupBy("date_hour").agg(F.avg("temperature_c").alias("t"), r(F.avg("frequency_hz"), "grid_frequency"))
    demand = F.when((F.col("t") < 10) | (F.col("t") > 30), "WEATHER_SENSITIVE").when(F.col("t").isNull(), "NO_WEATHER").otherwise("NORMAL")
    return h.join(w, "date_hour", "left").select("meter_id", "date_hour", "kwh", r("t", "temperature"), "grid_frequency", demand.alias("demand_class"))


@query("daily_overview", "WITH " + READINGS_SQL + """,
p AS (SELECT *, CAST(CAST(reading_timestamp AS DATE) AS VARCHAR) AS day, hour(reading_timestamp) AS h, dayofweek(reading_timestamp) IN (0, 6) AS weekend FROM readings),
a AS (SELECT day, count(DISTINCT meter_id) AS meters, count(*) AS n, sum(consumption_kwh) AS kwh, stddev(consumption_kwh) AS dev, count(*) FILTER (is_anomaly) AS anomalies,
  coalesce(sum(consumption_kwh) FILTER (h BETWEEN 6 AND 11), 0) AS morning, coalesce(sum(consumption_kwh) FILTER (h BETWEEN 12 AND 17), 0) AS afternoon, coalesce(sum(consumption_kwh) FILTER (h BETWEEN 18 AND 23), 0) AS evening, coalesce(sum(consumption_kwh) FILTER (h < 6), 0) AS night, bool_or(weekend) AS weekend FROM p GROUP BY 1)
SELECT day, meters, n AS readings, round(kwh, 4) AS kwh, round(dev, 4) AS deviation, weekend AS is_weekend, round(morning, 4) AS morning, round(afternoon, 4) AS afternoon, round(evening, 4) AS evening, round(night, 4) AS night,
  round(anomalies / n, 6) AS anomaly_rate, CAST(round(CAST(kwh / meters AS DECIMAL(30, 10)), 4) AS DOUBLE) AS kwh_per_meter, round(CASE WHEN morning > 0 THEN evening / morning END, 4) AS evening_morning,
  CASE WHEN anomalies / n < 0.05 THEN 'HIGH' WHEN anomalies / n < 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS quality_class FROM a""")  # fmt: skip
def daily_overview(spark, sf_dir):
    """The older daily model: one pass with conditional sums, where that model joined four aggregates of one fact."""
    c, hour = F.col, F.hour("reading_timestamp")
    part = lambda test, name: F.coalesce(F.sum(F.when(test, c("consumption_kwh"))), F.lit(0.0)).alias(name)
    a = readings(spark, sf_dir).groupBy(day("reading_timestamp")).agg(
        F.count_distinct("meter_id").alias("meters"), F.count("*").alias("readings"), F.sum("consumption_kwh").alias("kwh"), F.stddev("consumption_kwh").alias("dev"), F.count_if("is_anomaly").alias("bad"),
        part(hour.between(6, 11), "morning"), part(hour.between(12, 17), "afternoon"), part(hour.between(18, 23), "evening"), part(hour < 6, "night"), F.bool_or(F.dayofweek("reading_timestamp").isin(1, 7)).alias("is_weekend"),
    ).withColumn("rate", c("bad") / c("readings"))
    r4 = lambda x, n: F.round(x, 4).alias(n)
    return a.select(
        "day", "meters", "readings", r4("kwh", "kwh"), r4("dev", "deviation"), "is_weekend", *[r4(x, x) for x in ("morning", "afternoon", "evening", "night")],
        r("rate", "anomaly_rate"), ladders.fair(c("kwh") / c("meters"), 4).alias("kwh_per_meter"), r4(ladders.ratio(c("evening"), c("morning")), "evening_morning"), ladders.below(c("rate"), [(0.05, "HIGH"), (0.15, "MEDIUM")], "LOW").alias("quality_class"),
    )


@query("meter_variability", "WITH " + READINGS_SQL + """,
a AS (SELECT meter_id, count(DISTINCT CAST(reading_timestamp AS DATE)) AS days, avg(consumption_kwh) AS mean, stddev(consumption_kwh) AS dev, date_diff('day', CAST(min(reading_timestamp) AS DATE), DATE '2024-02-01') AS age FROM readings GROUP BY 1)
SELECT meter_id, days AS active_days, CAST(age AS BIGINT) AS age_days, round(mean + 1e-9, 6) AS mean_kwh, round(dev, 6) AS deviation, CASE WHEN mean >= 30 THEN 'HIGH' WHEN mean >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  CASE WHEN dev / mean > 0.5 THEN 'HIGHLY_VARIABLE' WHEN dev / mean > 0.2 THEN 'VARIABLE' ELSE 'STABLE' END AS variability FROM a""")  # fmt: skip
def meter_variability(spark, sf_dir):
    c, stamp = F.col, "reading_timestamp"
    a = readings(spark, sf_dir).groupBy("meter_id").agg(F.count_distinct(F.to_date(stamp)).alias("active_days"), F.datediff(F.lit("2024-02-01").cast("date"), F.min(stamp)).cast("long").alias("age_days"), F.avg("consumption_kwh").alias("m"), F.stddev("consumption_kwh").alias("s"))
    spread = F.try_divide(c("s"), c("m"))
    return a.select("meter_id", "active_days", "age_days", r(c("m") + 1e-9, "mean_kwh"), r("s", "deviation"), ladders.at_least(c("m"), [(30, "HIGH"), (20, "MEDIUM")], "LOW").alias("level"), ladders.above(spread, [(0.5, "HIGHLY_VARIABLE"), (0.2, "VARIABLE")], "STABLE").alias("variability"))


@query("ingestion_metrics", """
SELECT 'events' AS table_name, count(*) AS total, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT user_id) AS entities FROM events
UNION ALL SELECT 'orders', count(*), min(o_orderdate), max(o_orderdate), count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'lineitem', count(*), min(l_shipdate), max(l_shipdate), count(DISTINCT l_suppkey) FROM lineitem""")
def ingestion_metrics(spark, sf_dir):
    sources = [("events", "ts", "user_id"), ("orders", "o_orderdate", "o_custkey"), ("lineitem", "l_shipdate", "l_suppkey")]
    one = lambda name, ts, entity: spark.read.parquet(f"{sf_dir}/{name}.parquet").agg(F.count("*").alias("total"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_distinct(entity).alias("entities")).withColumn("table_name", F.lit(name))
    return reduce(DataFrame.unionByName, [one(*s) for s in sources])


@query("weather_impact_summary", "WITH " + STATION_SQL + """
SELECT station_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, min(temperature_c) AS lowest, max(temperature_c) AS highest, round(avg(humidity), 6) AS humidity, count(*) FILTER (temperature_c < 15) AS cold, count(*) FILTER (temperature_c > 25) AS hot, count(*) FILTER (humidity > 80) AS humid, count(*) FILTER (wind > 10) AS windy,
  round(avg(greatest(0.5, least(2.0, 1 + CASE WHEN temperature_c < 15 THEN (15 - temperature_c) * 0.02 WHEN temperature_c > 25 THEN (temperature_c - 25) * 0.03 ELSE 0 END + CASE WHEN humidity > 70 THEN 0.1 ELSE 0 END + CASE WHEN wind > 10 THEN 0.05 ELSE 0 END))), 6) AS demand_factor FROM weather GROUP BY 1, 2""")  # fmt: skip
def weather_impact_summary(spark, sf_dir):
    c = F.col
    factor = energy.demand_factor(c("temperature_c"), c("humidity"), c("wind"), F.lit(0.0))
    return weather_rows(spark, sf_dir).groupBy("station_id", day("ts")).agg(
        F.min("temperature_c").alias("lowest"), F.max("temperature_c").alias("highest"), r(F.avg("humidity"), "humidity"), F.count_if(c("temperature_c") < 15).alias("cold"), F.count_if(c("temperature_c") > 25).alias("hot"),
        F.count_if(c("humidity") > 80).alias("humid"), F.count_if(c("wind") > 10).alias("windy"), r(F.avg(factor), "demand_factor"),
    )


@query("anomaly_overview", "WITH " + READINGS_SQL + """,
s AS (SELECT hour(reading_timestamp) AS h, CASE WHEN anomaly_score >= 0.8 THEN 'CRITICAL' WHEN anomaly_score >= 0.6 THEN 'HIGH' WHEN anomaly_score >= 0.4 THEN 'MEDIUM' WHEN anomaly_score >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS severity, is_anomaly FROM readings),
p AS (SELECT severity, h, count(*) FILTER (is_anomaly) AS found, count(*) AS n FROM s GROUP BY 1, 2)
SELECT severity, CAST(sum(found) AS BIGINT) AS anomalies, round(sum(found) / sum(n), 6) AS rate, CAST(arg_max(h, found * 24 + 23 - h) AS BIGINT) AS peak_hour FROM p GROUP BY 1""")  # fmt: skip
def anomaly_overview(spark, sf_dir):
    """Counts and rates over all readings of a severity; the peak hour is the smallest of the busiest."""
    p = readings(spark, sf_dir).groupBy(ladders.anomaly_severity(F.col("anomaly_score")).alias("severity"), F.hour("reading_timestamp").alias("h")).agg(F.count_if("is_anomaly").alias("found"), F.count("*").alias("n"))
    busiest = F.max_by("h", F.col("found") * 24 + 23 - F.col("h")).cast("long")
    return p.groupBy("severity").agg(F.sum("found").alias("anomalies"), r(F.sum("found") / F.sum("n"), "rate"), busiest.alias("peak_hour"))


@query("event_statistics", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS entities, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event, round(avg(value), 6) AS mean, round(min(value), 6) AS lowest, round(max(value), 6) AS highest,
  count(*) FILTER (regexp_matches(json_extract_string(props, '$.k'), '^-?[0-9]+(\\.[0-9]+)?$')) AS numeric_props, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS prop_mean FROM events GROUP BY 1""")  # fmt: skip
def event_statistics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    numeric = F.col("k").rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("entities"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("event_id", "ts").alias("first_event"), F.max_by("event_id", "ts").alias("last_event"),
        r(F.avg("value"), "mean"), r(F.min("value"), "lowest"), r(F.max("value"), "highest"), F.count_if(numeric).alias("numeric_props"), r(F.avg(F.when(numeric, F.col("k").cast("double"))), "prop_mean"),
    )


@query("entity_summary", """
SELECT n_name AS region, count(*) AS total, count(*) FILTER (c_acctbal >= 0) AS active, count(*) FILTER (c_acctbal < 0) AS inactive, round(avg(c_acctbal), 6) AS mean_score, round(max(c_acctbal), 6) AS peak, arg_max(c_name, c_acctbal) AS peak_entity, round(count(*) FILTER (c_acctbal >= 0) / count(*), 6) AS active_share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def entity_summary(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    active = F.col("c_acctbal") >= 0
    return read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("region")).agg(
        F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(~active).alias("inactive"), r(F.avg("c_acctbal"), "mean_score"), r(F.max("c_acctbal"), "peak"),
        F.max_by("c_name", "c_acctbal").alias("peak_entity"), r(F.count_if(active) / F.count("*"), "active_share"),
    )


@query("grid_stability", "WITH " + GRID_SQL + """,
a AS (SELECT operator_id, avg(frequency_hz) AS f, avg(voltage_v) AS v, avg(load_mw / capacity_mw) AS u, count(*) FILTER (is_anomaly) / count(*) AS bad FROM grid GROUP BY 1),
s AS (SELECT *, (abs(f - 50) > 0.2)::INT + (v NOT BETWEEN 220 AND 240)::INT + (u > 0.5)::INT + (bad > 0.1)::INT AS issues, 1 - 0.25 * ((abs(f - 50) > 0.2)::INT + (v NOT BETWEEN 220 AND 240)::INT + (u > 0.5)::INT + (bad > 0.1)::INT) AS score FROM a)
SELECT operator_id, CAST(issues AS INTEGER) AS issues, CAST(score AS DOUBLE) AS score, CASE WHEN score < 0.3 THEN 'high' WHEN score < 0.6 THEN 'medium' ELSE 'low' END AS priority FROM s""")  # fmt: skip
def grid_stability(spark, sf_dir):
    """Four threshold issues an operator, its score, and the priority of the advice."""
    c = F.col
    a = grid_states(spark, sf_dir).groupBy("operator_id").agg(F.avg("frequency_hz").alias("f"), F.avg("voltage_v").alias("v"), F.avg(c("load_mw") / c("capacity_mw")).alias("u"), (F.count_if("is_anomaly") / F.count("*")).alias("bad"))
    tests = {"frequency": F.abs(c("f") - 50) > 0.2, "voltage": ~c("v").between(220, 240), "load": c("u") > 0.5, "anomalies": c("bad") > 0.1}
    a = a.withColumn("found", F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in tests.items()])))
    score = 1 - 0.25 * F.size("found")
    return a.select("operator_id", F.size("found").alias("issues"), score.alias("score"), ladders.below(score, [(0.3, "high"), (0.6, "medium")], "low").alias("priority"))
