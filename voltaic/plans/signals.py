"""Queries of series anomalies and forecasts, features of time and equipment, correlations and rules of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaic.functions import ladders
from voltaic.operators import forecast, joins, windows
from voltaic.plans.readings import READINGS_SQL, readings
from voltaic.plans.registry import query


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, n=None):
    return F.round(c, 6).alias(n or c)


@query("series_anomalies", """
WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS m, stddev(value) AS d, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events GROUP BY 1)
SELECT event_id, round(abs(value - m) / d, 6) AS z, abs(value - m) / d > 1.5 AS z_flag, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS iqr_flag, value < lo OR value > hi AS percentile_flag FROM events JOIN s USING (event_type)""")  # fmt: skip
def series_anomalies(spark, sf_dir):
    return forecast.key_anomalies(t(spark, sf_dir, "events"), ["event_type"], "value", limit=1.5).select("event_id", r("z"), "z_flag", "iqr_flag", "percentile_flag")


@query("moving_average_anomaly", """
WITH w AS (SELECT event_id, value, count(value) OVER f AS n, avg(value) OVER f AS m, stddev(value) OVER f AS d FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT event_id, round(CASE WHEN n = 10 AND d > 0 THEN abs(value - m) / d END, 5) AS distance, coalesce(n = 10 AND d > 0 AND abs(value - m) / d > 2, false) AS is_anomaly FROM w""")  # fmt: skip
def moving_average_anomaly(spark, sf_dir):
    return forecast.moving_average_anomaly(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("distance", 5).alias("distance"), "is_anomaly")


@query("next_values", """
WITH RECURSIVE n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS lft FROM events),
l AS (SELECT user_id, count(*) AS n, regr_slope(value, i) AS b, regr_intercept(value, i) AS a, avg(value) FILTER (lft <= 10) AS moving_average FROM n GROUP BY 1),
s AS (SELECT user_id, 100::BIGINT AS lft, value AS x FROM n WHERE lft = 100 UNION ALL SELECT user_id, lft, value FROM n WHERE i = 1 AND lft < 100 UNION ALL SELECT s.user_id, n.lft, s.x * 0.7::DOUBLE + n.value * 0.3::DOUBLE FROM s JOIN n ON n.user_id = s.user_id AND n.lft = s.lft - 1)
SELECT user_id, step, round(a + b * (n + step), 4) AS linear, round(moving_average, 6) AS moving_average, round(x, 5) AS smoothed FROM l JOIN s USING (user_id), (SELECT unnest([1, 2, 3]) AS step) WHERE s.lft = 1""")  # fmt: skip
def next_values(spark, sf_dir):
    return forecast.next_values(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "step", F.round("linear", 4).alias("linear"), r("moving_average"), F.round("smoothed", 5).alias("smoothed"))


@query("window_forecasts", """
WITH w AS (SELECT event_id, value, avg(value) OVER d AS m, avg(value) OVER k AS wk FROM events WINDOW d AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), k AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING))
SELECT event_id, CAST(round(CAST(m * 0.98 + value * 0.02 AS DECIMAL(30, 10)), 5) AS DOUBLE) AS blended, CAST(round(CAST(m * 1.02 AS DECIMAL(30, 10)), 5) AS DOUBLE) AS grown, CAST(round(CAST(wk * 1.01 AS DECIMAL(30, 10)), 5) AS DOUBLE) AS weekly FROM w""")  # fmt: skip
def window_forecasts(spark, sf_dir):
    """Values are cents, so their means often lie on ties of rounding, which are rounded fairly."""
    keys, order = ["user_id"], ["ts", "event_id"]
    df = windows.trailing(windows.trailing(t(spark, sf_dir, "events"), "value", keys, order, 24), "value", keys, order, 168)
    mean, week, r5 = F.col("value_avg_24"), F.col("value_avg_168"), lambda c, n: ladders.fair(c, 5).alias(n)
    return df.select("event_id", r5(forecast.blended(F.col("value"), mean), "blended"), r5(forecast.blended(F.col("value"), mean, None), "grown"), r5(forecast.blended(F.col("value"), week, None, 1.01), "weekly"))


@query("calendar_features", """
SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS weekday_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS weekday_cos,
  round(sin(2 * pi() * month(ts) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS month_cos, (month(ts) = 1 AND day(ts) = 1) OR (month(ts) = 12 AND day(ts) = 25) AS is_holiday, round(value * value, 4) AS square, round(value * hour(ts), 4) AS interaction FROM events""")  # fmt: skip
def calendar_features(spark, sf_dir):
    parts = forecast.calendar_features("ts")
    rounded = [(c if n == "is_holiday" else F.round(c, 6)).alias(n) for n, c in parts.items()]
    return t(spark, sf_dir, "events").select("event_id", *rounded, F.round(F.col("value") * F.col("value"), 4).alias("square"), F.round(F.col("value") * F.hour("ts"), 4).alias("interaction"))


@query("equipment_features", "WITH " + READINGS_SQL + """
SELECT event_id, round(sum(current_a) OVER f, 6) AS load_sum, round(avg(current_a) OVER f, 6) AS load_mean, max(current_a) OVER f AS load_max, CAST(round(CAST(var_samp(current_a) OVER f AS DECIMAL(30, 10)), 5) AS DOUBLE) AS load_var, abs(voltage_v - 230) AS voltage_off, count(CASE WHEN abs(voltage_v - 230) > 10 THEN 1 END) OVER f AS voltage_faults,
  current_a > quantile_cont(current_a, 0.9) OVER f AS is_peak FROM readings WINDOW f AS (PARTITION BY user_id ORDER BY reading_timestamp, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def equipment_features(spark, sf_dir):
    df = forecast.equipment_features(readings(spark, sf_dir), ["user_id"], ["reading_timestamp", "event_id"], "current_a", "voltage_v")
    return df.select("event_id", r("load_sum_24", "load_sum"), r("load_mean_24", "load_mean"), F.col("load_max_24").alias("load_max"), ladders.fair(F.col("load_var_24"), 5).alias("load_var"), "voltage_off", F.col("voltage_faults_24").alias("voltage_faults"), "is_peak")


@query("rolling_correlation", "WITH " + READINGS_SQL + """
SELECT event_id, round(CASE WHEN count(consumption_kwh) OVER f = 24 THEN corr(temperature_c, consumption_kwh) OVER f END, 5) AS correlation FROM readings WINDOW f AS (PARTITION BY user_id ORDER BY reading_timestamp, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def rolling_correlation(spark, sf_dir):
    f = windows.ordered(["user_id"], ["reading_timestamp", "event_id"]).rowsBetween(-23, 0)
    full = F.count("consumption_kwh").over(f) == 24
    spread = F.stddev_pop("temperature_c").over(f) * F.stddev_pop("consumption_kwh").over(f)
    together = F.try_divide(F.covar_pop("temperature_c", "consumption_kwh").over(f), spread)  # corr fails where a side is constant
    return readings(spark, sf_dir).select("event_id", F.round(F.when(full, together), 5).alias("correlation"))


@query("causal_correlation", """
WITH e AS (SELECT event_id, ts, user_id * 1000 + event_id % 50 AS correlation_id, CASE WHEN event_id % 10 = 0 THEN event_id - 7 END AS causation_id FROM events)
SELECT a.event_id, b.event_id AS related FROM e a JOIN e b ON a.correlation_id = b.correlation_id AND a.event_id <> b.event_id UNION SELECT a.event_id, b.event_id FROM e a JOIN e b ON a.causation_id = b.event_id""")  # fmt: skip
def causal_correlation(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 1000 + F.col("event_id") % 50).alias("correlation_id"), F.when(F.col("event_id") % 10 == 0, F.col("event_id") - 7).alias("causation_id"))
    others = e.select(F.col("event_id").alias("related"), "correlation_id")
    by_id = e.join(others, "correlation_id").filter("event_id <> related").select("event_id", "related")
    by_cause = e.join(others, F.col("causation_id") == F.col("related")).select("event_id", "related")
    return by_id.unionByName(by_cause).distinct()


@query("spatial_correlation", """
WITH p AS (SELECT p_partkey, p_retailprice / 1000 AS lat, p_size / 100 AS lon FROM part)
SELECT a.p_partkey, count(*) AS close FROM p a JOIN p b ON a.p_partkey <> b.p_partkey AND sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) < 0.01 GROUP BY 1""")  # fmt: skip
def spatial_correlation(spark, sf_dir):
    """Places under a hundredth of a degree apart: each different one is entered in its cell and the eight around it."""
    p = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("lat"), (F.col("p_size") / 100).alias("lon"))
    return joins.close_counts(p, "p_partkey", "lat", "lon", 0.01)


@query("correlation_pattern", """
SELECT a.event_id, count(*) AS n, round((least(1.0, count(*) / 5.0) + greatest(0.0, 1 - avg(abs(epoch_us(a.ts) - epoch_us(b.ts))) / 1e6 / 3600)) / 2, 6) AS confidence
FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 GROUP BY 1""")  # fmt: skip
def correlation_pattern(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    other = e.select("user_id", "event_type", F.col("event_id").alias("other"), F.col("ts").alias("other_ts"))
    pairs = joins.interval_join(e, other, ["user_id", "event_type"], "ts", "other_ts", 3600).filter("event_id <> other")
    gap = F.avg(F.abs(joins.seconds("ts") - joins.seconds("other_ts")))
    confidence = (F.least(F.lit(1.0), F.count("*") / 5.0) + F.greatest(F.lit(0.0), 1 - gap / 3600)) / 2
    return pairs.groupBy("event_id").agg(F.count("*").alias("n"), r(confidence, "confidence"))


@query("correlation_contexts", """
SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) >= 3 AND bool_or(event_type = 'view') AND bool_or(event_type = 'click') AS complete, CASE WHEN count(*) >= 3 AND bool_or(event_type = 'view') AND bool_or(event_type = 'click') THEN 1.0 ELSE 0.0 END AS confidence FROM events GROUP BY 1, 2""")
def correlation_contexts(spark, sf_dir):
    e = t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.collect_set("event_type").alias("found"))
    complete = (F.col("n") >= 3) & (F.size(F.array_except(F.array(F.lit("view"), F.lit("click")), "found")) == 0)
    return e.select("user_id", "day", "n", complete.alias("complete"), complete.cast("double").alias("confidence"))


@query("rule_time_patterns", """
WITH g AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events)
SELECT user_id, bool_or(hour(ts) BETWEEN 8 AND 9) AS in_morning, bool_or(isodow(ts) IN (6, 7)) AS on_weekend, coalesce(bool_or(abs(gap / 1e6 - 3600) <= 300), false) AS hourly_gap, coalesce(round(max(gap) / 1e6, 3), 0) AS widest FROM g GROUP BY 1""")  # fmt: skip
def rule_time_patterns(spark, sf_dir):
    w = windows.ordered(["user_id"], ["ts"])
    g = t(spark, sf_dir, "events").withColumn("gap", joins.seconds("ts") - F.lag(joins.seconds("ts")).over(w))
    return g.groupBy("user_id").agg(
        F.bool_or(F.hour("ts").between(8, 9)).alias("in_morning"), F.bool_or(F.weekday("ts") >= 5).alias("on_weekend"),
        F.coalesce(F.bool_or(F.abs(F.col("gap") - 3600) <= 300), F.lit(False)).alias("hourly_gap"), F.coalesce(F.round(F.max("gap"), 3), F.lit(0.0)).alias("widest"),
    )
