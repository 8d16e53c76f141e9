"""Queries of windows over time: row frames, event-time windows, interval joins, event patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltaic.operators import cep, joins, windows
from voltaic.plans.registry import query

BY, ORDER = ["user_id"], ["ts", "event_id"]


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")


def r(c, n=None):
    return F.round(c, 6).alias(n or c)


_W = "PARTITION BY user_id ORDER BY ts, event_id"


@query("win_centred_zscore", f"""
WITH z AS (SELECT event_id, value, avg(value) OVER w AS m, stddev(value) OVER w AS s FROM events WINDOW w AS ({_W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
y AS (SELECT event_id, CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END AS z FROM z)
SELECT event_id, round(z, 6) AS value_z, round(abs(z), 6) AS z_mean, abs(z) > 2 AS is_outlier FROM y""")  # fmt: skip
def win_centred_zscore(spark, sf_dir):
    return windows.centred_anomaly(events(spark, sf_dir), ["value"], BY, ORDER, limit=2.0).select("event_id", r("value_z"), r("z_mean"), "is_outlier")


@query("win_lags", f"""
SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 24) OVER w AS value_lag_24, lead(value, 1) OVER w AS value_lead_1, round(value - lag(value, 1) OVER w, 6) AS value_diff_1, round((value - lag(value, 1) OVER w) / nullif(lag(value, 1) OVER w, 0), 6) AS value_change_1,
  round(avg(value) OVER t, 6) AS value_avg_24, round(stddev(value) OVER t, 6) AS value_std_24
FROM events WINDOW w AS ({_W}), t AS ({_W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def win_lags(spark, sf_dir):
    df = windows.trailing(windows.lags(events(spark, sf_dir), "value", BY, ORDER, ahead=(1,), changes=(1,)), "value", BY, ORDER, 24)
    return df.select("event_id", "value_lag_1", "value_lag_24", "value_lead_1", r("value_diff_1"), r("value_change_1"), r("value_avg_24"), r("value_std_24"))


@query("win_rolling", f"""
WITH f AS (SELECT event_id, count(*) OVER w AS n, avg(value) OVER w AS a, stddev(value) OVER w AS s, min(value) OVER w AS lo, max(value) OVER w AS hi, median(value) OVER w AS md FROM events WINDOW w AS ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN n = 6 THEN round(a, 6) END AS value_mean_6, CASE WHEN n = 6 THEN round(s, 6) END AS value_std_6, CASE WHEN n = 6 THEN lo END AS value_min_6, CASE WHEN n = 6 THEN hi END AS value_max_6, CASE WHEN n = 6 THEN round(md, 6) END AS value_median_6 FROM f""")  # fmt: skip
def win_rolling(spark, sf_dir):
    return windows.rolling(events(spark, sf_dir), "value", BY, ORDER, 6).select("event_id", r("value_mean_6"), r("value_std_6"), "value_min_6", "value_max_6", r("value_median_6"))


@query("win_latest", f"SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def win_latest(spark, sf_dir):
    return windows.latest(events(spark, sf_dir), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("win_ewm", f"""
WITH s AS (SELECT event_id, list(value) OVER ({_W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS v FROM events),
e AS (SELECT event_id, unnest(v) AS x, len(v) - unnest(generate_series(1, len(v))) AS age FROM s)
SELECT event_id, round(sum(x * pow(0.7::DOUBLE, age)) / sum(pow(0.7::DOUBLE, age)), 6) AS value_ewm FROM e GROUP BY 1""")  # fmt: skip
def win_ewm(spark, sf_dir):
    return windows.ewm(events(spark, sf_dir), "value", BY, ORDER, 0.3).select("event_id", r("value_ewm"))


@query("win_sliding_trend", f"""
WITH n AS (SELECT *, CAST(row_number() OVER ({_W}) AS DOUBLE) AS n FROM events)
SELECT event_id, CASE WHEN n >= 10 THEN round(regr_slope(value, n) OVER w, 6) END AS slope, CASE WHEN n >= 10 THEN round(regr_r2(value, n) OVER w, 6) END AS r2 FROM n WINDOW w AS ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def win_sliding_trend(spark, sf_dir):
    return windows.sliding_trend(events(spark, sf_dir), "value", BY, ORDER, 10).select("event_id", r("slope"), r("r2"))


@query("win_global_outliers", """
WITH s AS (SELECT avg(value) AS m, stddev(value) AS s, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
k AS (SELECT event_id, value, rank() OVER (ORDER BY value) AS r, count(*) OVER (PARTITION BY value) AS t FROM events)
SELECT event_id, round((value - m) / s, 6) AS z, round((r - 1 + (t + 1) / 2) / n, 6) AS pct_rank, value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5 AS is_iqr_outlier FROM k, s""")  # fmt: skip
def win_global_outliers(spark, sf_dir):
    return windows.global_outliers(events(spark, sf_dir), "value").select("event_id", r("z"), r("pct_rank"), "is_iqr_outlier")


@query("win_partition_average", "SELECT event_id, CASE WHEN value > 1.5 * avg(value) OVER (PARTITION BY user_id) THEN 'HIGH' WHEN value < 0.5 * avg(value) OVER (PARTITION BY user_id) THEN 'LOW' ELSE 'NORMAL' END AS level FROM events")
def win_partition_average(spark, sf_dir):
    mean = F.avg("value").over(Window.partitionBy("user_id"))
    return events(spark, sf_dir).select("event_id", F.when(F.col("value") > 1.5 * mean, "HIGH").when(F.col("value") < 0.5 * mean, "LOW").otherwise("NORMAL").alias("level"))


@query("win_ranking", """
SELECT event_id, CAST(rank() OVER w AS INTEGER) AS rnk, CAST(dense_rank() OVER w AS INTEGER) AS dense, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id) AS INTEGER) AS quarter, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_event
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value)""")  # fmt: skip
def win_ranking(spark, sf_dir):
    w, u = Window.partitionBy("user_id").orderBy("value"), Window.partitionBy("user_id").orderBy("value", "event_id")
    return events(spark, sf_dir).select("event_id", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"), r(F.percent_rank().over(w), "pr"), r(F.cume_dist().over(w), "cd"), F.ntile(4).over(u).alias("quarter"), F.first("event_id").over(windows.ordered(BY, ORDER)).alias("first_event"))


@query("time_tumbling", "SELECT user_id, time_bucket(INTERVAL 6 HOURS, ts) AS start, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(median(value), 6) AS med, round(coalesce(stddev(value), 0), 6) AS sd FROM events GROUP BY 1, 2")
def time_tumbling(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("user_id", F.window("ts", "6 hours").alias("w"))
    out = g.agg(F.count("*").alias("n"), r(F.sum("value"), "total"), r(F.avg("value"), "mean"), F.min("value").alias("low"), F.max("value").alias("high"), r(F.median("value"), "med"), r(F.coalesce(F.stddev("value"), F.lit(0.0)), "sd"))
    return out.withColumn("start", F.col("w.start").cast("timestamp_ntz")).drop("w")


@query("time_sliding", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2")
def time_sliding(spark, sf_dir):
    out = events(spark, sf_dir).groupBy("event_type", F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), r(F.sum("value"), "total"))
    return out.withColumn("start", F.col("w.start").cast("timestamp_ntz")).drop("w")


@query("time_session", f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER ({_W}) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER ({_W}) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, s""")  # fmt: skip
def time_session(spark, sf_dir):
    out = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"), r(F.sum("value"), "total"))
    return out.withColumn("start", F.col("w.start").cast("timestamp_ntz")).drop("w")


def _sides(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    return left, right


for _how in ("inner", "left", "right", "full"):

    @query(f"join_interval_{_how}", f"""
WITH l AS (SELECT user_id, event_id AS error_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, event_id AS purchase_id, ts FROM events WHERE event_type = 'purchase')
SELECT coalesce(l.user_id, p.user_id) AS user_id, error_id, purchase_id FROM l {_how if _how != 'inner' else ''} JOIN p ON l.user_id = p.user_id AND abs(epoch_us(l.ts) - epoch_us(p.ts)) <= 7200000000""")  # fmt: skip
    def join_interval(spark, sf_dir, how=_how):
        left, right = _sides(spark, sf_dir)
        return joins.interval_join(left, right, ["user_id"], "error_ts", "purchase_ts", 7200, how).select("user_id", "error_id", "purchase_id")


@query("join_asof", """
WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT event_id, (SELECT arg_max(p.value, p.ts) FROM p WHERE p.user_id = e.user_id AND p.ts <= e.ts) AS last_purchase FROM events e WHERE event_type = 'error'""")  # fmt: skip
def join_asof(spark, sf_dir):
    e = events(spark, sf_dir)
    p = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), F.col("value").alias("last_purchase"))
    return joins.asof_join(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "p_ts", "last_purchase").select("event_id", "last_purchase")


@query("cep_sequence", f"""
WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER ({_W}) AS n FROM events),
a AS (SELECT user_id, min(n) AS n1 FROM s WHERE event_type = 'signup' GROUP BY 1),
b AS (SELECT a.user_id, n1, min(n) AS n2 FROM a LEFT JOIN s ON s.user_id = a.user_id AND n > n1 AND event_type = 'click' GROUP BY 1, 2),
c AS (SELECT b.user_id, n1, n2, min(n) AS n3 FROM b LEFT JOIN s ON s.user_id = b.user_id AND n > n2 AND event_type = 'purchase' GROUP BY 1, 2, 3)
SELECT u.user_id, CAST((n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT + (n3 IS NOT NULL)::INT AS INTEGER) AS matched, round(((n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT + (n3 IS NOT NULL)::INT) / 3, 6) AS confidence FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c USING (user_id)""")  # fmt: skip
def cep_sequence(spark, sf_dir):
    return cep.sequence(events(spark, sf_dir), ["user_id"], "ts", "event_id", "event_type", ["signup", "click", "purchase"]).select("user_id", "matched", r("confidence"))


@query("cep_frequency", """
SELECT event_id, count(*) OVER w AS n, count(*) FILTER (event_type = 'error') OVER w AS errors, count(*) OVER w BETWEEN 3 AND 50 AND count(*) FILTER (event_type = 'error') OVER w >= 1 AS matches
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")  # fmt: skip
def cep_frequency(spark, sf_dir):
    return cep.frequency(events(spark, sf_dir), ["user_id"], "ts", "event_type", 86400, 3, 50, {"error": 1}).select("event_id", "n", F.col("n_error").alias("errors"), "matches")


@query("cep_anomaly", """
WITH s AS (SELECT event_id, value, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING))
SELECT event_id, n, n >= 5 AND coalesce(CASE WHEN sd > 0 THEN abs(value - m) / sd > 2 ELSE value <> m END, false) AS is_anomaly FROM s""")  # fmt: skip
def cep_anomaly(spark, sf_dir):
    return cep.anomaly(events(spark, sf_dir), ["user_id"], "ts", "value", 7 * 86400).select("event_id", "n", "is_anomaly")


@query("cep_cyclic", """
WITH b AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS b FROM events WHERE event_type = 'view'), g AS (SELECT *, b - lag(b) OVER (PARTITION BY user_id ORDER BY b) AS gap FROM b)
SELECT user_id, count(*) AS periods, max(abs(gap - 1)) AS worst, count(*) >= 6 AND coalesce(max(abs(gap - 1)) <= 1, false) AS matches FROM g GROUP BY 1""")  # fmt: skip
def cep_cyclic(spark, sf_dir):
    return cep.cyclic(events(spark, sf_dir).filter("event_type = 'view'"), ["user_id"], "ts", 86400, 1.0, 6).select("user_id", "periods", "worst", "matches")


@query("cep_threshold", """
SELECT event_id, value < 20 OR value > 400 AS violates, round(least(1.0::DOUBLE, CASE WHEN value < 20 THEN 2 * (20 - value) / 20 WHEN value > 400 THEN 2 * (value - 400) / 400 ELSE 0 END), 6) AS confidence FROM events""")  # fmt: skip
def cep_threshold(spark, sf_dir):
    return cep.threshold(events(spark, sf_dir), "value", 20, 400).select("event_id", "violates", r("confidence"))


@query("cep_trend", f"""
WITH s AS (SELECT user_id, value, row_number() OVER ({_W}) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events), h AS (SELECT user_id, max(c) AS c, avg(value) FILTER (n <= c // 2) AS a, avg(value) FILTER (n > c // 2) AS b FROM s GROUP BY 1)
SELECT user_id, CASE WHEN c < 2 THEN 'stable' WHEN b > a * 1.1 THEN 'increasing' WHEN b < a * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend FROM h""")  # fmt: skip
def cep_trend(spark, sf_dir):
    return cep.trend(events(spark, sf_dir), ["user_id"], "ts", "event_id", "value").select("user_id", "trend")


@query("cep_rules", """
SELECT user_id, bool_or(event_type = 'error' AND value > 400) AND bool_or(event_type = 'purchase') AS conditional, max(epoch(ts)) - min(epoch(ts)) <= 2592000 AND count(*) BETWEEN 2 AND 100000 AS temporal, sum(value) >= 5000 AS aggregation, bool_or(value > 480) AS threshold,
  bool_or(hour(ts) = 9) AS at_nine, bool_or(isodow(ts) = 1) AS on_monday FROM events GROUP BY 1""")  # fmt: skip
def cep_rules(spark, sf_dir):
    v, t = F.col("value"), F.col("event_type")
    rules = {
        "conditional": cep.every_condition([(t == "error") & (v > 400), t == "purchase"]),
        "temporal": cep.span_within("ts", 2592000) & F.count("*").between(2, 100000),
        "aggregation": F.sum("value") >= 5000,
        "threshold": F.bool_or(v > 480),
        "at_nine": F.bool_or(F.hour("ts") == 9),
        "on_monday": F.bool_or(F.weekday("ts") == 0),
    }
    return cep.rules(events(spark, sf_dir), ["user_id"], rules)
