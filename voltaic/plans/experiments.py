"""Queries of model inputs, drift, risks and predictions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from voltaic.functions import ladders
from voltaic.operators import drift, learning, sourcing, windows
from voltaic.plans.readings import READINGS_SQL, readings
from voltaic.plans.registry import query


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, n=None):
    return F.round(c, 6).alias(n or c)


def _halves(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("x", F.col("value"))
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    return e.filter(~late), e.filter(late)


@query("nearest_fill", "WITH " + READINGS_SQL + """,
m AS (SELECT event_id, user_id, power_factor + event_id / 1e6 AS x FROM readings WHERE voltage_v IS NULL), k AS (SELECT user_id, power_factor + event_id / 1e6 AS x, voltage_v AS v FROM readings WHERE voltage_v IS NOT NULL),
p AS (SELECT m.event_id, v, row_number() OVER (PARTITION BY m.event_id ORDER BY abs(k.x - m.x), v) AS n FROM m JOIN k USING (user_id)), f AS (SELECT event_id, avg(v) AS v FROM p WHERE n <= 5 GROUP BY 1)
SELECT event_id, round(coalesce(voltage_v, f.v), 6) AS voltage FROM readings LEFT JOIN f USING (event_id)""")  # fmt: skip
def nearest_fill(spark, sf_dir):
    df = readings(spark, sf_dir).select("event_id", "user_id", "voltage_v", (F.col("power_factor") + F.col("event_id") / 1e6).alias("x"))
    return learning.nearest_fill(df, "voltage_v", "x", ["user_id"], "event_id").select("event_id", r("voltage_v", "voltage"))


@query("drift_wasserstein", """
WITH u AS (SELECT value AS x, (ts < TIMESTAMP '2024-01-15')::INT AS ref FROM events), c AS (SELECT x, sum(ref) AS r, sum(1 - ref) AS c FROM u GROUP BY 1),
g AS (SELECT abs(sum(r) OVER w / sum(r) OVER () - sum(c) OVER w / sum(c) OVER ()) * (lead(x) OVER (ORDER BY x) - x) AS a FROM c WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT round(sum(a), 6) AS wasserstein FROM g""")  # fmt: skip
def drift_wasserstein(spark, sf_dir):
    return drift.wasserstein(*_halves(spark, sf_dir), "x").select(r("wasserstein"))


@query("ab_rank_test", """
WITH v AS (SELECT event_id % 2 = 1 AS b, value AS x FROM events), k AS (SELECT b, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rk FROM v),
s AS (SELECT count(*) FILTER (NOT b) AS n_a, count(*) FILTER (b) AS n_b, sum(rk) FILTER (NOT b) AS sm FROM k), u AS (SELECT n_a, n_b, sm - n_a * (n_a + 1) / 2.0::DOUBLE AS u FROM s)
SELECT n_a, n_b, round(u, 3) AS u, round((u - n_a * n_b / 2.0::DOUBLE) / sqrt(n_a * n_b * (n_a + n_b + 1) / 12.0::DOUBLE), 6) AS z FROM u""")  # fmt: skip
def ab_rank_test(spark, sf_dir):
    return drift.rank_test(t(spark, sf_dir, "events"), F.col("event_id") % 2 == 1, "value").select("n_a", "n_b", F.round("u", 3).alias("u"), r("z"))


@query("drift_performance", """
WITH p AS (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS guess FROM events), e AS (SELECT avg(abs(value - guess)) AS mae, sqrt(avg((value - guess) ** 2)) AS rmse FROM p)
SELECT round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(greatest((mae - 10) / 10, (rmse - 15) / 15), 6) AS degradation, greatest((mae - 10) / 10, (rmse - 15) / 15) > 0.05 AS has_drift FROM e""")  # fmt: skip
def drift_performance(spark, sf_dir):
    df = windows.lags(t(spark, sf_dir, "events"), "value", ["user_id"], ["ts", "event_id"], steps=(1,))
    return drift.performance_drift(df, "value", "value_lag_1").select(r("mae"), r("rmse"), r("degradation"), "has_drift")


@query("feature_validation", """
SELECT ts >= TIMESTAMP '2024-01-15' AS late, count(value) AS n, round(avg(value), 5) AS mean, round(stddev(value), 5) AS std, round(avg(((value - m) / s) ** 3), 5) AS skew, round(avg(((value - m) / s) ** 4) - 3, 5) AS kurtosis
FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY ts >= TIMESTAMP '2024-01-15')) GROUP BY 1""")  # fmt: skip
def feature_validation(spark, sf_dir):
    shapes = drift.half_shapes(t(spark, sf_dir, "events"), "value", F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return shapes.select("late", "n", *[F.round(c, 5).alias(c) for c in ("mean", "std", "skew", "kurtosis")])


@query("feature_latest", """
SELECT user_id, event_type AS feature, round(arg_max(value, (ts, event_id)), 6) AS value, max(ts) AS at, count(*) AS versions FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def feature_latest(spark, sf_dir):
    """The feature store's latest values as of a time: the time range counts for what is returned."""
    past = t(spark, sf_dir, "events").withColumnRenamed("event_type", "feature").filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    p = sourcing.project(past, ["user_id", "feature"], ["ts", "event_id"], {"value": "value", "at": "ts"})
    return p.select("user_id", "feature", r("value"), "at", F.col("version").alias("versions"))


@query("multivariate_distance", "WITH " + READINGS_SQL + """,
s AS (SELECT avg(voltage_v) AS ma, avg(frequency_hz) AS mb, var_samp(voltage_v) AS va, var_samp(frequency_hz) AS vb, covar_samp(voltage_v, frequency_hz) AS c FROM readings WHERE voltage_v IS NOT NULL AND frequency_hz IS NOT NULL)
SELECT event_id, round(sqrt(((voltage_v - ma) ** 2 * vb - 2 * (voltage_v - ma) * (frequency_hz - mb) * c + (frequency_hz - mb) ** 2 * va) / (va * vb - c * c)), 5) AS distance FROM readings, s""")  # fmt: skip
def multivariate_distance(spark, sf_dir):
    return learning.mahalanobis(readings(spark, sf_dir).select("event_id", "voltage_v", "frequency_hz"), "voltage_v", "frequency_hz").select("event_id", F.round("distance", 5).alias("distance"))


@query("risk_portfolio", "WITH " + READINGS_SQL + """,
f AS (SELECT 'voltage' AS factor, count(*) FILTER (abs(voltage_v - 230) > 20) / count(*) AS probability, 0.8::DOUBLE AS impact FROM readings UNION ALL SELECT 'temperature', count(*) FILTER (temperature_c > 35) / count(*), 0.6 FROM readings UNION ALL SELECT 'missing', count(*) FILTER (voltage_v IS NULL OR frequency_hz IS NULL) / count(*), 0.3 FROM readings)
SELECT factor, round(probability, 6) AS probability, impact, round(probability * impact, 6) AS risk FROM f""")  # fmt: skip
def risk_portfolio(spark, sf_dir):
    c = F.col
    factors = {"voltage": (F.abs(c("voltage_v") - 230) > 20, 0.8), "temperature": (c("temperature_c") > 35, 0.6), "missing": (c("voltage_v").isNull() | c("frequency_hz").isNull(), 0.3)}
    return learning.risk_portfolio(readings(spark, sf_dir), factors).select("factor", r("probability"), "impact", r("risk"))


@query("demand_prediction", "WITH " + READINGS_SQL + """,
h AS (SELECT date_trunc('hour', reading_timestamp) AS hour, avg(temperature_c) AS temp, sum(consumption_kwh) AS kwh FROM readings GROUP BY 1), c AS (SELECT coalesce(corr(temp, kwh), 0) AS k FROM h WHERE kwh IS NOT NULL)
SELECT hour AS date_hour, round(1000 + temp * k * 50, 4) AS demand FROM h, c""")  # fmt: skip
def demand_prediction(spark, sf_dir):
    h = readings(spark, sf_dir).groupBy(F.date_trunc("hour", "reading_timestamp").cast("timestamp_ntz").alias("date_hour")).agg(F.avg("temperature_c").alias("t"), F.sum("consumption_kwh").alias("kwh"))
    together = h.agg(F.coalesce(F.corr("t", "kwh"), F.lit(0.0)).alias("k"))  # one row
    return h.crossJoin(F.broadcast(together)).select("date_hour", F.round(1000 + F.col("t") * F.col("k") * 50, 4).alias("demand"))


@query("load_ensemble", """
WITH w AS (SELECT event_id, lag(value) OVER o AS last, avg(value) OVER (o ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(round(CAST(CASE WHEN mean IS NOT NULL THEN (last * 0.4 + mean * 0.6) / 1.0 END AS DECIMAL(30, 10)), 5) AS DOUBLE) AS predicted FROM w""")  # fmt: skip
def load_ensemble(spark, sf_dir):
    keys, order = ["user_id"], ["ts", "event_id"]
    df = windows.lags(windows.trailing(t(spark, sf_dir, "events"), "value", keys, order, 5), "value", keys, order, steps=(1,))
    return df.select("event_id", ladders.fair(learning.ensemble({"value_lag_1": 0.4, "value_avg_5": 0.6}), 5).alias("predicted"))


@query("failure_risk")
def failure_risk(spark, sf_dir):
    """A forest's risk of failure of every reading, learnt from four fifths of the readings."""
    names = ["voltage_v", "current_a", "temperature_c", "frequency_hz"]
    df = readings(spark, sf_dir).select("event_id", *names, ((F.col("voltage_v") > 250) & (F.col("temperature_c") > 20)).cast("double").alias("failed")).dropna()
    model = learning.classifier("forest", names, "failed").fit(df.filter(F.crc32(F.col("event_id").cast("string")) % 5 != 0))
    return learning.probability(model.transform(df)).select("event_id", "failed", F.round("risk", 4).alias("risk"))


@query("component_drift")
def component_drift(spark, sf_dir):
    names = ["voltage_v", "frequency_hz", "current_a"]
    df = readings(spark, sf_dir)
    late = F.col("reading_timestamp") >= F.lit("2024-01-15").cast("timestamp_ntz")
    return learning.component_drift(df.filter(~late).select(*names), df.filter(late).select(*names), names)


@query("cluster_anomalies")
def cluster_anomalies(spark, sf_dir):
    names = ["voltage_v", "current_a", "temperature_c"]
    return learning.cluster_distances(readings(spark, sf_dir).select("event_id", *names), names).select("event_id", "cluster", "distance", "is_anomaly")


@query("selected_features")
def selected_features(spark, sf_dir):
    names = ["voltage_v", "current_a", "temperature_c", "humidity"]
    df = readings(spark, sf_dir).select("event_id", *names, "consumption_kwh").fillna(0.0)
    return learning.best_features(names, "consumption_kwh", 2).fit(df).transform(df).select("event_id", vector_to_array("features").alias("features"))


@query("encoded_categories", "WITH " + READINGS_SQL + """,
a AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS k FROM readings GROUP BY 1), b AS (SELECT tariff_type, row_number() OVER (ORDER BY count(*) DESC, tariff_type) AS k FROM readings GROUP BY 1)
SELECT event_id, CAST(a.k AS BIGINT) AS event_type, CAST(b.k AS BIGINT) AS tariff_type, (SELECT count(*) FROM a) AS width FROM readings JOIN a USING (event_type) JOIN b USING (tariff_type)""")  # fmt: skip
def encoded_categories(spark, sf_dir):
    df = readings(spark, sf_dir).select("event_id", "event_type", "tariff_type")
    out = learning.encoded(["event_type", "tariff_type"]).fit(df).transform(df)
    place = lambda c: F.array_position(vector_to_array(f"{c}_vector"), 1.0).cast("long").alias(c)  # noqa: E731  where the one stands
    return out.select("event_id", place("event_type"), place("tariff_type"), F.size(vector_to_array("event_type_vector")).cast("long").alias("width"))
