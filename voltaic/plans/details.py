"""Queries of the fuller staging models, entity classes, comparison operators, windows, neighbours, recency and confidences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from voltaic.functions import energy, filters, ladders
from voltaic.operators import windows
from voltaic.plans.climate import OBSERVED_SQL, observed
from voltaic.plans.overview import GRID_SQL, grid_states
from voltaic.plans.readings import READINGS_SQL, readings
from voltaic.plans.registry import query


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, n=None):
    return F.round(c, 6).alias(n or c)


WEATHER_SQL = OBSERVED_SQL + """,
v AS (SELECT event_id, t * 2 AS t, h + 10 AS h, hpa * 1.1::DOUBLE AS hpa, w - 1 AS w, CAST(event_id % 400 AS DOUBLE) AS dir, p, km - 0.5 AS km, CAST(event_id % 120 AS DOUBLE) AS cloud, CAST(event_id % 18 AS DOUBLE) AS uv FROM o)"""  # fmt: skip


def wide_weather(spark, sf_dir):
    i, c = F.col("event_id"), F.col
    cast = lambda x: x.cast("double")
    return observed(spark, sf_dir).select("event_id", (c("t") * 2).alias("t"), (c("h") + 10).alias("h"), (c("hpa") * 1.1).alias("hpa"), (c("w") - 1).alias("w"), cast(i % 400).alias("dir"), "p", (c("km") - 0.5).alias("km"), cast(i % 120).alias("cloud"), cast(i % 18).alias("uv"))


@query("stg_weather_full", "WITH " + WEATHER_SQL + """,
f AS (SELECT *, t BETWEEN -50 AND 60 AS ok_t, h BETWEEN 0 AND 100 AS ok_h, hpa BETWEEN 800 AND 1100 AS ok_hpa, w >= 0 AS ok_w, dir BETWEEN 0 AND 360 AS ok_dir, p >= 0 AS ok_p, km >= 0 AS ok_km, cloud BETWEEN 0 AND 100 AS ok_cloud, uv BETWEEN 0 AND 15 AS ok_uv FROM v)
SELECT event_id, ok_t, ok_h, ok_hpa, ok_w, ok_dir, ok_p, ok_km, ok_cloud, ok_uv, CASE WHEN ok_t AND ok_h AND ok_hpa AND ok_w AND ok_dir THEN 'EXCELLENT' WHEN ok_t AND ok_h AND ok_hpa THEN 'GOOD' WHEN ok_t AND ok_h THEN 'FAIR' ELSE 'POOR' END AS tier,
  CASE WHEN w < 1 THEN 'CALM' WHEN w < 5 THEN 'LIGHT' WHEN w < 10 THEN 'MODERATE' WHEN w < 20 THEN 'STRONG' ELSE 'VERY_STRONG' END AS wind_category,
  CASE WHEN p > 0 AND w > 10 THEN 'STORMY' WHEN p > 5 THEN 'HEAVY_RAIN' WHEN p > 0 THEN 'RAINY' WHEN cloud > 80 THEN 'CLOUDY' WHEN cloud > 50 THEN 'PARTLY_CLOUDY' WHEN cloud > 20 THEN 'MOSTLY_CLEAR' ELSE 'CLEAR' END AS condition,
  CAST((NOT ok_t)::INT + (NOT ok_h)::INT + (NOT ok_hpa)::INT + (NOT ok_w)::INT + (NOT ok_dir)::INT + (NOT ok_p)::INT + (NOT ok_km)::INT + (NOT ok_cloud)::INT + (NOT ok_uv)::INT AS BIGINT) AS issues FROM f""")  # fmt: skip
def stg_weather_full(spark, sf_dir):
    c = F.col
    ranges = {"t": (-50, 60), "h": (0, 100), "hpa": (800, 1100), "w": (0, None), "dir": (0, 360), "p": (0, None), "km": (0, None), "cloud": (0, 100), "uv": (0, 15)}
    ok = {n: F.coalesce(c(n) >= lo, F.lit(True)) if hi is None else ladders.in_range(c(n), lo, hi) for n, (lo, hi) in ranges.items()}
    first = lambda n: reduce(ladders.and_, list(ok.values())[:n])
    rain = [((c("p") > 0) & (c("w") > 10), "STORMY"), (c("p") > 5, "HEAVY_RAIN"), (c("p") > 0, "RAINY"), (c("cloud") > 80, "CLOUDY"), (c("cloud") > 50, "PARTLY_CLOUDY"), (c("cloud") > 20, "MOSTLY_CLEAR")]
    return wide_weather(spark, sf_dir).select(
        "event_id", *[x.alias(f"ok_{n}") for n, x in ok.items()], ladders.first_match([(first(5), "EXCELLENT"), (first(3), "GOOD"), (first(2), "FAIR")], "POOR").alias("tier"),
        F.when(c("w").isNull(), "UNKNOWN").otherwise(ladders.below(c("w"), [(1, "CALM"), (5, "LIGHT"), (10, "MODERATE"), (20, "STRONG")], "VERY_STRONG")).alias("wind_category"),
        ladders.first_match(rain, "CLEAR").alias("condition"), ladders.issue_count(ok).cast("long").alias("issues"),
    )


@query("stg_weather_older", "WITH " + WEATHER_SQL + """
SELECT event_id, CASE WHEN cloud < 25 THEN 'clear' WHEN cloud < 50 THEN 'partly_cloudy' WHEN cloud < 75 THEN 'mostly_cloudy' ELSE 'overcast' END AS cloud_category, round(CASE WHEN t >= 27 AND h >= 40 THEN t + 0.5 * (h - 40) ELSE t END, 6) AS heat_index, round(CASE WHEN t <= 10 AND w > 4.8 THEN t - (w - 4.8) * 2 ELSE t END, 6) AS wind_chill,
  CASE WHEN f > 1.5 THEN 'high_demand' WHEN f > 1.2 THEN 'elevated_demand' WHEN f < 0.8 THEN 'low_demand' ELSE 'normal_demand' END AS demand_category FROM (SELECT *, round(greatest(0.5, least(2.0, 1 + CASE WHEN t < 15 THEN (15 - t) * 0.02 WHEN t > 25 THEN (t - 25) * 0.03 ELSE 0 END + CASE WHEN h > 70 THEN 0.1 ELSE 0 END + CASE WHEN w > 10 THEN 0.05 ELSE 0 END + CASE WHEN cloud > 80 THEN 0.1 ELSE 0 END)), 9) AS f FROM v)""")  # fmt: skip
def stg_weather_older(spark, sf_dir):
    c = F.col
    factor = F.round(energy.demand_factor(c("t"), c("h"), c("w"), c("cloud")), 9)
    heat = F.when((c("t") >= 27) & (c("h") >= 40), c("t") + 0.5 * (c("h") - 40)).otherwise(c("t"))
    chill = F.when((c("t") <= 10) & (c("w") > 4.8), c("t") - (c("w") - 4.8) * 2).otherwise(c("t"))
    demand = ladders.first_match([(factor > 1.5, "high_demand"), (factor > 1.2, "elevated_demand"), (factor < 0.8, "low_demand")], "normal_demand")
    cloud = ladders.below(c("cloud"), [(25, "clear"), (50, "partly_cloudy"), (75, "mostly_cloudy")], "overcast")
    return wide_weather(spark, sf_dir).select("event_id", cloud.alias("cloud_category"), r(heat, "heat_index"), r(chill, "wind_chill"), demand.alias("demand_category"))


@query("stg_readings_older", "WITH " + READINGS_SQL + """
SELECT event_id, coalesce(frequency_hz, 50.0) AS frequency, round(voltage_v * current_a, 6) AS apparent_va, round(voltage_v * current_a * power_factor, 6) AS real_w, CASE WHEN quality_score >= 0.9 THEN 'high' WHEN quality_score >= 0.7 THEN 'medium' ELSE 'low' END AS quality_tier,
  coalesce(consumption_kwh < 0, false) AS negative, coalesce(voltage_v < 200 OR voltage_v > 250, false) AS voltage_anomaly, current_a < 0 OR current_a > 100 AS current_anomaly FROM readings""")  # fmt: skip
def stg_readings_older(spark, sf_dir):
    c = F.col
    flag = lambda x, n: F.coalesce(x, F.lit(False)).alias(n)
    return readings(spark, sf_dir).select(
        "event_id", F.coalesce("frequency_hz", F.lit(50.0)).alias("frequency"), r(c("voltage_v") * c("current_a"), "apparent_va"), r(c("voltage_v") * c("current_a") * c("power_factor"), "real_w"),
        ladders.at_least(c("quality_score"), [(0.9, "high"), (0.7, "medium")], "low").alias("quality_tier"), flag(c("consumption_kwh") < 0, "negative"),
        flag((c("voltage_v") < 200) | (c("voltage_v") > 250), "voltage_anomaly"), flag((c("current_a") < 0) | (c("current_a") > 100), "current_anomaly"),
    )


@query("batch_ingest", "WITH " + READINGS_SQL + """,
s AS (SELECT event_id, ((coalesce(consumption_kwh BETWEEN 0 AND 1000, false))::INT + (coalesce(voltage_v BETWEEN 200 AND 250, false))::INT + (current_a BETWEEN 0 AND 10)::INT + (power_factor BETWEEN 0.8 AND 1)::INT + (coalesce(frequency_hz BETWEEN 49.5 AND 50.5, false))::INT + (temperature_c BETWEEN -10 AND 40)::INT) / 6 AS score FROM readings)
SELECT event_id, round(score, 6) AS score FROM s WHERE score >= 0.5""")  # fmt: skip
def batch_ingest(spark, sf_dir):
    """Readings scored by the share of their ranges that hold; those under a half are left out."""
    ranges = {"consumption_kwh": (0, 1000), "voltage_v": (200, 250), "current_a": (0, 10), "power_factor": (0.8, 1), "frequency_hz": (49.5, 50.5), "temperature_c": (-10, 40)}
    held = [F.coalesce(F.col(n).between(*b), F.lit(False)).cast("int") for n, b in ranges.items()]
    return readings(spark, sf_dir).select("event_id", (sum(held[1:], held[0]) / 6).alias("score")).filter("score >= 0.5").select("event_id", r("score"))


@query("entity_classes", "WITH " + GRID_SQL + """
SELECT event_id, CASE WHEN u < 0.1 THEN 'Very Low' WHEN u < 0.3 THEN 'Low' WHEN u < 0.7 THEN 'Normal' WHEN u < 0.9 THEN 'High' ELSE 'Critical' END AS capacity_status, CASE WHEN s >= 0.9 THEN 'Excellent' WHEN s >= 0.8 THEN 'Good' WHEN s >= 0.7 THEN 'Fair' WHEN s >= 0.5 THEN 'Poor' ELSE 'Critical' END AS stability_status,
  CASE WHEN temperature_c < 0 THEN 'freezing' WHEN temperature_c < 10 THEN 'cold' WHEN temperature_c < 20 THEN 'cool' WHEN temperature_c < 30 THEN 'warm' ELSE 'hot' END AS weather_category FROM (SELECT g.event_id, load_mw / capacity_mw AS u, efficiency_percent / 100 AS s, temperature_c FROM grid g JOIN readings USING (event_id))""")  # fmt: skip
def entity_classes(spark, sf_dir):
    c = F.col
    g = grid_states(spark, sf_dir).join(readings(spark, sf_dir).select("event_id", "temperature_c"), "event_id")
    return g.select(
        "event_id", ladders.below(F.try_divide(c("load_mw"), c("capacity_mw")), [(0.1, "Very Low"), (0.3, "Low"), (0.7, "Normal"), (0.9, "High")], "Critical").alias("capacity_status"),
        ladders.at_least(c("efficiency_percent") / 100, [(0.9, "Excellent"), (0.8, "Good"), (0.7, "Fair"), (0.5, "Poor")], "Critical").alias("stability_status"),
        ladders.below(c("temperature_c"), [(0, "freezing"), (10, "cold"), (20, "cool"), (30, "warm")], "hot").alias("weather_category"),
    )


@query("filter_operators", """
SELECT event_id, event_type = 'click' AS eq, event_type <> 'click' AS ne, value > 100 AS gt, value >= 100.5 AS gte, value < 100 AS lt, value <= 100.5 AS lte, event_type IN ('click', 'view') AS in_, event_type NOT IN ('click', 'view') AS not_in, contains(event_type, 'ur') AS contains, regexp_matches(event_type, 'c.*k|^v') AS regex, true AS unknown FROM events""")  # fmt: skip
def filter_operators(spark, sf_dir):
    """Every comparison by its name, as rules state them; an operator that isn't known holds."""
    tests = {"eq": ("event_type", "click"), "ne": ("event_type", "click"), "gt": ("value", 100), "gte": ("value", 100.5), "lt": ("value", 100), "lte": ("value", 100.5), "in": ("event_type", ["click", "view"]), "not_in": ("event_type", ["click", "view"]), "contains": ("event_type", "ur"), "regex": ("event_type", "c.*k|^v"), "unknown": ("value", 1)}
    named = [filters.compare(F.col(c), op, v).alias("in_" if op == "in" else op) for op, (c, v) in tests.items()]
    return t(spark, sf_dir, "events").select("event_id", *named)


@query("feature_bins", "WITH " + READINGS_SQL + """
SELECT event_id, round(consumption_kwh ** 2, 4) AS square, round(consumption_kwh ** 3, 3) AS cube, round(consumption_kwh * temperature_c, 4) AS product, greatest(0, 18 - temperature_c) AS heating, greatest(0, temperature_c - 25) AS cooling, CASE WHEN temperature_c <= 0 THEN 'freezing' WHEN temperature_c <= 10 THEN 'cold' WHEN temperature_c <= 20 THEN 'mild' WHEN temperature_c <= 30 THEN 'warm' ELSE 'hot' END AS bin FROM readings""")  # fmt: skip
def feature_bins(spark, sf_dir):
    """Powers, a product, degree days, and bins closed on the right."""
    c = F.col
    k, days = c("consumption_kwh"), energy.degree_days(c("temperature_c"))
    bins = ladders.first_match([(c("temperature_c") <= b, n) for b, n in ((0, "freezing"), (10, "cold"), (20, "mild"), (30, "warm"))], "hot")
    return readings(spark, sf_dir).select("event_id", F.round(k * k, 4).alias("square"), F.round(k * k * k, 3).alias("cube"), F.round(k * c("temperature_c"), 4).alias("product"), days["heating_degrees"].alias("heating"), days["cooling_degrees"].alias("cooling"), bins.alias("bin"))


def _window_sql(source: str, key: str, columns: list[str]) -> str:
    parts = [f"lag({c}) OVER o AS {c}_lag, round(avg({c}) OVER d, 5) AS {c}_mean, round(stddev({c}) OVER d, 5) AS {c}_std, round(CASE WHEN stddev({c}) OVER z > 0 THEN abs({c} - avg({c}) OVER z) / stddev({c}) OVER z ELSE 0 END, 5) AS {c}_z" for c in columns]
    order = f"PARTITION BY {key} ORDER BY ts, event_id"
    return f"SELECT event_id, {', '.join(parts)} FROM {source} WINDOW o AS ({order}), d AS ({order} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), z AS ({order} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"


def _windowed(df, key: str, columns: list[str]):
    w = windows.ordered([key], ["ts", "event_id"])
    day, around = w.rowsBetween(-24, -1), w.rowsBetween(-10, 10)
    parts = []
    for c in columns:
        spread = F.stddev(c).over(around)
        z = F.when(spread > 0, F.abs(F.col(c) - F.avg(c).over(around)) / spread).otherwise(0.0)
        parts += [F.lag(c).over(w).alias(f"{c}_lag"), F.round(F.avg(c).over(day), 5).alias(f"{c}_mean"), F.round(F.stddev(c).over(day), 5).alias(f"{c}_std"), F.round(z, 5).alias(f"{c}_z")]
    return df.select("event_id", *parts)


@query("win_weather", "WITH " + OBSERVED_SQL + " " + _window_sql("o", "station", ["t", "hpa", "h", "w"]))
def win_weather(spark, sf_dir):
    return _windowed(observed(spark, sf_dir), "station", ["t", "hpa", "h", "w"])


@query("win_grid", "WITH " + GRID_SQL + " " + _window_sql("grid", "operator_id", ["frequency_hz", "load_mw"]))
def win_grid(spark, sf_dir):
    return _windowed(grid_states(spark, sf_dir), "operator_id", ["frequency_hz", "load_mw"])


@query("win_neighbours", """
SELECT event_id, count(value) OVER n AS around, min(event_id) OVER n AS first_id, max(event_id) OVER n AS last_id FROM events WINDOW n AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)""")
def win_neighbours(spark, sf_dir):
    """What stands within ten places of an event in its user's order."""
    n = windows.ordered(["user_id"], ["ts", "event_id"]).rowsBetween(-10, 10)
    return t(spark, sf_dir, "events").select("event_id", F.count("value").over(n).alias("around"), F.min("event_id").over(n).alias("first_id"), F.max("event_id").over(n).alias("last_id"))


@query("join_by_date", "WITH " + READINGS_SQL + """,
w AS (SELECT CAST(reading_timestamp AS DATE) AS day, avg(temperature_c) AS temp FROM readings WHERE event_type = 'view' GROUP BY 1)
SELECT event_id, round(temp, 6) AS temperature FROM readings JOIN w ON day = CAST(reading_timestamp AS DATE) WHERE is_anomaly""")  # fmt: skip
def join_by_date(spark, sf_dir):
    e = readings(spark, sf_dir).withColumn("day", F.to_date("reading_timestamp"))
    days = e.filter("event_type = 'view'").groupBy("day").agg(F.avg("temperature_c").alias("temp"))
    return e.filter("is_anomaly").join(days, "day").select("event_id", r("temp", "temperature"))


@query("join_recent", "WITH " + READINGS_SQL + """,
m AS (SELECT meter_id, max(tariff_type) AS tariff FROM readings GROUP BY 1)
SELECT event_id, tariff FROM readings JOIN m USING (meter_id) WHERE reading_timestamp >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR AND reading_timestamp < TIMESTAMP '2024-01-30'""")  # fmt: skip
def join_recent(spark, sf_dir):
    """Readings of the 24 hours before a stated time, with their meters."""
    e, end = readings(spark, sf_dir), F.lit("2024-01-30").cast("timestamp_ntz")
    meters = e.groupBy("meter_id").agg(F.max("tariff_type").alias("tariff"))
    recent = e.filter((F.col("reading_timestamp") >= end - F.expr("INTERVAL 24 HOURS")) & (F.col("reading_timestamp") < end))
    return recent.join(meters, "meter_id").select("event_id", "tariff")


@query("sort_recent", """
SELECT event_id, CAST(row_number() OVER (ORDER BY ts DESC, event_id) AS INTEGER) AS place FROM events WHERE user_id = 7 AND value >= 50 ORDER BY ts DESC, event_id LIMIT 20""")
def sort_recent(spark, sf_dir):
    """One user's latest events over a threshold: a report of twenty, newest first."""
    e = t(spark, sf_dir, "events").filter("user_id = 7 and value >= 50").orderBy(F.desc("ts"), "event_id").limit(20)
    return e.withColumn("place", F.row_number().over(windows.Window.orderBy(F.desc("ts"), "event_id"))).select("event_id", "place")  # twenty rows


@query("sort_by_type", """
SELECT event_id, event_type, place FROM (SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS INTEGER) AS place FROM events) WHERE place <= 100""")
def sort_by_type(spark, sf_dir):
    """The first hundred events of each type, in order of time."""
    w = windows.ordered(["event_type"], ["ts", "event_id"])
    return t(spark, sf_dir, "events").select("event_id", "event_type", F.row_number().over(w).alias("place")).filter("place <= 100")


@query("policy_most_specific", """
WITH p AS (SELECT * FROM (VALUES ('any', 0, 0.0::DOUBLE, ''), ('dear', 1, 300.0, ''), ('dear_errors', 2, 300.0, 'error'), ('errors', 1, 0.0, 'error')) x(policy, conditions, least, kind)),
m AS (SELECT event_id, policy, row_number() OVER (PARTITION BY event_id ORDER BY conditions DESC, policy) AS n FROM events, p WHERE value >= least AND (kind = '' OR kind = event_type))
SELECT event_id, policy FROM m WHERE n = 1""")
def policy_most_specific(spark, sf_dir):
    """The matching policy with the most conditions, ties by name; policies are few and stated, so they are columns, not rows."""
    dear, bad = F.col("value") >= 300, F.col("event_type") == "error"
    policies = sorted([("any", [F.col("value") >= 0]), ("dear", [dear]), ("dear_errors", [dear, bad]), ("errors", [bad])], key=lambda p: (-len(p[1]) * (p[0] != "any"), p[0]))
    best = F.coalesce(*[F.when(reduce(ladders.and_, tests), F.lit(name)) for name, tests in policies])
    return t(spark, sf_dir, "events").select("event_id", best.alias("policy")).filter("policy is not null")


@query("cep_confidences", """
WITH n AS (SELECT user_id, value, count(*) OVER u AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WINDOW u AS (PARTITION BY user_id)),
a AS (SELECT user_id, max(n) AS n, avg(value) FILTER (i <= n // 3) AS a, avg(value) FILTER (i > n - (n + 2) // 3) AS b, avg(value) AS m, stddev_pop(value) AS d, max(value) AS top FROM n GROUP BY 1)
SELECT user_id, CASE WHEN n BETWEEN 60 AND 70 THEN 1.0 ELSE 0.5 END::DOUBLE AS frequency, CASE WHEN n < 3 THEN 0 ELSE round(least(1, coalesce(abs(b - a) / nullif(a, 0), 0)), 6) END AS trend, round(CASE WHEN d > 0 THEN least(1, (top - m) / d / 3) ELSE 0 END, 6) AS anomaly FROM a""")
def cep_confidences(spark, sf_dir):
    """How sure patterns are: 1 within a frequency's bounds, else a half; the relative change from the first to the last third; a third of a z."""
    u = windows.Window.partitionBy("user_id")
    e = t(spark, sf_dir, "events").select("user_id", "value", F.count("*").over(u).alias("n"), F.row_number().over(windows.ordered(["user_id"], ["ts", "event_id"])).alias("i"))
    n, part = F.col("n"), lambda test: F.avg(F.when(test, F.col("value")))
    a = e.groupBy("user_id").agg(F.max("n").alias("n"), part(F.col("i") <= F.floor(n / 3)).alias("a"), part(F.col("i") > n - F.floor((n + 2) / 3)).alias("b"), F.avg("value").alias("m"), F.stddev_pop("value").alias("d"), F.max("value").alias("top"))
    change = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.abs(F.col("b") - F.col("a")), F.col("a")), F.lit(0.0)))
    odd = F.when(F.col("d") > 0, F.least(F.lit(1.0), (F.col("top") - F.col("m")) / F.col("d") / 3)).otherwise(0.0)
    return a.select("user_id", F.when(n.between(60, 70), 1.0).otherwise(0.5).alias("frequency"), r(F.when(n < 3, 0.0).otherwise(change), "trend"), r(odd, "anomaly"))


@query("feature_history", """
SELECT user_id, event_type, arg_max(value, ts) AS latest, list_sum(list(value ORDER BY ts DESC)[1:3]) AS last_three, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY 1, 2""")
def feature_history(spark, sf_dir):
    """A feature's latest value, its last three, and how many it has in a range of time."""
    e = t(spark, sf_dir, "events").filter("ts between timestamp_ntz '2024-01-05' and timestamp_ntz '2024-01-25'")
    e = e.withColumn("k", F.row_number().over(windows.Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"))))
    return e.groupBy("user_id", "event_type").agg(F.max_by("value", "ts").alias("latest"), F.sum(F.when(F.col("k") <= 3, F.col("value"))).alias("last_three"), F.count("*").alias("n"))


@query("entity_performance", "WITH " + READINGS_SQL + """
SELECT meter_id, count(*) AS n, count(*) FILTER (is_anomaly) AS anomalies, round(avg(quality_score), 6) AS quality, CAST(round(CAST(avg(consumption_kwh) AS DECIMAL(30, 10)), 6) AS DOUBLE) AS kwh, count(DISTINCT CAST(reading_timestamp AS DATE)) AS days, count(*) FILTER (reading_timestamp > TIMESTAMP '2024-01-25') AS ahead, min(reading_timestamp) AS first_ts, max(reading_timestamp) AS last_ts FROM readings GROUP BY 1""")  # fmt: skip
def entity_performance(spark, sf_dir):
    """One pass of counts and means a meter, with how many readings lie after a stated time."""
    ahead = F.col("reading_timestamp") > F.lit("2024-01-25").cast("timestamp_ntz")
    return readings(spark, sf_dir).groupBy("meter_id").agg(
        F.count("*").alias("n"), F.count_if("is_anomaly").alias("anomalies"), r(F.avg("quality_score"), "quality"), ladders.fair(F.avg("consumption_kwh"), 6).alias("kwh"), F.count_distinct(F.to_date("reading_timestamp")).alias("days"),
        F.count_if(ahead).alias("ahead"), F.min("reading_timestamp").alias("first_ts"), F.max("reading_timestamp").alias("last_ts"),
    )


@query("win_ewm_spans", """
WITH RECURSIVE n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, event_id, i, value AS a, 1.0::DOUBLE AS wa, value AS b, 1.0::DOUBLE AS wb FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.event_id, n.i, s.a * 0.9::DOUBLE + n.value, s.wa * 0.9::DOUBLE + 1, s.b * 0.5::DOUBLE + n.value, s.wb * 0.5::DOUBLE + 1 FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1)
SELECT event_id, round(a / wa, 5) AS slow, round(b / wb, 5) AS fast FROM s""")
def win_ewm_spans(spark, sf_dir):
    """Exponentially weighted means at two rates, over all rows that a double can feel."""
    keys, order = ["user_id"], ["ts", "event_id"]
    e = windows.ewm(t(spark, sf_dir, "events"), "value", keys, order, 0.1).withColumnRenamed("value_ewm", "slow")
    return windows.ewm(e, "value", keys, order, 0.5).select("event_id", F.round("slow", 5).alias("slow"), F.round("value_ewm", 5).alias("fast"))
