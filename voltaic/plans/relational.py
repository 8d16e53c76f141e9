"""Queries of aggregates, joins, sets, sorts and grouping extensions over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaic.operators import joins, windows
from voltaic.plans.readings import READINGS_SQL, readings
from voltaic.plans.registry import query


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, n=None):
    return F.round(c, 6).alias(n or c)


@query("agg_statistics", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS med, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev(value), 6) AS sd, arg_min(event_id, ts) AS first_id, arg_max(event_id, ts) AS last_id, round(skewness_pop(value), 6) AS skew FROM (SELECT *, value AS v FROM events) GROUP BY 1".replace("round(skewness_pop(value), 6) AS skew", "round(kurtosis_pop(value), 6) AS kurt"))
def agg_statistics(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), r(F.sum("value"), "total"), r(F.avg("value"), "mean"), r(F.median("value"), "med"), r(F.percentile("value", F.lit(0.95)), "p95"),
        r(F.stddev("value"), "sd"), F.min_by("event_id", "ts").alias("first_id"), F.max_by("event_id", "ts").alias("last_id"), r(F.kurtosis("value"), "kurt"),
    )


@query("agg_daily_pivot", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value) FILTER (hour(ts) BETWEEN 17 AND 21), 6) AS evening, round(sum(value) FILTER (hour(ts) BETWEEN 6 AND 11), 6) AS morning,
  round(sum(value) FILTER (hour(ts) BETWEEN 17 AND 21) / nullif(sum(value) FILTER (hour(ts) BETWEEN 6 AND 11), 0), 6) AS evening_to_morning, round(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*), 6) AS error_percent FROM events GROUP BY 1""")  # fmt: skip
def agg_daily_pivot(spark, sf_dir):
    part = lambda lo, hi: F.sum(F.when(F.hour("ts").between(lo, hi), F.col("value")))
    return t(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), r(part(17, 21), "evening"), r(part(6, 11), "morning"), r(F.try_divide(part(17, 21), part(6, 11)), "evening_to_morning"), r(F.count_if(F.col("event_type") == "error") / F.count("*") * 100.0, "error_percent"),
    )


@query("agg_pivot", "SELECT user_id, round(sum(value) FILTER (event_type = 'view'), 6) AS view, round(sum(value) FILTER (event_type = 'click'), 6) AS click, round(sum(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM events GROUP BY 1")
def agg_pivot(spark, sf_dir):
    p = t(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.sum("value"))
    return p.select("user_id", r("view"), r("click"), r("purchase"))


for _kind in ("rollup", "cube"):

    @query(f"agg_{_kind}", f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY {_kind.upper()} (l_returnflag, l_linestatus)")
    def agg_groups(spark, sf_dir, kind=_kind):
        grouped = getattr(t(spark, sf_dir, "lineitem"), kind)("l_returnflag", "l_linestatus")
        return grouped.agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.grouping_id().cast("long").alias("level"))


@query("agg_correlation", """
SELECT user_id, round(coalesce(corr(value, hour(ts)), 0), 6) AS c, CASE WHEN abs(coalesce(corr(value, hour(ts)), 0)) > 0.5 THEN 'high' WHEN abs(coalesce(corr(value, hour(ts)), 0)) > 0.3 THEN 'medium' ELSE 'low' END AS sensitivity FROM events GROUP BY 1 HAVING count(*) > 5""")  # fmt: skip
def agg_correlation(spark, sf_dir):
    c = F.coalesce(F.corr("value", F.hour("ts").cast("double")), F.lit(0.0))
    g = t(spark, sf_dir, "events").groupBy("user_id").agg(c.alias("c"), F.count("*").alias("n")).filter("n > 5")
    return g.select("user_id", r("c"), F.when(F.abs("c") > 0.5, "high").when(F.abs("c") > 0.3, "medium").otherwise("low").alias("sensitivity"))


@query("agg_audit", "SELECT user_id, count(*) AS n, CAST(max(ts) AS VARCHAR)[:19] AS last_activity, count(DISTINCT event_type) AS kinds, mode(event_type) IS NOT NULL AS has_mode FROM events GROUP BY 1")
def agg_audit(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_activity"), F.count_distinct("event_type").alias("kinds"), F.mode("event_type").isNotNull().alias("has_mode"))


@query("agg_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def agg_pricing(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r(F.avg("l_discount"), "discount"), F.count("*").alias("n"))


@query("join_star", "SELECT r_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_star(spark, sf_dir):
    o, c, n, g = (t(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
    return j.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark, sf_dir):
    o = t(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    return t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    return t(spark, sf_dir, "customer").join(t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join_latest_status", "SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")
def join_latest_status(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))


@query("join_nearest_place", "WITH " + READINGS_SQL + """,
p AS (SELECT DISTINCT s_nationkey AS place, CAST(40 + s_nationkey % 20 AS DOUBLE) AS latitude, CAST(s_nationkey - 12 AS DOUBLE) AS longitude FROM supplier),
d AS (SELECT DISTINCT f.meter_id, p.place, sqrt(pow(f.latitude - p.latitude, 2) + pow(f.longitude - p.longitude, 2)) AS d FROM readings f, p)
SELECT meter_id, arg_min(place, (d, place)) AS nearest_place, round(min(d), 6) AS distance FROM d GROUP BY 1""")  # fmt: skip
def join_nearest_place(spark, sf_dir):
    k = F.col("s_nationkey")
    places = t(spark, sf_dir, "supplier").select(k.alias("place"), (40 + k % 20).cast("double").alias("latitude"), (k - 12).cast("double").alias("longitude")).distinct()
    meters = readings(spark, sf_dir).select("meter_id", "latitude", "longitude").distinct()
    return joins.nearest(meters, places, "latitude", "longitude", "place").select("meter_id", "nearest_place", r("distance"))


@query("join_logical", "SELECT a.event_id, b.event_id AS related FROM events a JOIN events b ON a.user_id = b.user_id AND json_extract_string(a.props, '$.k') = json_extract_string(b.props, '$.k') AND a.event_id <> b.event_id")
def join_logical(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"))
    other = e.withColumnRenamed("event_id", "related")
    return e.join(other, ["user_id", "k"]).filter("event_id <> related").select("event_id", "related")


@query("set_union", "SELECT 'events' AS name, count(*) AS n, CAST(min(ts) AS VARCHAR)[:19] AS first, CAST(max(ts) AS VARCHAR)[:19] AS last FROM events UNION ALL SELECT 'orders', count(*), CAST(min(o_orderdate) AS VARCHAR)[:19], CAST(max(o_orderdate) AS VARCHAR)[:19] FROM orders")
def set_union(spark, sf_dir):
    one = lambda name, ts: t(spark, sf_dir, name).agg(F.count("*").alias("n"), F.date_format(F.min(ts), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss").alias("last")).withColumn("name", F.lit(name))
    return one("events", "ts").unionByName(one("orders", "o_orderdate"))


@query("set_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def set_distinct(spark, sf_dir):
    return t(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query("set_intersect", "SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_intersect(spark, sf_dir):
    of = lambda k: t(spark, sf_dir, "events").filter(F.col("event_type") == k).select("user_id")
    return of("error").intersect(of("purchase"))


@query("set_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey").exceptAll(t(spark, sf_dir, "orders").select("o_custkey").distinct())


@query("sort_page", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20 OFFSET 40")
def sort_page(spark, sf_dir):
    return t(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").offset(40).limit(20).select("event_id", "value")


@query("sort_top_per_key", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def sort_top_per_key(spark, sf_dir):
    w = windows.Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("user_id", "event_id", "value")


@query("filter_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '1') AND p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')")
def filter_search(spark, sf_dir):
    return t(spark, sf_dir, "part").filter(F.lower("p_name").contains("1") & F.col("p_size").between(5, 20) & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23")).select("p_partkey", "p_name")
