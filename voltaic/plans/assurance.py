"""Queries of format and sum checks, combined quality scores and their history, data subjects, risk, retention, impact, retention counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaic.functions import ladders
from voltaic.operators import privacy, quality
from voltaic.plans.readings import READINGS_SQL, readings
from voltaic.plans.registry import query


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, n=None):
    return F.round(c, 6).alias(n or c)


@query("dq_formats", r"""
WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'no mail' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'c' || c_custkey || '@example.org' END AS mail, CASE WHEN c_custkey % 3 = 0 THEN '+1' || (5550000000 + c_custkey) ELSE '12-34' END AS phone, c_name FROM customer)
SELECT c_custkey, coalesce(regexp_matches(mail, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), true) AS mail_ok, coalesce(regexp_matches(phone, '^\+?1?\d{9,15}'), true) AS phone_ok, regexp_matches(c_name, '^Customer') AS name_ok FROM v""")  # fmt: skip
def dq_formats(spark, sf_dir):
    k = F.col("c_custkey")
    v = t(spark, sf_dir, "customer").withColumns({"mail": F.when(k % 5 == 0, "no mail").when(k % 7 != 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@example.org"))), "phone": F.when(k % 3 == 0, F.concat(F.lit("+1"), (k + 5550000000).cast("string"))).otherwise("12-34")})
    return v.select("c_custkey", quality.has_format(F.col("mail"), "email").alias("mail_ok"), quality.has_format(F.col("phone"), "phone").alias("phone_ok"), F.col("c_name").rlike("^(?:Customer)").alias("name_ok"))


@query("dq_sum_checks", """
SELECT o_orderkey, round(o_totalprice, 2) AS stated, round(sum(l_extendedprice), 2) AS added, round(sum(l_extendedprice) / nullif(o_totalprice, 0), 5) AS ratio, coalesce(sum(l_extendedprice) / nullif(o_totalprice, 0) BETWEEN 0.5 AND 2, false) AS ratio_ok, abs(sum(l_extendedprice) - o_totalprice) <= 0.01 AS sum_ok
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")  # fmt: skip
def dq_sum_checks(spark, sf_dir):
    """Lines are added up before they meet their orders, so the join has one row an order on both sides."""
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("added"))
    both = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey")
    ratio = F.try_divide(F.col("added"), F.col("o_totalprice"))
    return both.select("o_orderkey", F.round("o_totalprice", 2).alias("stated"), F.round("added", 2).alias("added"), F.round(ratio, 5).alias("ratio"), F.coalesce(ratio.between(0.5, 2), F.lit(False)).alias("ratio_ok"), (F.abs(F.col("added") - F.col("o_totalprice")) <= 0.01).alias("sum_ok"))


_SHARES = "WITH " + READINGS_SQL + """,
d AS (SELECT CAST(CAST(reading_timestamp AS DATE) AS VARCHAR) AS day, count(*) AS n, (count(voltage_v) + count(consumption_kwh)) / (2.0::DOUBLE * count(*)) AS completeness, count(*) FILTER (coalesce(voltage_v BETWEEN 200 AND 250, true)) / count(*) AS validity, count(DISTINCT event_id) / count(*) AS uniqueness FROM readings GROUP BY 1)"""  # fmt: skip


def _daily_scores(spark, sf_dir):
    n = F.count("*")
    return readings(spark, sf_dir).groupBy(F.to_date("reading_timestamp").cast("string").alias("day")).agg(
        n.alias("n"), ((F.count("voltage_v") + F.count("consumption_kwh")) / (2.0 * n)).alias("completeness"),
        (F.count_if(ladders.in_range(F.col("voltage_v"), 200, 250)) / n).alias("validity"), (F.count_distinct("event_id") / n).alias("uniqueness"),
    )


@query("dq_combined_scores", _SHARES + """
SELECT day, round((completeness * 0.25 + validity * 0.15 + uniqueness * 0.10) / 0.5, 6) AS weighted, round(CASE WHEN least(completeness, validity, uniqueness) > 0 THEN exp((ln(completeness) + ln(validity) + ln(uniqueness)) / 3) ELSE 0 END, 6) AS geometric,
  round(CASE WHEN least(completeness, validity, uniqueness) > 0 THEN 3 / (1 / completeness + 1 / validity + 1 / uniqueness) ELSE 0 END, 6) AS harmonic FROM d""")  # fmt: skip
def dq_combined_scores(spark, sf_dir):
    return quality.combined_scores(_daily_scores(spark, sf_dir)).select("day", r("weighted"), r("geometric"), r("harmonic"))


@query("dq_history", _SHARES + """,
s AS (SELECT CAST(day AS DATE) - DATE '2024-01-01' AS x, (completeness + validity + uniqueness) / 3 AS y FROM d WHERE n > 5)
SELECT count(*) AS days, round(avg(y), 6) AS mean, round(regr_slope(y, x), 7) AS slope, round(regr_r2(ln(y), x), 5) AS log_fit, round(regr_intercept(y, x) + regr_slope(y, x) * (max(x) + 7), 6) AS in_a_week, CASE WHEN regr_slope(y, x) > 0.01 THEN 'improving' WHEN regr_slope(y, x) < -0.01 THEN 'declining' ELSE 'stable' END AS direction FROM s""")  # fmt: skip
def dq_history(spark, sf_dir):
    """Daily scores, their line, and where it will be in a week; days with five readings or fewer don't count."""
    x = F.datediff(F.col("day").cast("date"), F.lit("2024-01-01").cast("date")).cast("double")
    s = _daily_scores(spark, sf_dir).filter("n > 5").select(x.alias("x"), ((F.col("completeness") + F.col("validity") + F.col("uniqueness")) / 3).alias("y")).withColumn("ly", F.ln("y"))
    a = s.agg(F.count("*").alias("days"), F.avg("y").alias("m"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_r2("ly", "x").alias("fit"), F.max("x").alias("last"))
    direction = ladders.first_match([(F.col("b") > 0.01, "improving"), (F.col("b") < -0.01, "declining")], "stable")
    return a.select("days", r("m", "mean"), F.round("b", 7).alias("slope"), F.round("fit", 5).alias("log_fit"), r(F.col("a") + F.col("b") * (F.col("last") + 7), "in_a_week"), direction.alias("direction"))


@query("dq_report", "WITH " + READINGS_SQL + """,
c AS (SELECT 'completeness' AS "check", 'voltage_v' AS "column", count(voltage_v) * 100.0::DOUBLE / count(*) AS share FROM readings UNION ALL SELECT 'completeness', 'consumption_kwh', count(consumption_kwh) * 100.0::DOUBLE / count(*) FROM readings UNION ALL SELECT 'completeness', 'meter_id', count(meter_id) * 100.0::DOUBLE / count(*) FROM readings
  UNION ALL SELECT 'range', 'voltage_v', count(*) FILTER (coalesce(voltage_v BETWEEN 200 AND 250, true)) * 100.0::DOUBLE / count(*) FROM readings UNION ALL SELECT 'range', 'power_factor', count(*) FILTER (coalesce(power_factor BETWEEN 0 AND 1, true)) * 100.0::DOUBLE / count(*) FROM readings)
SELECT "check", "column", round(share, 6) AS share, share >= 95 AS passed FROM c""")  # fmt: skip
def dq_report(spark, sf_dir):
    return quality.column_report(readings(spark, sf_dir), ["voltage_v", "consumption_kwh", "meter_id"], {"voltage_v": (200, 250), "power_factor": (0, 1)}).withColumn("share", F.round("share", 6))


@query("dq_outliers_in_turn", """
WITH a AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem), k AS (SELECT lineitem.* FROM lineitem, a WHERE l_quantity BETWEEN q1 - 0.3 * (q3 - q1) AND q3 + 0.3 * (q3 - q1)),
b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM k)
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM k, b WHERE l_extendedprice BETWEEN q1 - 0.3 * (q3 - q1) AND q3 + 0.3 * (q3 - q1) GROUP BY 1""")  # fmt: skip
def dq_outliers_in_turn(spark, sf_dir):
    kept = quality.without_outliers_in_turn(t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], limit=0.3)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("subject_requests", """
WITH q AS (SELECT o_orderkey, o_custkey AS subject, CASE o_orderkey % 5 WHEN 0 THEN 'access' WHEN 1 THEN 'rectification' WHEN 2 THEN 'erasure' WHEN 3 THEN 'portability' ELSE 'objection' END AS kind, o_orderstatus = 'F' AS done, o_orderdate + INTERVAL 30 DAY AS due FROM orders)
SELECT kind, count(*) AS requests, count(DISTINCT subject) AS subjects, count(*) FILTER (done) AS completed, count(*) FILTER (NOT done AND due < TIMESTAMP '1996-06-01') AS overdue, min(due) FILTER (NOT done) AS next_due FROM q GROUP BY 1""")  # fmt: skip
def subject_requests(spark, sf_dir):
    k = F.element_at(F.array(*map(F.lit, ("access", "rectification", "erasure", "portability", "objection"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    due = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    q = t(spark, sf_dir, "orders").select("o_custkey", k.alias("kind"), (F.col("o_orderstatus") == "F").alias("done"), due.alias("due"))
    return privacy.request_overview(q, "kind", "o_custkey", "done", "due", "1996-06-01")


@query("erasure", """
SELECT c_custkey, round(c_acctbal, 2) AS balance FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 2 AND o_orderstatus = 'F')""")
def erasure(spark, sf_dir):
    erased = t(spark, sf_dir, "orders").filter("o_orderkey % 5 = 2 and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return privacy.erase(t(spark, sf_dir, "customer"), erased, ["c_custkey"]).select("c_custkey", F.round("c_acctbal", 2).alias("balance"))


@query("gdpr_risk", """
WITH s AS (SELECT o_custkey AS subject, bool_or(o_orderpriority LIKE '1%') AS sensitive, count(*) > 10 AS many, bool_or(o_orderstatus = 'P') AS unsettled FROM orders GROUP BY 1), x AS (SELECT *, sensitive::INT * 3 + many::INT * 2 + unsettled::INT * 2 AS points FROM s)
SELECT subject, CAST(points AS INTEGER) AS points, CASE WHEN points >= 5 THEN 'high' WHEN points >= 3 THEN 'medium' ELSE 'low' END AS risk FROM x""")  # fmt: skip
def gdpr_risk(spark, sf_dir):
    s = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.bool_or(F.col("o_orderpriority").startswith("1")).alias("sensitive"), (F.count("*") > 10).alias("many"), F.bool_or(F.col("o_orderstatus") == "P").alias("unsettled"))
    points = privacy.risk_points([(F.col("sensitive"), 3), (F.col("many"), 2), (F.col("unsettled"), 2)])
    return s.select("subject", points.alias("points"), ladders.at_least(points, [(5, "high"), (3, "medium")], "low").alias("risk"))


@query("retention_report", """
WITH i AS (SELECT o_totalprice AS size, CASE WHEN o_orderstatus = 'F' THEN 'archive' WHEN o_totalprice > 100000 THEN 'keep' ELSE 'delete' END AS action, o_orderdate + CASE WHEN o_orderstatus = 'F' THEN INTERVAL 365 DAY WHEN o_totalprice > 100000 THEN INTERVAL 3650 DAY ELSE INTERVAL 30 DAY END AS due FROM orders)
SELECT action, count(*) AS items, round(sum(size), 2) AS total_size, count(*) FILTER (due > TIMESTAMP '1996-01-01' AND due <= TIMESTAMP '1996-01-31') AS due_soon, count(*) FILTER (due <= TIMESTAMP '1996-01-01') AS due FROM i GROUP BY 1""")  # fmt: skip
def retention_report(spark, sf_dir):
    closed, large = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000
    days = F.when(closed, 365).when(large, 3650).otherwise(30)
    items = t(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("size"), F.when(closed, "archive").when(large, "keep").otherwise("delete").alias("action"), F.datediff(F.dateadd("o_orderdate", days), F.lit("1996-01-01").cast("date")).alias("left"))
    return items.groupBy("action").agg(F.count("*").alias("items"), F.round(F.sum("size"), 2).alias("total_size"), F.count_if(F.col("left").between(1, 30)).alias("due_soon"), F.count_if(F.col("left") <= 0).alias("due"))


@query("lineage_impact", """
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS source, 'n' || n_nationkey AS target FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
w AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT start, target, depth + 1 FROM w JOIN e ON e.source = node WHERE depth < 10)
SELECT start, count(DISTINCT node) - 1 AS downstream, CAST(max(depth) AS INTEGER) AS depth, CASE WHEN count(DISTINCT node) - 1 > 10 THEN 'high' WHEN count(DISTINCT node) - 1 > 5 THEN 'medium' ELSE 'low' END AS impact FROM w GROUP BY 1""")  # fmt: skip
def lineage_impact(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"))
    edges = edges.unionAll(t(spark, sf_dir, "supplier").select(name("n", "s_nationkey"), name("s", "s_suppkey")))
    starts = t(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node"))
    return privacy.impact(edges, starts, depth=3)
