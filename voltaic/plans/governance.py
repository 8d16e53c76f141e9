"""Queries of data quality, privacy, lineage, event sourcing, features, drift and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaic.operators import drift, privacy, quality, sourcing, windows
from voltaic.plans.readings import READINGS_SQL, readings
from voltaic.plans.registry import query


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, n=None):
    return F.round(c, 6).alias(n or c)


RANGES = {"voltage_v": (200, 250), "consumption_kwh": (0, 40)}
_COLUMNS = ["event_id", "meter_id", "voltage_v", "consumption_kwh", "reading_timestamp"]

_PROFILE = "WITH " + READINGS_SQL + """,
p AS (SELECT count(*) AS total, count(*) FILTER (voltage_v IS NULL) AS v_nulls, count(*) FILTER (consumption_kwh IS NULL) AS k_nulls, count(*) FILTER (voltage_v < 200 OR voltage_v > 250) AS v_out, count(*) FILTER (consumption_kwh < 0 OR consumption_kwh > 40) AS k_out,
  round(avg(voltage_v), 6) AS v_avg, count(*) - count(DISTINCT (meter_id, date_trunc('day', reading_timestamp))) AS duplicates, count(*) FILTER (reading_timestamp > TIMESTAMP '2024-01-25') AS future FROM readings)"""


def _profile(spark, sf_dir):
    df = readings(spark, sf_dir).select(*_COLUMNS).withColumn("day", F.to_date("reading_timestamp"))
    return quality.profile(df, ["meter_id", "day"], RANGES, "reading_timestamp", "2024-01-25")


@query("dq_profile", _PROFILE + " SELECT * FROM p")
def dq_profile(spark, sf_dir):
    names = {"voltage_v_nulls": "v_nulls", "consumption_kwh_nulls": "k_nulls", "voltage_v_out": "v_out", "consumption_kwh_out": "k_out"}
    return _profile(spark, sf_dir).select("total", *[F.col(a).alias(b) for a, b in names.items()], r("voltage_v_avg", "v_avg"), "duplicates", "future")


@query("dq_dimensions", _PROFILE + """, s AS (SELECT 1 - (v_nulls + k_nulls)::DOUBLE / (total * 5) AS completeness, 1 - (v_out + k_out)::DOUBLE / (total * 2) AS validity, 1 - duplicates::DOUBLE / total AS uniqueness, 1 - future::DOUBLE / total AS timeliness FROM p),
o AS (SELECT *, (completeness + validity + uniqueness + timeliness) / 4 AS overall FROM s)
SELECT round(completeness, 6) AS completeness, round(validity, 6) AS validity, round(uniqueness, 6) AS uniqueness, round(timeliness, 6) AS timeliness, round(overall, 6) AS overall, CASE WHEN overall >= 0.95 THEN 'excellent' WHEN overall >= 0.85 THEN 'good' WHEN overall >= 0.7 THEN 'fair' WHEN overall >= 0.5 THEN 'poor' ELSE 'critical' END AS level FROM o""")  # fmt: skip
def dq_dimensions(spark, sf_dir):
    s = quality.dimension_scores(_profile(spark, sf_dir), _COLUMNS, RANGES)
    return s.select(*[r(c) for c in ("completeness", "validity", "uniqueness", "timeliness", "overall")], "level")


@query("dq_violations", "WITH " + READINGS_SQL + """
SELECT event_id, 'voltage_range' AS rule FROM readings WHERE NOT voltage_v BETWEEN 200 AND 250 UNION ALL SELECT event_id, 'consumption_present' FROM readings WHERE consumption_kwh IS NULL
UNION ALL SELECT event_id, 'id_format' FROM readings WHERE NOT regexp_matches(meter_id, '^MET-[A-Z]{3}-[RC]-[0-9]{6}$')""")  # fmt: skip
def dq_violations(spark, sf_dir):
    rules = {"voltage_range": F.col("voltage_v").between(200, 250), "consumption_present": F.col("consumption_kwh").isNotNull(), "id_format": F.col("meter_id").rlike("^MET-[A-Z]{3}-[RC]-[0-9]{6}$")}
    return quality.violations(readings(spark, sf_dir), "event_id", rules)


@query("dq_fill", "WITH " + READINGS_SQL + """
SELECT event_id, round(coalesce(last_value(consumption_kwh IGNORE NULLS) OVER (PARTITION BY meter_id ORDER BY reading_timestamp, event_id), 0), 6) AS ffill, round(coalesce(voltage_v, avg(voltage_v) OVER ()), 6) AS voltage FROM readings""")  # fmt: skip
def dq_fill(spark, sf_dir):
    df = quality.forward_fill(readings(spark, sf_dir), "consumption_kwh", ["meter_id"], ["reading_timestamp", "event_id"])
    return quality.fill_with(df, "voltage_v").select("event_id", r(F.coalesce("consumption_kwh", F.lit(0.0)), "ffill"), r("voltage_v", "voltage"))


@query("dq_outliers", "WITH s AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) SELECT o_orderkey FROM orders, s WHERE o_totalprice BETWEEN q1 - (q3 - q1) * 0.5 AND q3 + (q3 - q1) * 0.5")
def dq_outliers(spark, sf_dir):
    return quality.without_outliers(t(spark, sf_dir, "orders"), "o_totalprice", "iqr", 0.5).select("o_orderkey")


@query("dq_orphans", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def dq_orphans(spark, sf_dir):
    return quality.orphans(t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer").filter("c_custkey % 2 = 0"), "o_custkey", "c_custkey")


_COUNT = "CAST(len(regexp_extract_all(text, '{0}')) AS INTEGER) AS {1}"


@query("gov_pii", "SELECT doc_id, " + ", ".join(_COUNT.format(p, k) for k, p in privacy.PATTERNS.items()) + " FROM documents")
def gov_pii(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in privacy.detect(F.col("text")).items()])


def _masked_sql(text: str) -> str:
    for kind, p in privacy.PATTERNS.items():
        text = f"regexp_replace({text}, '{p}', '[{kind.upper()}]', 'g')"
    return text


@query("gov_masking", f"SELECT doc_id, md5({_masked_sql('text')}) AS masked, substr(sha256(source), 1, 8) AS anonymous, substr(sha256(source || 'salt'), 1, 16) AS pseudonym FROM documents")
def gov_masking(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(privacy.mask(F.col("text"))).alias("masked"), privacy.anonymise(F.col("source")).alias("anonymous"), privacy.pseudonym(F.col("source"), "salt").alias("pseudonym"))


@query("gov_retention", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'archive' WHEN o_totalprice > 100000 THEN 'keep' ELSE 'delete' END AS action, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 365 DAY WHEN o_totalprice > 100000 THEN o_orderdate + INTERVAL 3650 DAY ELSE o_orderdate + INTERVAL 30 DAY END <= TIMESTAMP '1996-01-01' AS is_due FROM orders""")  # fmt: skip
def gov_retention(spark, sf_dir):
    done, large = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000
    days = F.when(done, 365).when(large, 3650).otherwise(30)
    return t(spark, sf_dir, "orders").select("o_orderkey", F.when(done, "archive").when(large, "keep").otherwise("delete").alias("action"), (F.dateadd("o_orderdate", days) <= F.lit("1996-01-01").cast("date")).alias("is_due"))


@query("gov_lineage", """
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS source, 'n' || n_nationkey AS target FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
w AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT start, target, depth + 1 FROM w JOIN e ON e.source = node WHERE depth < 3)
SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2""")  # fmt: skip
def gov_lineage(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, s, c = (t(spark, sf_dir, x) for x in ("nation", "supplier", "customer"))
    edges = n.select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target"))
    edges = edges.unionAll(s.select(name("n", "s_nationkey"), name("s", "s_suppkey"))).unionAll(c.select(name("n", "c_nationkey"), name("c", "c_custkey")))
    return privacy.lineage(edges, t(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node")), 3)


@query("evt_projection", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, round(arg_max(value, (ts, event_id)), 6) AS last_value, count(*) AS version, bool_or(event_type = 'purchase') AS has_bought FROM events GROUP BY 1""")  # fmt: skip
def evt_projection(spark, sf_dir):
    p = sourcing.project(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], {"last_type": "event_type", "last_value": "value"}, {"has_bought": F.bool_or(F.col("event_type") == "purchase")})
    return p.select("user_id", "last_type", r("last_value"), "version", "has_bought")


@query("evt_replay", "SELECT user_id, event_id, CAST(version AS BIGINT) AS version FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events) WHERE version > 2 AND version <= 5")
def evt_replay(spark, sf_dir):
    return sourcing.between(sourcing.versioned(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]), 2, 5).select("user_id", "event_id", "version")


def _halves(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")


_H = "WITH a AS (SELECT value AS x FROM events WHERE event_id % 2 = 0), b AS (SELECT value AS x FROM events WHERE event_id % 2 = 1), u AS (SELECT x, 1 AS ref FROM a UNION ALL SELECT x, 0 FROM b)"


@query("drift_psi", _H + """, c AS (SELECT unnest(quantile_cont(x, [0.2, 0.4, 0.6, 0.8])) AS c FROM a), n AS (SELECT u.x, ref, (SELECT count(*) FROM c WHERE c.c < u.x) AS bin FROM u),
g AS (SELECT bin, sum(ref) / (SELECT count(*) FROM a) AS p, sum(1 - ref) / (SELECT count(*) FROM b) AS q FROM n GROUP BY 1) SELECT round(sum((greatest(q, 1e-4) - greatest(p, 1e-4)) * ln(greatest(q, 1e-4) / greatest(p, 1e-4))), 6) AS psi FROM g""")  # fmt: skip
def drift_psi(spark, sf_dir):
    return drift.population_stability(*_halves(spark, sf_dir), "value").select(r("psi"))


@query("drift_ks", _H + """, g AS (SELECT x, sum(ref) AS r, sum(1 - ref) AS c FROM u GROUP BY 1) SELECT round(max(d), 6) AS ks FROM (SELECT abs(sum(r) OVER (ORDER BY x) / (SELECT count(*) FROM a) - sum(c) OVER (ORDER BY x) / (SELECT count(*) FROM b)) AS d FROM g)""")
def drift_ks(spark, sf_dir):
    return drift.kolmogorov_smirnov(*_halves(spark, sf_dir), "value").select(r("ks"))


@query("drift_js", _H + """, s AS (SELECT min(x) AS lo, max(x) AS hi FROM u), g AS (SELECT least(floor((x - lo) / (hi - lo) * 49), 48) AS bin, sum(ref) / (SELECT count(*) FROM a) AS p, sum(1 - ref) / (SELECT count(*) FROM b) AS q FROM u, s GROUP BY 1)
SELECT round(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM g""")  # fmt: skip
def drift_js(spark, sf_dir):
    return drift.jensen_shannon(*_halves(spark, sf_dir), "value").select(r("js"))


@query("ab_statistics", """
WITH s AS (SELECT count(*) FILTER (event_id % 2 = 0) AS n_a, count(*) FILTER (event_id % 2 = 1) AS n_b, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b, var_samp(value) FILTER (event_id % 2 = 0) AS va, var_samp(value) FILTER (event_id % 2 = 1) AS vb FROM events),
p AS (SELECT *, ((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) AS pooled FROM s) SELECT n_a, n_b, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round((b - a) / sqrt(pooled * (1 / n_a + 1 / n_b)), 6) AS t, round((b - a) / sqrt(pooled), 6) AS effect FROM p""")  # fmt: skip
def ab_statistics(spark, sf_dir):
    s = drift.two_groups(t(spark, sf_dir, "events"), F.col("event_id") % 2 == 1, "value")
    return s.select("n_a", "n_b", r("mean_a"), r("mean_b"), r("t"), r("effect"))


@query("ab_routing", """
WITH h AS (SELECT c_custkey, md5(c_name || '_test') AS m FROM customer), p AS (SELECT c_custkey, CAST('0x' || substr(m, 1, 8) AS BIGINT) AS a, CAST('0x' || substr(m, 9, 8) AS BIGINT) AS b, CAST('0x' || substr(m, 17, 8) AS BIGINT) AS c, CAST('0x' || substr(m, 25, 8) AS BIGINT) AS d FROM h)
SELECT c_custkey, CASE WHEN (((a % 100 * 96 + b) % 100 * 96 + c) % 100 * 96 + d) % 100 < 30 THEN 'B' ELSE 'A' END AS variant FROM p""")  # fmt: skip
def ab_routing(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", drift.ab_variant(F.col("c_name"), "test", 0.3).alias("variant"))


@query("feature_sequences", """
SELECT event_id, len(v) AS n, round(list_sum(v), 6) AS total FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS v FROM events) WHERE len(v) = 24""")  # fmt: skip
def feature_sequences(spark, sf_dir):
    v = F.collect_list("value").over(windows.ordered(["user_id"], ["ts", "event_id"]).rowsBetween(-24, -1))
    s = t(spark, sf_dir, "events").select("event_id", v.alias("v")).filter(F.size("v") == 24)
    return s.select("event_id", F.size("v").cast("long").alias("n"), r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), "total"))
