"""Queries of regular series, nested columns, rules from a table and depths of graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaic.operators import graphs, nested, privacy, rules, series, steps
from voltaic.plans.registry import query


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, n=None):
    return F.round(c, 6).alias(n or c)


@query("resampled_series", """
WITH b AS (SELECT *, epoch_us(ts) // 21600000000 AS g FROM events), a AS (SELECT user_id, g, count(*) AS n, avg(value) AS value, arg_min(event_type, (ts, event_id)) AS event_type FROM b GROUP BY 1, 2),
s AS (SELECT user_id, unnest(generate_series(min(g), max(g))) AS g FROM a GROUP BY 1)
SELECT user_id, make_timestamp(g * 21600000000) AS ts, coalesce(n, 0) AS n, round(value, 6) AS value, event_type FROM s LEFT JOIN a USING (user_id, g)""")  # fmt: skip
def resampled_series(spark, sf_dir):
    """Each user's events on a grid of six hours."""
    out = series.resample(t(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 21_600, ["value"], ["event_type"])
    return out.select("user_id", "ts", "n", r("value"), "event_type")


_AROUND = "last_value({0} IGNORE NULLS) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {0}a, first_value({0} IGNORE NULLS) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {0}b"


@query("interpolated_values", f"""
WITH e AS (SELECT event_id, user_id, ts, epoch_us(ts) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
m AS (SELECT *, CASE WHEN v IS NOT NULL THEN u END AS t, CASE WHEN v IS NOT NULL THEN k END AS n FROM e),
w AS (SELECT *, {_AROUND.format('v')}, {_AROUND.format('t')}, {_AROUND.format('n')} FROM m WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN vb IS NULL THEN va ELSE va + (vb - va) * ((u - ta)::DOUBLE / (tb - ta)) END, 6) AS by_time,
  round(CASE WHEN v IS NOT NULL THEN v WHEN vb IS NULL THEN va ELSE va + (vb - va) * ((k - na)::DOUBLE / (nb - na)) END, 6) AS by_place FROM w""")  # fmt: skip
def interpolated_values(spark, sf_dir):
    """Two thirds of the values are taken away and put back from their neighbours, by time and by place."""
    known = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    df = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", known.alias("by_time"), known.alias("by_place"))
    df = series.interpolate(df, ["user_id"], "ts", "event_id", "by_time")
    return series.interpolate(df, ["user_id"], "ts", "event_id", "by_place", how="linear").select("event_id", r("by_time"), r("by_place"))


def load(spark, sf_dir):
    """(event_type, step, total): each type's values summed over steps of six hours."""
    grid = series.resample(t(spark, sf_dir, "events"), ["event_type"], "ts", "event_id", 21_600, ["value"])
    step = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000).alias("step")
    return steps.cut(grid.select("event_type", step, F.coalesce(F.col("n") * F.col("value"), F.lit(0.0)).alias("total")))


@query("arima_errors")
def arima_errors(spark, sf_dir):
    """Errors of the last twelve steps of each type, forecast from those before."""
    df = load(spark, sf_dir)
    ends = df.groupBy("event_type").agg((F.max("step") - 12).alias("cut"))
    past = df.join(ends, "event_type").filter("step <= cut")
    _, ahead = series.arima(past.select("event_type", "step", "total"), ["event_type"], "step", "total", p=2, d=0, q=1, ahead=12)
    return series.errors(df.join(ahead, ["event_type", "step"]), ["event_type"], "total", "forecast")


@query("seasonal_errors")
def seasonal_errors(spark, sf_dir):
    """Errors of the last twelve steps of each type, from a trend and a day's waves fitted to those before."""
    df = load(spark, sf_dir)
    ends = df.groupBy("event_type").agg((F.max("step") - 12).alias("cut"))
    df = df.join(ends, "event_type")
    fitted = series.seasonal(df, F.col("step") <= F.col("cut"), ["event_type"], "step", "total", 28, 2)
    return series.errors(fitted.filter("step > cut"), ["event_type"], "total", "fitted")


def _any_sql(kinds) -> str:
    return " OR ".join(f"regexp_matches(text, '{privacy.PATTERNS[k]}')" for k in kinds)


def _masked_sql(text: str) -> str:
    for kind, p in privacy.PATTERNS.items():
        text = f"regexp_replace({text}, '{p}', '[{kind.upper()}]', 'g')"
    return text


@query("gov_nested", f"""
SELECT doc_id, md5({_masked_sql('text')}) AS masked, substr(sha256(lang), 1, 8) AS tag, substr(sha256(source), 1, 8) AS origin, substr(sha256(CAST(n_chars AS VARCHAR)), 1, 8) AS size,
  substr(sha256(source || 'salt'), 1, 16) AS owner, lang AS plain, CASE WHEN {_any_sql(nested.HIGH)} THEN 'high' WHEN {_any_sql([k for k in privacy.PATTERNS if k not in nested.HIGH])} THEN 'medium' ELSE 'low' END AS sensitivity FROM documents""")  # fmt: skip
def gov_nested(spark, sf_dir):
    """Documents as nested rows, anonymised, pseudonymised and classified."""
    body = F.struct("text", F.array("lang", "source").alias("tags"), F.create_map(F.lit("source"), F.col("source")).alias("notes"), F.struct("n_chars").alias("inner")).alias("body")
    owner = F.struct(F.array(F.struct(F.col("source").alias("full_name"), "lang")).alias("people")).alias("owner")
    df = t(spark, sf_dir, "documents").select("doc_id", body, owner)
    hidden = nested.pseudonymise(nested.anonymise(df.withColumn("class", F.col("body")), "high", ["body"]), "salt", columns=["owner"])
    out = nested.classify(hidden, ["class"])
    people = F.col("owner.people")[0]
    return out.select("doc_id", F.md5("body.text").alias("masked"), F.col("body.tags")[0].alias("tag"), F.col("body.notes")["source"].alias("origin"), F.col("body.inner.n_chars").alias("size"), people["full_name"].alias("owner"), people["lang"].alias("plain"), F.col("class").alias("sensitivity"))


@query("rules_from_table", """
WITH k AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'] AS k),
r AS (SELECT n_nationkey AS i, n_name AS rule_id, n_regionkey AS priority, CASE WHEN n_nationkey % 8 = 3 THEN 'sequence' WHEN n_nationkey % 3 = 0 THEN 'aggregation' WHEN n_nationkey % 3 = 1 THEN 'threshold' ELSE 'conditional' END AS kind,
  CASE WHEN n_nationkey % 2 = 0 THEN [k[1 + n_regionkey], k[1 + (n_regionkey + 2) % 5]] ELSE k END AS types, [k[1 + n_regionkey], k[1 + (n_regionkey + 1) % 5], k[1 + n_regionkey]] AS wanted FROM nation, k WHERE n_nationkey % 11 <> 7),
e AS (SELECT user_id, event_type, value, i, kind, types, wanted, row_number() OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS n FROM events, r WHERE list_contains(types, event_type)),
g AS (SELECT user_id, i, kind, avg(value) AS mean, max(value) AS high, min(value) AS low FROM e GROUP BY ALL),
a AS (SELECT user_id, i, min(n) AS n FROM e WHERE kind = 'sequence' AND event_type = wanted[1] GROUP BY ALL),
b AS (SELECT a.user_id, a.i, min(e.n) AS n FROM a JOIN e ON e.user_id = a.user_id AND e.i = a.i AND e.n > a.n AND event_type = wanted[2] GROUP BY ALL),
c AS (SELECT b.user_id, b.i, min(e.n) AS n FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i AND e.n > b.n AND event_type = wanted[3] GROUP BY ALL),
h AS (SELECT user_id, i FROM g WHERE CASE kind WHEN 'aggregation' THEN mean >= 150 + 10 * i WHEN 'threshold' THEN high > 400 + 3 * i WHEN 'conditional' THEN high > 350 AND low < 20 + 5 * i ELSE false END UNION ALL SELECT user_id, i FROM c)
SELECT user_id, rule_id, CAST(priority AS INTEGER) AS priority, CAST(row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, rule_id) AS INTEGER) AS place FROM h JOIN r USING (i)""")  # fmt: skip
def rules_from_table(spark, sf_dir):
    """Rules made of the rows of nation, one of them not enabled, over each user's events."""
    i, region = F.col("n_nationkey"), F.col("n_regionkey")
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    of = lambda n: F.get(kinds, (region + n) % 5)
    kind = F.when(i % 8 == 3, "sequence").when(i % 3 == 0, "aggregation").when(i % 3 == 1, "threshold").otherwise("conditional")
    number = i.cast("double")
    test = lambda operator, value: F.struct(F.lit("value").alias("field"), F.lit(operator).alias("operator"), value.alias("value"))
    table = t(spark, sf_dir, "nation").select(
        F.col("n_name").alias("rule_id"), kind.alias("kind"), region.cast("int").alias("priority"), (i % 11 != 7).alias("enabled"), F.when(i % 2 == 0, F.array(of(0), of(2))).alias("event_types"),
        F.lit("value").alias("field"), F.lit("avg").alias("aggregation"), F.when(i % 3 == 1, "gt").alias("operator"), F.when(i % 3 == 0, 150 + 10 * number).otherwise(400 + 3 * number).alias("threshold"),
        F.array(test("gt", F.lit(350.0)), test("lt", 20 + 5 * number)).alias("conditions"), F.array(of(0), of(1), of(0)).alias("sequence"),
    )
    return rules.execute(t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value"), table, ["user_id"], "ts", "event_id", "event_type")


@query("lineage_depths", """
WITH RECURSIVE e AS (
  SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION SELECT 's' || s_suppkey, 's' || (s_suppkey + 7) FROM supplier WHERE s_suppkey % 3 = 0 UNION SELECT 's' || s_suppkey, 'c' || s_suppkey FROM supplier),
nodes AS (SELECT a AS node FROM e UNION SELECT b FROM e),
w AS (SELECT node, 0 AS depth FROM nodes WHERE node NOT IN (SELECT b FROM e) UNION SELECT b, depth + 1 FROM w JOIN e ON a = node)
SELECT node, CAST(max(depth) AS INTEGER) AS depth FROM w GROUP BY 1""")  # fmt: skip
def lineage_depths(spark, sf_dir):
    """The longest way that leads to every node of a graph of regions, nations, suppliers and customers."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, s, c = (t(spark, sf_dir, x) for x in ("nation", "supplier", "customer"))
    edges = n.select(name("r", "n_regionkey").alias("a"), name("n", "n_nationkey").alias("b")).unionAll(s.select(name("n", "s_nationkey"), name("s", "s_suppkey"))).unionAll(c.select(name("n", "c_nationkey"), name("c", "c_custkey")))
    chains = s.filter("s_suppkey % 3 = 0").select(name("s", "s_suppkey"), F.concat(F.lit("s"), (F.col("s_suppkey") + 7).cast("string")))
    return graphs.depths(edges.unionAll(chains).unionAll(s.select(name("s", "s_suppkey"), name("c", "s_suppkey"))))
