"""Queries of payload contracts, event migrations, column tests, compared data sets, feature statistics and partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltaic.operators import contracts
from voltaic.plans.registry import query


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("evt_payload_checks", """
WITH p AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '{"k": "x"}' WHEN 1 THEN '{}' WHEN 2 THEN '{"k": 1.5}' WHEN 3 THEN '{"k": true, "tags": [1]}' WHEN 4 THEN 'no json' WHEN 5 THEN '{"k": 2, "tags": "a"}' ELSE props END AS payload FROM events)
SELECT event_id, CASE WHEN json_valid(payload) THEN coalesce(json_type(payload, '$.k') IN ('UBIGINT', 'BIGINT', 'BOOLEAN'), false) AND coalesce(json_type(payload, '$.tags') = 'ARRAY', true) ELSE false END AS fits FROM p""")  # fmt: skip
def evt_payload_checks(spark, sf_dir):
    """Some payloads are broken on purpose."""
    shapes = ['{"k": "x"}', "{}", '{"k": 1.5}', '{"k": true, "tags": [1]}', "no json", '{"k": 2, "tags": "a"}']
    payload = reduce(lambda c, i: c.when(F.col("event_id") % 7 == i, shapes[i]), range(1, len(shapes)), F.when(F.col("event_id") % 7 == 0, shapes[0])).otherwise(F.col("props"))
    return t(spark, sf_dir, "events").select("event_id", contracts.payload_fits(payload, ["k"], {"k": "integer", "tags": "array"}).alias("fits"))


@query("evt_migrations", """
SELECT event_id, 4 AS version, CASE WHEN event_id % 4 < 2 THEN round(value * 100) ELSE value END AS amount, CASE WHEN event_id % 4 IN (0, 2) THEN 'EUR' WHEN event_id % 4 = 1 THEN 'EUR?' ELSE upper(event_type) END AS unit FROM events""")  # fmt: skip
def evt_migrations(spark, sf_dir):
    """Versions 1 to 4: 1 goes by way of 3, 2 and 3 straight to 4."""
    e = t(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, (1, 2, 3, 4))), (F.col("event_id") % 4 + 1).cast("int")).alias("version"), F.col("value").alias("amount"), F.upper("event_type").alias("unit"))
    cents, euro = F.round(F.col("amount") * 100), F.lit("EUR")
    return contracts.migrated(e, {(1, 3): {"amount": cents}, (2, 4): {"amount": cents, "unit": F.lit("EUR?")}, (3, 4): {"unit": euro}}, 4)


@query("dq_column_tests", """
SELECT 'o_orderkey' AS "column", 'not_null' AS test, count(*) FILTER (o_orderkey IS NULL) AS violations, count(*) FILTER (o_orderkey IS NULL) = 0 AS passed FROM orders
UNION ALL SELECT 'o_orderstatus', 'accepted_values', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')), count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0 FROM orders
UNION ALL SELECT 'o_totalprice', 'between', count(*) FILTER (o_totalprice NOT BETWEEN 1000 AND 300000), count(*) FILTER (o_totalprice NOT BETWEEN 1000 AND 300000) = 0 FROM orders
UNION ALL SELECT 'o_orderkey', 'unique', count(*) FILTER (n > 1), count(*) FILTER (n > 1) = 0 FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey)
UNION ALL SELECT 'o_custkey', 'unique', count(*) FILTER (n > 1), count(*) FILTER (n > 1) = 0 FROM (SELECT count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)""")  # fmt: skip
def dq_column_tests(spark, sf_dir):
    return contracts.column_tests(t(spark, sf_dir, "orders"), ["o_orderkey"], {"o_orderstatus": ["F", "O"]}, {"o_totalprice": (1000, 300000)}, ["o_orderkey", "o_custkey"])


#: Of each data set: a column that may hold nulls, its key, and the range of a measure.
SETS = {"orders": ("o_totalprice", "o_custkey", 0, 300000), "customer": ("c_acctbal", "c_custkey", 0, 9000), "part": ("p_retailprice", "p_brand", 0, 1500), "supplier": ("s_acctbal", "s_suppkey", -500, 9500)}
_SCORES = " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS n_rows, count({m}) / count(*) AS completeness, count(*) FILTER (coalesce({m} BETWEEN {lo} AND {hi}, true)) / count(*) AS validity, count(DISTINCT {k}) / count(*) AS uniqueness FROM {n}" for n, (m, k, lo, hi) in SETS.items())


@query("dq_datasets_compared", f"""
WITH s AS ({_SCORES}), o AS (SELECT *, (completeness + validity + uniqueness) / 3 AS overall FROM s)
SELECT dataset, n_rows, round(completeness, 6) AS completeness, round(validity, 6) AS validity, round(uniqueness, 6) AS uniqueness, round(overall, 6) AS overall, CAST(row_number() OVER (ORDER BY overall DESC, dataset) AS INTEGER) AS place FROM o""")  # fmt: skip
def dq_datasets_compared(spark, sf_dir):
    """One aggregation a data set; the ranking has one row a data set."""
    n, parts = F.count("*"), []
    for name, (measure, key, low, high) in SETS.items():
        valid = F.count_if(F.coalesce(F.col(measure).between(low, high), F.lit(True)))
        parts.append(t(spark, sf_dir, name).agg(F.lit(name).alias("dataset"), n.alias("n_rows"), F.try_divide(F.count(measure), n).alias("completeness"), F.try_divide(valid, n).alias("validity"), F.try_divide(F.count_distinct(key), n).alias("uniqueness")))
    scored = reduce(DataFrame.unionByName, parts).withColumn("overall", (F.col("completeness") + F.col("validity") + F.col("uniqueness")) / 3)
    place = F.row_number().over(Window.orderBy(F.desc("overall"), "dataset")).alias("place")
    return scored.select("dataset", "n_rows", *[F.round(c, 6).alias(c) for c in ("completeness", "validity", "uniqueness", "overall")], place)


@query("feature_statistics", r"""
WITH f AS (SELECT event_type AS feature, user_id, ts, json_extract_string(props, '$.k') AS v FROM events), x AS (SELECT *, CASE WHEN regexp_full_match(v, '-?[0-9]+(\.[0-9]+)?') THEN CAST(v AS DOUBLE) END AS num FROM f)
SELECT feature, count(*) AS n, count(DISTINCT user_id) AS entities, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(num), 6) AS mean, min(num) AS low, max(num) AS high, round(stddev_samp(num), 6) AS deviation FROM x GROUP BY feature""")  # fmt: skip
def feature_statistics(spark, sf_dir):
    """Values of the JSON texts that aren't numbers count as rows but not in the moments."""
    v = F.get_json_object("props", "$.k")
    x = t(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), "user_id", "ts", F.when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), v.try_cast("double")).alias("num"))
    return x.groupBy("feature").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("entities"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.round(F.avg("num"), 6).alias("mean"), F.min("num").alias("low"), F.max("num").alias("high"), F.round(F.stddev("num"), 6).alias("deviation"),
    )


@query("sort_partition_extremes", """
WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS part, count(*) AS n FROM orders GROUP BY 1)
SELECT * FROM (SELECT 'largest' AS side, part, n FROM p ORDER BY n DESC, part LIMIT 10) UNION ALL SELECT * FROM (SELECT 'smallest' AS side, part, n FROM p ORDER BY n, part LIMIT 10)""")  # fmt: skip
def sort_partition_extremes(spark, sf_dir):
    p = t(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("part")).agg(F.count("*").alias("n"))
    side = lambda name, order: p.orderBy(order, "part").limit(10).select(F.lit(name).alias("side"), "part", "n")
    return side("largest", F.desc("n")).unionByName(side("smallest", F.asc("n")))
