"""Conditions on meters with nulls and at their bounds."""

from pyspark.sql import functions as F

from voltaic.functions import meters


def test_maintenance_and_calibration(spark):
    df = spark.sql("SELECT * FROM VALUES ('POOR', NULL, NULL), (NULL, timestamp'2024-01-12', 'ACTIVE'), ('GOOD', timestamp'2024-01-13', 'ACTIVE'), (NULL, NULL, NULL), ('GOOD', NULL, 'MAINTENANCE') t(tier, last, status)")
    got = df.select(meters.needs_maintenance(F.col("tier"), F.col("last"), F.col("status"), "2024-01-20").alias("x"))
    assert [r[0] for r in got.collect()] == [True, True, False, False, True]
    due = meters.calibration(F.col("d"), "2024-01-20")
    rows = spark.sql("SELECT * FROM VALUES (date'2024-01-20'), (date'2024-01-21'), (NULL) t(d)").select(*[c.alias(n) for n, c in due.items()]).collect()
    assert [tuple(r) for r in rows] == [(True, 0), (False, 1), (False, None)]


def test_ratings_and_tolerance(spark):
    checks = meters.rating_checks(F.lit(253.1), F.lit(0.01), F.lit(None).cast("double"), F.lit(230.0), F.lit(10.0))
    row = spark.range(1).select(*[c.alias(n) for n, c in checks.items()], meters.accuracy_tolerance(F.lit("2")).alias("t"), meters.accuracy_tolerance(F.lit("9")).alias("u")).first()
    assert tuple(row) == (False, True, None, 2.0, None)


def test_near(spark):
    at = lambda lat, lon, **o: spark.range(1).select(meters.near(F.lit(lat), F.lit(lon), (60, 10), 111, **o)).first()[0]
    assert at(61.0, 11.9) and not at(61.1, 10.0) and not at(60.0, 12.1)
    assert not at(60.0, 10.1, as_published=True) and at(60.0, 10.01, as_published=True)
