"""What makes rows anomalous: against a reference's spread, its correlations, and groups such as hours of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltaic.operators import ranks


def confidence(df: DataFrame, score: str) -> DataFrame:
    """df with confidence: twice the distance of the score, scaled to 0..1 over the table, from the middle; 1 if all are equal."""
    span = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    return df.crossJoin(F.broadcast(span)).withColumn("confidence", F.when(F.col(score).isNotNull(), F.abs(scaled - 0.5) * 2)).drop("_lo", "_hi")  # span is one row


def explained(rows: DataFrame, reference: DataFrame, key: str, features: list[str], moderate: float = 2.0, strong: float = 3.0) -> DataFrame:
    """(key, feature, value, z, kind, severity, percentile) of each feature of rows that lies outside the reference's
    extremes or over moderate deviations from its mean; percentile: the share of reference values that are lower.

    Percentiles come from counts of each value, both sides together, summed in cells of values. Null values are passed over.
    """
    out = []
    for name in features:
        x = F.col(name).cast("double")
        stats = reference.agg(F.avg(x).alias("m"), F.stddev(x).alias("d"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("all"))
        own = rows.select(F.col(key), x.alias("value")).filter("value is not null")
        sides = reference.select(x.alias("x"), F.lit(1).alias("n")).filter("x is not null").unionByName(own.select(F.col("value").alias("x"), F.lit(0).alias("n")))
        below = ranks.running(sides.groupBy("x").agg(F.sum("n").alias("n")), "x", ["n"]).select(F.col("x").alias("value"), "before_n")
        z = F.when(F.col("d") > 0, F.abs(F.col("value") - F.col("m")) / F.col("d")).otherwise(0.0)
        table = own.crossJoin(F.broadcast(stats)).withColumn("z", z)  # stats is one row
        outside = (F.col("value") > F.col("hi")) | (F.col("value") < F.col("lo"))
        kind = F.when(F.col("value") > F.col("hi"), "above_maximum").when(F.col("value") < F.col("lo"), "below_minimum").when(F.col("z") > strong, "statistical_outlier").otherwise("moderate_deviation")
        severity = F.when(outside, "extreme").when(F.col("z") > strong, "high").otherwise("medium")
        found = table.filter(outside | (F.col("z") > moderate)).join(below, "value")
        out.append(found.select(key, F.lit(name).alias("feature"), "value", "z", kind.alias("kind"), severity.alias("severity"), (F.col("before_n") / F.col("all") * 100).alias("percentile")))
    first, *more = out
    for part in more:
        first = first.unionByName(part)
    return first


def against_correlation(rows: DataFrame, reference: DataFrame, cause: str, effect: str, limit: float = 2.0) -> DataFrame:
    """rows with expected (what the reference's straight line gives for effect), deviation in its deviations, and breaks."""
    both = reference.filter(F.col(cause).isNotNull() & F.col(effect).isNotNull())
    s = both.agg(F.corr(cause, effect).alias("_c"), F.avg(cause).alias("_m1"), F.stddev(cause).alias("_d1"), F.avg(effect).alias("_m2"), F.stddev(effect).alias("_d2"))
    expected = F.col("_m2") + F.col("_c") * F.col("_d2") / F.col("_d1") * (F.col(cause) - F.col("_m1"))
    out = rows.crossJoin(F.broadcast(s)).withColumn("expected", expected).filter("expected is not null")  # s is one row
    out = out.withColumn("deviation", F.try_divide(F.abs(F.col(effect) - F.col("expected")), F.col("_d2")))
    return out.withColumn("breaks", F.col("deviation") > limit).drop("_c", "_m1", "_d1", "_m2", "_d2")


def against_groups(rows: DataFrame, reference: DataFrame, groups: list[str], value: str, limit: float = 2.0, strong: float = 3.0) -> DataFrame:
    """rows over limit deviations from the mean of their group in the reference, with typical, z and severity."""
    s = reference.groupBy(*groups).agg(F.avg(value).alias("typical"), F.stddev(value).alias("_d")).filter("_d > 0")
    out = rows.join(s, groups).withColumn("z", F.abs(F.col(value) - F.col("typical")) / F.col("_d")).filter(F.col("z") > limit)
    return out.withColumn("severity", F.when(F.col("z") > strong, "high").otherwise("medium")).drop("_d")
