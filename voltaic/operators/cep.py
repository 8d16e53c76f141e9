"""Patterns and rules over events of a key. No buffer is bounded; time windows are the only limits."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaic.operators import steps


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sequence(df: DataFrame, keys: list[str], ts: str, order: str, kind: str, wanted: list[str]) -> DataFrame:
    """How many of the wanted types, in order with any others between, each key's events match; greedy, from the first.

    Each step takes a key's earliest event of the next type after the match before: a partial minimum, and one row a
    key is joined. No key's events are gathered.
    """
    at = F.struct(F.col(ts).alias("at"), F.col(order).alias("tie"))
    out = steps.cut(df.groupBy(*keys).agg(F.min(F.when(F.col(kind) == wanted[0], at)).alias("_m0")))
    for i, step in enumerate(wanted[1:], 1):
        open_ = out.filter(F.col(f"_m{i - 1}").isNotNull()).select(*keys, f"_m{i - 1}")
        later = df.filter(F.col(kind) == step).select(*keys, at.alias("_at")).join(open_, keys).filter(F.col("_at") > F.col(f"_m{i - 1}"))
        out = out.join(later.groupBy(*keys).agg(F.min("_at").alias(f"_m{i}")), keys, "left")
        out = steps.cut(out) if i + 1 < len(wanted) else out
    found = [F.col(f"_m{i}").isNotNull().cast("int") for i in range(len(wanted))]
    return out.select(*keys, sum(found[1:], found[0]).alias("matched")).withColumn("confidence", F.col("matched") / F.lit(float(len(wanted))))


def custom(df: DataFrame, keys: list[str], detector, schema: str, ts: str, window: str) -> DataFrame:
    """A detector of the caller's own, over one key's events of one window of time at a time, which therefore is what one task
    must hold: a function of a pandas frame that has window_start too, giving schema. Events without a time are left out."""
    return df.withColumn("window_start", F.window(F.col(ts).cast("timestamp"), window)["start"]).groupBy(*keys, "window_start").applyInPandas(detector, schema)


def custom_together(df: DataFrame, keys: list[str], detector, schema: str, ts: str, window: str, deals: int = 4096) -> DataFrame:
    """custom for detectors that tell keys and windows apart by themselves: each call gets the events of many, whole, so that what a
    call costs isn't paid for each. They are dealt into so many parts, one of which is what a task must hold; more deals make these smaller."""
    windowed = df.withColumn("window_start", F.window(F.col(ts).cast("timestamp"), window)["start"])
    deal = F.pmod(F.xxhash64(*keys, "window_start"), F.lit(deals))
    some_null = reduce(or_, [F.col(k).isNull() for k in keys])  # apart, as pandas turns whole numbers beside nulls into floats
    return windowed.withColumn("_deal", F.when(some_null, -1 - deal).otherwise(deal)).groupBy("_deal").applyInPandas(lambda part: detector(part.drop(columns="_deal")), schema)


def frequency(df: DataFrame, keys: list[str], ts: str, kind: str, seconds: int, least: int, most: int, minima: dict[str, int]) -> DataFrame:
    """Events within seconds up to each event: in all, of some types, and whether all bounds hold."""
    w = Window.partitionBy(*keys).orderBy(_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    counts = {f"n_{k}": F.count(F.when(F.col(kind) == k, 1)).over(w) for k in minima}
    df = df.withColumns({"n": F.count(F.lit(1)).over(w), **counts})
    return df.withColumn("matches", reduce(and_, [F.col(f"n_{k}") >= m for k, m in minima.items()], F.col("n").between(least, most)))


def anomaly(df: DataFrame, keys: list[str], ts: str, value: str, seconds: int, limit: float = 2.0, least: int = 5) -> DataFrame:
    """Whether a value is over limit population deviations from the mean of the events before it, of which there are least."""
    w = Window.partitionBy(*keys).orderBy(_micros(ts)).rangeBetween(-seconds * 1_000_000, -1)
    mean, deviation = F.avg(value).over(w), F.stddev_pop(value).over(w)
    off = F.when(deviation > 0, F.abs(F.col(value) - mean) / deviation > limit).otherwise(F.col(value) != mean)
    return df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("is_anomaly", (F.col("n") >= least) & F.coalesce(off, F.lit(False)))


def trend(df: DataFrame, keys: list[str], ts: str, order: str, value: str, rise: float = 1.1, fall: float = 0.9) -> DataFrame:
    """Whether the mean of the later half of a key's values is over rise or under fall times that of the earlier half."""
    w = Window.partitionBy(*keys)
    half = F.floor(F.count(F.lit(1)).over(w) / 2)
    df = df.withColumn("_late", F.row_number().over(w.orderBy(ts, order)) > half)
    means = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(F.when(~F.col("_late"), F.col(value))).alias("_a"), F.avg(F.when(F.col("_late"), F.col(value))).alias("_b"))
    label = F.when(F.col("_n") < 2, "stable").when(F.col("_b") > F.col("_a") * rise, "increasing").when(F.col("_b") < F.col("_a") * fall, "decreasing").otherwise("stable")
    return means.withColumn("trend", label).drop("_n", "_a", "_b")


def cyclic(df: DataFrame, keys: list[str], ts: str, period: int, tolerance: float, least: int = 6) -> DataFrame:
    """Whether a key's events come in every period, up to tolerance periods; least different periods are needed."""
    buckets = df.select(*keys, F.floor(_micros(ts) / 1e6 / period).cast("long").alias("_b")).distinct()
    gap = F.col("_b") - F.lag("_b").over(Window.partitionBy(*keys).orderBy("_b"))
    out = buckets.withColumn("_gap", gap).groupBy(*keys).agg(F.count("*").alias("periods"), F.max(F.abs(F.col("_gap") - 1)).alias("worst"))
    return out.withColumn("matches", (F.col("periods") >= least) & F.coalesce(F.col("worst") <= tolerance, F.lit(False)))


def threshold(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Values outside the bounds; confidence is twice the relative excess, 1 at most."""
    v = F.col(value)
    excess = F.when(v < low, 2 * (low - v) / low).when(v > high, 2 * (v - high) / high).otherwise(0.0)
    return df.withColumns({"violates": (v < low) | (v > high), "confidence": F.least(F.lit(1.0), excess)})


def every_condition(conditions: list[Column]) -> Column:
    """Each condition holds for some event of the group."""
    return reduce(and_, [F.bool_or(c) for c in conditions])


def span_within(ts: str, seconds: int) -> Column:
    return (F.max(_micros(ts)) - F.min(_micros(ts))) <= seconds * 1_000_000


def rules(df: DataFrame, keys: list[str], named: dict[str, Column]) -> DataFrame:
    """One pass over the events: each rule, an aggregate condition, as a boolean of each key."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in named.items()])
