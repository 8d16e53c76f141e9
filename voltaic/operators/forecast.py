"""Anomalies of series and their next values. DataFrame in, DataFrame out; every key's series is ordered by unique columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaic.operators.windows import ordered


def key_anomalies(df: DataFrame, keys: list[str], value: str, limit: float = 2.0, least: int = 10, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Three flags from each key's own statistics: z over limit, outside 1.5 quartile ranges, outside two percentiles.

    Statistics are one row a key and join back, so a hot key is never gathered into one window. Keys with fewer than
    least values, and null values, have no anomaly.
    """
    q = F.percentile(value, F.array(*map(F.lit, (0.25, 0.75, low, high))))
    stats = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), q.alias("_q"))
    x, edge = F.col(value), lambda i: F.col("_q")[i]
    spread = (edge(1) - edge(0)) * 1.5
    enough = lambda test: F.coalesce((F.col("_n") >= least) & test, F.lit(False))
    z = F.when(F.col("_s") > 0, F.abs(x - F.col("_m")) / F.col("_s")).otherwise(0.0)
    out = df.join(stats, keys)
    return out.withColumns({"z": z, "z_flag": enough(z > limit), "iqr_flag": enough((x < edge(0) - spread) | (x > edge(1) + spread)), "percentile_flag": enough((x < edge(2)) | (x > edge(3)))}).drop("_n", "_m", "_s", "_q")


def moving_average_anomaly(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = 10, limit: float = 2.0) -> DataFrame:
    """Distance from the mean of the rows before, in their deviations; no anomaly before there are as many or where they don't vary."""
    frame = ordered(keys, order).rowsBetween(-rows, -1)
    deviation = F.stddev_samp(value).over(frame)
    z = F.when((F.count(value).over(frame) == rows) & (deviation > 0), F.abs(F.col(value) - F.avg(value).over(frame)) / deviation)
    return df.withColumn("distance", z).withColumn("is_anomaly", F.coalesce(F.col("distance") > limit, F.lit(False)))


def next_values(df: DataFrame, keys: list[str], order: list[str], value: str, steps: int = 3, alpha: float = 0.3, last: int = 100) -> DataFrame:
    """(keys, step, linear, moving_average, smoothed): the next values of each key by three methods.

    linear: the straight line through all of the key's values by position; moving_average: the last ten; smoothed:
    exponential, over the last rows at most, as older ones weigh under (1 - alpha) ** last. Each key keeps at most
    last values at once.
    """
    w = ordered(keys, order)
    numbered = df.filter(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(w).cast("double"), "_left": F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))})
    recent = F.transform(F.array_sort(F.collect_list(F.when(F.col("_left") <= last, F.struct("_i", value)))), lambda s: s[value])
    line = numbered.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.regr_slope(value, "_i").alias("_b"), F.regr_intercept(value, "_i").alias("_a"), F.avg(F.when(F.col("_left") <= 10, F.col(value))).alias("moving_average"), recent.alias("_v"),
    )
    smooth = F.aggregate(F.slice("_v", 2, last), F.element_at("_v", 1), lambda s, x: s * (1 - alpha) + x * alpha)
    line = line.withColumns({"smoothed": smooth, "step": F.explode(F.sequence(F.lit(1), F.lit(steps)))})
    return line.withColumn("linear", F.col("_a") + F.col("_b") * (F.col("_n") + F.col("step"))).select(*keys, "step", "linear", "moving_average", "smoothed")


def blended(current: Column, mean: Column, weight: float | None = 0.98, growth: float = 1.02) -> Column:
    """A short forecast: the mean and the current value by weight, or the mean times growth where weight is None."""
    return mean * growth if weight is None else mean * weight + current * (1 - weight)


def calendar_features(ts: str, holidays: tuple = ((1, 1), (12, 25))) -> dict[str, Column]:
    """Hour, weekday and month on circles, and whether the day is one of the holidays (month, day)."""
    circle = lambda c, n: {"sin": F.sin(c * (2 * 3.141592653589793 / n)), "cos": F.cos(c * (2 * 3.141592653589793 / n))}
    parts = {"hour": (F.hour(ts), 24), "weekday": (F.weekday(F.col(ts)), 7), "month": (F.month(ts), 12)}
    out = {f"{name}_{f}": x for name, (c, n) in parts.items() for f, x in circle(c, n).items()}
    return out | {"is_holiday": F.struct(F.month(ts), F.dayofmonth(ts)).isin(*[F.struct(F.lit(m), F.lit(d)) for m, d in holidays])}


def equipment_features(df: DataFrame, keys: list[str], order: list[str], load: str, volts: str, rows: int = 24) -> DataFrame:
    """Sums, means, extremes and variance of the load's last rows, distance from 230 volts, and how often it was over 10 of them."""
    frame = ordered(keys, order).rowsBetween(-(rows - 1), 0)
    off = F.abs(F.col(volts) - 230)
    parts = {"load_sum": F.sum(load), "load_mean": F.avg(load), "load_max": F.max(load), "load_var": F.var_samp(load), "voltage_faults": F.count(F.when(off > 10, 1))}
    high = F.percentile(load, F.lit(0.9)).over(frame)
    return df.withColumns({f"{n}_{rows}": f.over(frame) for n, f in parts.items()} | {"voltage_off": off, "is_peak": F.coalesce(F.col(load) > high, F.lit(False))})
