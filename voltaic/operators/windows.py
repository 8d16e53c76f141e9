"""Window features over ordered rows of a key. DataFrame in, DataFrame out; ties need a unique order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from voltaic.operators import ranks


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def zscore(column: str, frame: WindowSpec) -> Column:
    """Distance from the frame's mean in sample deviations; 0 where that is null or zero."""
    deviation = F.stddev(column).over(frame)
    return F.when(deviation > 0, (F.col(column) - F.avg(column).over(frame)) / deviation).otherwise(0.0)


def centred_anomaly(df: DataFrame, columns: list[str], keys: list[str], order: list[str], reach: int = 10, limit: float = 3.0) -> DataFrame:
    """z of each column within reach rows on both sides, their mean magnitude, and whether any is over limit."""
    frame = ordered(keys, order).rowsBetween(-reach, reach)
    df = df.withColumns({f"{c}_z": zscore(c, frame) for c in columns})
    sizes = [F.abs(f"{c}_z") for c in columns]
    return df.withColumns({"z_mean": sum(sizes[1:], sizes[0]) / F.lit(float(len(sizes))), "is_outlier": F.greatest(*sizes) > limit if len(sizes) > 1 else sizes[0] > limit})


def lags(df: DataFrame, column: str, keys: list[str], order: list[str], steps: tuple = (1, 24), ahead: tuple = (), changes: tuple = ()) -> DataFrame:
    """Earlier and later values, differences and relative changes."""
    w, x = ordered(keys, order), F.col(column)
    out = {f"{column}_lag_{n}": F.lag(column, n).over(w) for n in steps} | {f"{column}_lead_{n}": F.lead(column, n).over(w) for n in ahead}
    for n in changes:
        before = F.lag(column, n).over(w)
        out |= {f"{column}_diff_{n}": x - before, f"{column}_change_{n}": F.try_divide(x - before, before)}
    return df.withColumns(out)


def trailing(df: DataFrame, column: str, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """Mean and deviation of the rows before this one, itself not counted."""
    frame = ordered(keys, order).rowsBetween(-rows, -1)
    return df.withColumns({f"{column}_avg_{rows}": F.avg(column).over(frame), f"{column}_std_{rows}": F.stddev(column).over(frame)})


def rolling(df: DataFrame, column: str, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """Mean, deviation, extremes and median of the last rows; null until there are as many."""
    frame = ordered(keys, order).rowsBetween(-(rows - 1), 0)
    full = F.count(F.lit(1)).over(frame) == rows
    parts = {"mean": F.avg(column), "std": F.stddev(column), "min": F.min(column), "max": F.max(column), "median": F.percentile(column, F.lit(0.5))}
    return df.withColumns({f"{column}_{n}_{rows}": F.when(full, f.over(frame)) for n, f in parts.items()})


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_row = 1").drop("_row")


def ewm(df: DataFrame, column: str, keys: list[str], order: list[str], alpha: float) -> DataFrame:
    """Adjusted exponentially weighted mean of a key's values so far; nulls don't count, and take the mean before them.

    Values fall into blocks in which weights fall to a ten-thousandth. Within a block sums run with weights that grow
    from its beginning; of the blocks before, as many carry on as count in a double. No row gathers others.
    """
    w = ordered(keys, order)
    keep = 1 - alpha
    block = max(1, math.floor(math.log(1e-4) / math.log(keep))) if 0 < keep < 1 else 1
    blocks = math.ceil(ranks.decay_rows(alpha) / block) + 1 if 0 < keep < 1 else 1
    n = F.count(column).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1  # place among the values
    df = df.withColumns({"_block": F.floor(n / block), "_in": (n % block).cast("double")})
    grown = F.when(F.col(column).isNotNull(), F.pow(F.lit(1 / keep if keep else 1.0), F.col("_in")))
    inner = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_s": F.sum(F.col(column) * grown).over(inner), "_w": F.sum(grown).over(inner)})
    ends = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b")).agg(
        F.max_by(F.struct("_s", "_w"), F.struct(*order)).alias("_end"), F.count(column).alias("_n"))
    over = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_b")
    # a block's sums, weighted as from the beginning of the next one; blocks before the last are full
    full = keep**block
    part = lambda c: sum((F.coalesce(F.lag(F.col("_end")[c] * full, k).over(over), F.lit(0.0)) * full ** (k - 1) for k in range(1, blocks + 1)), F.lit(0.0))
    ends = ends.withColumns({"_before_s": part("_s"), "_before_w": part("_w")}).drop("_end", "_n")
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = df.join(ends, same)
    mean = F.try_divide(F.col("_before_s") + F.coalesce("_s", F.lit(0.0)), F.col("_before_w") + F.coalesce("_w", F.lit(0.0)))
    return out.withColumn(f"{column}_ewm", mean).drop("_block", "_in", "_s", "_w", "_b", "_before_s", "_before_w", *[f"_k{i}" for i in range(len(keys))])


def distinct_sketches(df: DataFrame, keys: list[str], ts: str, value: str, bits: int = 12) -> DataFrame:
    """(keys, day, sketch): a sketch of each day's different values, to be kept and united later; nulls don't count."""
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(value, bits).alias("sketch"))


def distinct_estimates(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, estimate) of the different values of all days: exact up to some hundreds, then with a standard error of about 1.04 / sqrt(2 ** bits)."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def distinct_values(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """(keys, day, value): each day's different values, to be kept and united later; nulls don't count."""
    return df.filter(F.col(value).isNotNull()).select(*keys, F.to_date(ts).alias("day"), value).distinct()


def distinct_counts(kept: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, estimate): the different values of all days, counted exactly. Values are dealt by themselves, so a key is no one task's."""
    return kept.select(*keys, value).distinct().groupBy(*keys).agg(F.count("*").alias("estimate"))


def sliding_trend(df: DataFrame, column: str, keys: list[str], order: list[str], rows: int = 100) -> DataFrame:
    """Slope and fit of a straight line through every full window of rows."""
    w = ordered(keys, order)
    df = df.withColumn("_n", F.row_number().over(w).cast("double"))
    frame = w.rowsBetween(-(rows - 1), 0)
    full = F.col("_n") >= rows
    return df.withColumns({"slope": F.when(full, F.regr_slope(F.col(column), F.col("_n")).over(frame)), "r2": F.when(full, F.regr_r2(F.col(column), F.col("_n")).over(frame))}).drop("_n")


def global_outliers(df: DataFrame, column: str) -> DataFrame:
    """z over the whole table, percent rank with average ties, and the 1.5 IQR flag.

    Ranks and quartiles come from counts of each value, summed in cells of values. Rows whose value is null stay, have no rank and don't count: z, pct_rank and the
    flag are null.
    """
    stats = df.agg(F.avg(column).alias("_m"), F.stddev(column).alias("_s"), F.count(column).alias("_n"))
    stats = stats.crossJoin(ranks.quantiles(df, column, [0.25, 0.75]).withColumnRenamed("q", "_q"))  # one row each
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_x")).agg(F.count("*").alias("_ties"))
    placed = ranks.running(counts, "_x", ["_ties"]).select(F.col("_x").alias(column), "_ties", F.col("before__ties").alias("_below"))
    x, spread = F.col(column), (F.col("_q")[1] - F.col("_q")[0]) * 1.5
    out = df.join(placed, column, "left").crossJoin(F.broadcast(stats))  # stats is one row
    return out.withColumns({"z": (x - F.col("_m")) / F.col("_s"), "pct_rank": (F.col("_below") + (F.col("_ties") + 1) / 2) / F.col("_n"), "is_iqr_outlier": (x < F.col("_q")[0] - spread) | (x > F.col("_q")[1] + spread)}).drop("_m", "_s", "_n", "_q", "_ties", "_below")
