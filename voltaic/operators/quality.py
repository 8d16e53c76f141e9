"""Data quality: one-pass profiles, violations, scores, remediation. DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaic.operators import ranks


def profile(df: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]], ts: str | None = None, as_of: str | None = None) -> DataFrame:
    """One row: counts, nulls and out-of-range cells of every column, duplicate keys, future times. One pass."""
    parts = [F.count("*").alias("total")]
    parts += [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns]
    for c, (low, high) in ranges.items():
        parts += [F.count_if((F.col(c) < low) | (F.col(c) > high)).alias(f"{c}_out"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_avg")]
    parts.append((F.count("*") - F.count_distinct(F.struct(*keys))).alias("duplicates"))
    if ts:
        parts.append(F.count_if(F.col(ts) > F.lit(as_of).cast("timestamp_ntz")).alias("future"))
    return df.agg(*parts)


def dimension_scores(profiled: DataFrame, columns: list[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Completeness, validity, uniqueness, timeliness, their mean and its level, from a profile."""
    total = F.col("total").cast("double")
    nulls = sum((F.col(f"{c}_nulls") for c in columns[1:]), F.col(f"{columns[0]}_nulls"))
    names = list(ranges)
    outs = sum((F.col(f"{c}_out") for c in names[1:]), F.col(f"{names[0]}_out"))
    share = lambda bad, all_: F.coalesce(1 - F.try_divide(bad.cast("double"), all_), F.lit(1.0))
    out = profiled.select(share(nulls, total * len(columns)).alias("completeness"), share(outs, total * len(names)).alias("validity"), share(F.col("duplicates"), total).alias("uniqueness"), share(F.col("future"), total).alias("timeliness"))
    parts = [F.col(c) for c in out.columns]
    mean = sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
    return out.withColumn("overall", mean).withColumn("level", F.when(F.col("overall") >= 0.95, "excellent").when(F.col("overall") >= 0.85, "good").when(F.col("overall") >= 0.7, "fair").when(F.col("overall") >= 0.5, "poor").otherwise("critical"))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every row and rule whose condition is false; a null condition passes. One scan."""
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in rules.items()]))
    return df.select(key, F.explode(failed).alias("rule"))


def forward_fill(df: DataFrame, column: str, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def backward_fill(df: DataFrame, column: str, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(column, F.first(column, ignorenulls=True).over(w))


def fill_with(df: DataFrame, column: str, statistic: str = "mean") -> DataFrame:
    """Nulls become the column's mean or median; the statistic is one row, broadcast."""
    value = df.agg(F.avg(column).alias("_fill")) if statistic == "mean" else ranks.quantiles(df, column, [0.5]).select(F.col("q")[0].alias("_fill"))
    return df.crossJoin(F.broadcast(value)).withColumn(column, F.coalesce(column, "_fill")).drop("_fill")


def drop_sparse(df: DataFrame, most: float = 0.5) -> DataFrame:
    """Rows with at most this share of null cells."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns[1:]), F.col(df.columns[0]).isNull().cast("int"))
    return df.filter(nulls / F.lit(float(len(df.columns))) <= most)


def without_outliers(df: DataFrame, column: str, method: str = "iqr", limit: float = 1.5) -> DataFrame:
    """Rows inside limit quartile ranges around the quartiles, or inside limit deviations of the mean; nulls stay."""
    if method == "iqr":
        s = ranks.quantiles(df, column, [0.25, 0.75]).withColumnRenamed("q", "_q").select((F.col("_q")[0] - (F.col("_q")[1] - F.col("_q")[0]) * limit).alias("_lo"), (F.col("_q")[1] + (F.col("_q")[1] - F.col("_q")[0]) * limit).alias("_hi"))
    else:
        s = df.agg((F.avg(column) - F.stddev(column) * limit).alias("_lo"), (F.avg(column) + F.stddev(column) * limit).alias("_hi"))
    return df.crossJoin(F.broadcast(s)).filter(F.col(column).isNull() | F.col(column).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def orphans(child: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    """Different child values without a parent."""
    values = child.select(F.col(column)).filter(F.col(column).isNotNull()).distinct()
    return values.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


#: The shapes of the format checks, from the start of the value on.
FORMATS = {"email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "phone": r"^\+?1?\d{9,15}"}


def has_format(value: Column, kind: str) -> Column:
    """Whether a value has a format: email, phone or date; nulls and unknown formats pass."""
    if kind == "date":
        return value.isNull() | F.try_to_timestamp(value).isNotNull()
    return F.coalesce(value.rlike(FORMATS[kind]), F.lit(True)) if kind in FORMATS else F.lit(True)


#: The share of each dimension in the weighted score.
WEIGHTS = {"completeness": 0.25, "accuracy": 0.25, "consistency": 0.20, "validity": 0.15, "uniqueness": 0.10, "timeliness": 0.05}


def combined_scores(scores: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted, geometric and harmonic means of the dimensions that scores has; a dimension of 0 makes the last two 0."""
    held = {n: w for n, w in weights.items() if n in scores.columns}
    total, n = sum(held.values()), float(len(held))
    add = lambda parts: sum(parts[1:], parts[0])
    least = F.least(*map(F.col, held)) if len(held) > 1 else F.col(next(iter(held)))
    return scores.withColumns(
        {
            "weighted": add([F.col(c) * w for c, w in held.items()]) / F.lit(total),
            "geometric": F.when(least > 0, F.exp(add([F.ln(F.when(F.col(c) > 0, F.col(c))) for c in held]) / F.lit(n))).otherwise(0.0),
            "harmonic": F.when(least > 0, F.lit(n) / add([F.try_divide(F.lit(1.0), F.col(c)) for c in held])).otherwise(0.0),
        }
    )


def column_report(df: DataFrame, columns: list[str], ranges: dict[str, tuple[float, float]], pass_at: float = 95.0) -> DataFrame:
    """(check, column, share, passed) of the completeness of columns and the ranges of some, from one pass over df."""
    total = F.count("*")
    present = {("completeness", c): F.count(c) for c in columns}
    inside = {("range", c): F.count_if(F.coalesce(F.col(c).between(*b), F.lit(True))) for c, b in ranges.items()}
    checks = present | inside
    one = df.agg(F.array(*[F.struct(F.lit(kind).alias("check"), F.lit(c).alias("column"), F.coalesce(F.try_divide(n * 100.0, total), F.lit(100.0)).alias("share")) for (kind, c), n in checks.items()]).alias("_r"))
    return one.select(F.explode("_r").alias("r")).select("r.*", (F.col("r.share") >= pass_at).alias("passed"))


def without_outliers_in_turn(df: DataFrame, columns: list[str], method: str = "iqr", limit: float = 1.5) -> DataFrame:
    """Outliers of one column after the other are removed; each column's bounds come from the rows the earlier ones left."""
    for c in columns:
        df = without_outliers(df, c, method, limit)
    return df
