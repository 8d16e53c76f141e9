"""Drift between a reference and a current sample, and comparisons of two groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaic.operators import ranks, steps


def population_stability(reference: DataFrame, current: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """One row, psi: over bins between the reference's quantiles; empty bins count as one in ten thousand."""
    cuts = ranks.quantiles(reference, column, [i / bins for i in range(1, bins)]).withColumnRenamed("q", "_c")
    sides = reference.select(F.col(column).alias("x"), F.lit(1).alias("ref")).unionAll(current.select(F.col(column).alias("x"), F.lit(0).alias("ref")))
    binned = sides.crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("_c", lambda c: c < F.col("x"))))
    counts = binned.groupBy("bin").agg(F.sum("ref").alias("r"), F.sum(1 - F.col("ref")).alias("c"))
    grid = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left")
    everything = Window.partitionBy()
    share = lambda c: F.greatest(F.coalesce(F.col(c) / F.sum(c).over(everything), F.lit(0.0)), F.lit(1e-4))
    return grid.select(share("r").alias("p"), share("c").alias("q")).agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def jensen_shannon(reference: DataFrame, current: DataFrame, column: str, bins: int = 49) -> DataFrame:
    """One row, js: the divergence of equal-width histograms over both samples' range, in nats."""
    sides = reference.select(F.col(column).alias("x"), F.lit(1).alias("ref")).unionAll(current.select(F.col(column).alias("x"), F.lit(0).alias("ref")))
    span = sides.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    bin_ = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = sides.crossJoin(F.broadcast(span)).groupBy(F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.sum("ref").alias("r"), F.sum(1 - F.col("ref")).alias("c"))
    everything = Window.partitionBy()
    p, q = F.col("r") / F.sum("r").over(everything), F.col("c") / F.sum("c").over(everything)
    term = lambda a, m: F.when(a > 0, a * F.log(a / m)).otherwise(0.0)
    shares = counts.select(p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    return shares.agg((F.sum(term(F.col("p"), F.col("m"))) / 2 + F.sum(term(F.col("q"), F.col("m"))) / 2).alias("js"))


def kolmogorov_smirnov(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """One row, ks: the largest gap of the two distribution functions, from counts of each different value; nulls don't count."""
    return _gaps(reference, current, column).agg(F.max("gap").alias("ks"))


def _gaps(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(x, next_x, gap): how far the two distribution functions lie apart from each value to the next."""
    sides = reference.select(F.col(column).alias("x"), F.lit(1).alias("ref")).unionAll(current.select(F.col(column).alias("x"), F.lit(0).alias("ref")))
    counts = steps.cut(sides.filter("x is not null").groupBy("x").agg(F.sum("ref").alias("r"), F.sum(1 - F.col("ref")).alias("c")))
    sizes = counts.agg(F.sum("r").alias("all_r"), F.sum("c").alias("all_c"))
    upto = lambda side: F.try_divide(F.col(f"before_{side}") + F.col(side), F.col(f"all_{side}"))
    rows = ranks.running(counts, "x", ["r", "c"]).crossJoin(F.broadcast(sizes))  # sizes is one row
    return rows.select("x", "next_x", F.abs(upto("r") - upto("c")).alias("gap"))


def two_groups(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Size, mean and deviation of two groups (true and false), the pooled t and Cohen's d."""
    s = lambda f, side: f(F.when(group if side else ~group, F.col(value)))
    out = df.agg(*[s(f, side).alias(f"{n}_{'b' if side else 'a'}") for side in (False, True) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2)
    gap = F.col("mean_b") - F.col("mean_a")
    return out.withColumns({"t": gap / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b"))), "effect": gap / F.sqrt(pooled)})


def ab_variant(key: Column, test: str, split: float) -> Column:
    """B for the part split of keys, by the md5 of key and test modulo 100; a key always gets the same."""
    digest = F.md5(F.concat(key, F.lit(f"_{test}")))
    remainder = F.lit(0)
    for i in range(4):  # 2 ** 32 modulo 100 is 96
        remainder = (remainder * 96 + F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")) % 100
    return F.when(remainder / 100 < split, "B").otherwise("A")


def wasserstein(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """One row, wasserstein: the area between the two distribution functions, from counts of each different value."""
    return _gaps(reference, current, column).agg(F.sum(F.col("gap") * (F.col("next_x") - F.col("x"))).alias("wasserstein"))


def rank_test(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Mann and Whitney's U of two groups (true and false) and its z, with mean ranks for ties; ranks come from counts of each value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count_if(~group).alias("a"), F.count_if(group).alias("b"))
    rank = F.col("before_a") + F.col("before_b") + (F.col("a") + F.col("b") + 1) / 2
    out = ranks.running(counts, "x", ["a", "b"]).withColumn("_rank", rank).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("_rank") * F.col("a")).alias("_sum"))
    pairs = F.col("n_a").cast("double") * F.col("n_b")
    out = out.withColumn("u", F.col("_sum") - F.col("n_a") * (F.col("n_a") + 1) / 2)
    return out.withColumn("z", F.try_divide(F.col("u") - pairs / 2, F.sqrt(pairs * (F.col("n_a") + F.col("n_b") + 1) / 12))).drop("_sum")


def performance_drift(df: DataFrame, actual: str, predicted: str, expected_mae: float = 10.0, expected_rmse: float = 15.0, limit: float = 0.05) -> DataFrame:
    """Errors against their expected values, the larger relative excess, and whether it is over limit."""
    gap = F.col(actual) - F.col(predicted)
    out = df.agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
    worst = F.greatest((F.col("mae") - expected_mae) / expected_mae, (F.col("rmse") - expected_rmse) / expected_rmse)
    return out.withColumn("degradation", worst).withColumn("has_drift", F.coalesce(worst > limit, F.lit(False)))


def half_shapes(df: DataFrame, value: str, late: Column) -> DataFrame:
    """Count, mean, deviation, skewness and excess kurtosis of a value's earlier and later part."""
    parts = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "skew": F.skewness, "kurtosis": F.kurtosis}
    return df.groupBy(late.alias("late")).agg(*[f(value).alias(n) for n, f in parts.items()])
