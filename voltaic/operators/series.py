"""Series by key: a regular grid, values between known ones, autoregressive and seasonal models from sums.

Lags are dealt by key and place in the series, and neighbours carried over buckets of time, so a key that holds most of the
rows is no one task's.
"""

from __future__ import annotations

from math import comb, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltaic.operators import steps

#: Grid points that one array holds at most.
_CHUNK = 10_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _same(a: list[str], b: list[str]) -> Column:
    test = F.lit(True)
    for x, y in zip(a, b, strict=True):
        test = test & F.col(x).eqNullSafe(F.col(y))
    return test


def resample(df: DataFrame, keys: list[str], ts: str, tie: str, seconds: int, means: list[str], firsts: list[str] = ()) -> DataFrame:
    """(keys, ts, n, means, firsts): a row for each step of a key's time, from its first to its last: the mean of numbers, of other
    columns the first value that isn't null (by time, then tie). Steps without rows have n 0 and nulls. Rows without a time are left out.
    """
    step = seconds * 1_000_000
    order = F.struct(ts, tie)
    at = F.floor(_micros(ts) / step).cast("long")
    found = df.filter(F.col(ts).isNotNull()).withColumn("_at", at).groupBy(*keys, "_at").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in means], *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in firsts],
    )
    found = steps.cut(found)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    spans = found.groupBy(*named).agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    parts = spans.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_hi") - F.col("_lo")) / _CHUNK))))
    begin = F.col("_lo") + F.col("_part") * _CHUNK
    grid = parts.withColumn("_grid", F.explode(F.sequence(begin, F.least(F.col("_hi"), begin + (_CHUNK - 1)))))
    own = [f"_k{i}" for i in range(len(keys))]
    out = grid.join(found, _same(own, keys) & (F.col("_grid") == F.col("_at")), "left")
    time = F.timestamp_micros(F.col("_grid") * step).cast(df.schema[ts].dataType).alias(ts)
    return out.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], time, F.coalesce("n", F.lit(0).cast("long")).alias("n"), *means, *firsts)


def interpolate(df: DataFrame, keys: list[str], ts: str, tie: str, value: str, how: str = "time", bucket: int = 86_400) -> DataFrame:
    """df with nulls of value between two known ones of its key on the straight line between them: by time, or (linear) by
    place in the order of ts and tie. What follows the last known value takes it; what comes before the first stays null,
    as do rows without a time and values that are NaN.

    Neighbours are sought within buckets of time and then over buckets, of which each has one row, so only a bucket's
    rows of a key come together in a task.
    """
    if how not in ("time", "linear"):
        raise ValueError("time or linear")
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    timed = df.withColumns({"_bucket": F.floor(_micros(ts) / (bucket * 1_000_000)).cast("long"), "_known": known & F.col(ts).isNotNull()})
    timed = steps.cut(timed)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(ts, tie)
    rows = timed.filter(F.col(ts).isNotNull()).withColumns({"_place": F.row_number().over(inner).cast("long"), "_micros": _micros(ts)})
    point = F.when(F.col("_known"), F.struct("_micros", "_place", F.col("_bucket").alias("_in"), F.col(value).cast("double").alias("_v")))
    rows = rows.withColumn("_point", point)
    back, on = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"_before": F.last("_point", True).over(back), "_after": F.first("_point", True).over(on)})
    own = [f"_k{i}" for i in range(len(keys))]
    sums = rows.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col("_bucket").alias("_b")).agg(
        F.count("*").alias("_n"), F.max_by("_point", F.when(F.col("_known"), F.col("_place"))).alias("_last"), F.min_by("_point", F.when(F.col("_known"), F.col("_place"))).alias("_first"))
    over = Window.partitionBy(*own).orderBy("_b")
    past, future = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    offset = F.coalesce(F.sum("_n").over(past), F.lit(0).cast("long"))
    sums = steps.cut(sums.withColumn("_offset", offset))
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["_micros"].alias("_micros"), (F.col(c)["_place"] + F.col("_offset")).alias("_place"), F.col(c)["_v"].alias("_v")))
    sums = sums.withColumns({"_earlier": F.last(place("_last"), True).over(past), "_later": F.first(place("_first"), True).over(future)})
    sums = sums.select(*own, "_b", "_offset", "_earlier", "_later")
    out = rows.join(sums, _same(keys, own) & (F.col("_bucket") == F.col("_b")))
    a, b = F.coalesce(place("_before"), F.col("_earlier")), F.coalesce(place("_after"), F.col("_later"))
    x = F.col("_micros") if how == "time" else F.col("_place") + F.col("_offset")
    scale = "_micros" if how == "time" else "_place"
    share = F.try_divide((x - a[scale]).cast("double"), (b[scale] - a[scale]).cast("double"))
    between = F.when(b.isNull(), a["_v"]).otherwise(a["_v"] + (b["_v"] - a["_v"]) * F.coalesce(share, F.lit(0.0)))
    filled = F.when(F.col("_known"), F.col(value).cast("double")).otherwise(between).alias(value)
    out = out.select(*[filled if c == value else F.col(c) for c in df.columns])
    bare = timed.filter(F.col(ts).isNull()).select(*[F.col(c).cast("double").alias(c) if c == value else F.col(c) for c in df.columns])
    return out.unionByName(bare)


def lagged(df: DataFrame, keys: list[str], index: str, values: list[str], lags: int) -> DataFrame:
    """(keys, index, <v>_0, ... <v>_lags) of the places of a series that have a value and all the lags before. index is a whole number, unique for a key."""
    sent = df.select(*keys, F.col(index).cast("long").alias("_from"), *values, F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("_lag"))
    pick = lambda v, k: F.max(F.when(F.col("_lag") == k, F.col(v).cast("double"))).alias(f"{v}_{k}")
    rows = sent.groupBy(*keys, (F.col("_from") + F.col("_lag")).alias(index)).agg(*[pick(v, k) for v in values for k in range(lags + 1)])
    return rows.dropna(subset=[f"{v}_{k}" for v in values for k in range(lags + 1)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(sums: pd.Series) -> pd.Series:
    """Least squares from the sums of products of regressors and target, the target last, row after row of the upper triangle."""

    def one(s):
        s = np.asarray(s, float)
        k = int((np.sqrt(8 * len(s) + 1) - 1) / 2)
        full = np.zeros((k, k))
        full[np.triu_indices(k)] = s
        full = full + np.triu(full, 1).T
        return np.linalg.lstsq(full[:-1, :-1], full[:-1, -1], rcond=None)[0].tolist()

    return sums.map(one)


def regress(df: DataFrame, keys: list[str], regressors: list[Column], target: Column) -> DataFrame:
    """(keys, coef, n): each key's least squares of the target on the regressors, from sums; of several solutions the least. Rows with a null are left out."""
    parts = [*regressors, target]
    named = df.select(*keys, *[c.cast("double").alias(f"_{i}") for i, c in enumerate(parts)]).dropna(subset=[f"_{i}" for i in range(len(parts))])
    sums = [F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i in range(len(parts)) for j in range(i, len(parts))]
    return named.groupBy(*keys).agg(F.array(*sums).alias("_s"), F.count("*").alias("n")).select(*keys, _solve("_s").alias("coef"), "n")


def _line(coef: str, terms: list[Column]) -> Column:
    return sum((F.col(coef)[i] * c for i, c in enumerate(terms)), F.lit(0.0))


def _differenced(df: DataFrame, keys: list[str], index: str, value: str, d: int) -> DataFrame:
    rows = lagged(df, keys, index, [value], d)
    return rows.select(*keys, index, sum((F.col(f"{value}_{k}") * ((-1) ** k * comb(d, k)) for k in range(d + 1)), F.lit(0.0)).alias("z"))


def arima(df: DataFrame, keys: list[str], index: str, value: str, p: int = 2, d: int = 0, q: int = 1, ahead: int = 12, long: int = 8) -> tuple[DataFrame, DataFrame]:
    """Autoregressive moving-average models of each key's series, by the two regressions of Hannan and Rissanen.

    First: (keys, const, ar, ma, n). Second: (keys, index, forecast) of the places ahead of each series' last.
    A long autoregression gives estimates of the shocks; the value is then regressed on its own p lags and the q last
    shocks, after d differences. Shocks to come are 0. Series are regular (see resample); places with a gap in
    their lags take no part; a key without a place that has all lags has no model.
    """
    z = steps.cut(_differenced(df, keys, index, value, d))
    deep = steps.cut(lagged(z, keys, index, ["z"], long))
    first = [F.lit(1.0), *[F.col(f"z_{k}") for k in range(1, long + 1)]]
    model = regress(deep, keys, first, F.col("z_0")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("coef").alias("_c"))
    shocks = deep.join(model, _same(keys, [f"_{k}" for k in keys])).select(*keys, index, F.col("z_0").alias("z"), (F.col("z_0") - _line("_c", first)).alias("e"))
    shocks = steps.cut(shocks)
    back = max(p, q, 1)
    rows = lagged(shocks, keys, index, ["z", "e"], back)
    terms = [F.lit(1.0), *[F.col(f"z_{k}") for k in range(1, p + 1)], *[F.col(f"e_{k}") for k in range(1, q + 1)]]
    coef = steps.cut(regress(rows, keys, terms, F.col("z_0")))
    some = lambda first, n, name: (F.slice("coef", first, n) if n else F.array().cast("array<double>")).alias(name)
    told = coef.select(*keys, F.col("coef")[0].alias("const"), some(2, p, "ar"), some(2 + p, q, "ma"), "n")

    def tail(frame: DataFrame, c: str, n: int, name: str) -> DataFrame:
        """The last n values of each key, the newest first; as many rows a key are gathered."""
        end = frame.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(index).alias("_end"))
        near = frame.join(end, _same(keys, [f"_{k}" for k in keys])).filter(F.col(index) > F.col("_end") - max(1, n))
        held = F.transform(F.sort_array(F.collect_list(F.struct(index, c)), asc=False), lambda x: x[c])
        return near.groupBy(*keys).agg(held.alias(name), F.max("_end").alias(f"{name}_end"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def onward(c: pd.Series, zs: pd.Series, es: pd.Series, ys: pd.Series) -> pd.Series:
        def one(c, zs, es, ys):
            zs, es, levels = list(zs), list(es), list(ys)
            if len(zs) < p or len(es) < q or len(levels) < d:
                return None
            out = []
            for _ in range(ahead):
                new = c[0] + sum(c[1 + k] * zs[k] for k in range(p)) + sum(c[1 + p + k] * es[k] for k in range(q))
                zs, es = [new, *zs], [0.0, *es]
                level = new - sum((-1) ** k * comb(d, k) * levels[k - 1] for k in range(1, d + 1))
                levels = [level, *levels]
                out.append(level)
            return out

        return pd.Series([one(*x) for x in zip(c, zs, es, ys, strict=True)])

    last = coef
    for frame, c, n, name in ((shocks, "z", p, "_z"), (shocks, "e", q, "_e"), (df.select(*keys, index, F.col(value).cast("double").alias("y")), "y", d, "_y")):
        got = tail(frame, c, n, name)
        last = last.join(got.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], name, f"{name}_end"), _same(keys, [f"{name}_{k}" for k in keys]))
    steps_ahead = last.select(*keys, F.col("_z_end"), F.posexplode(onward("coef", "_z", "_e", "_y")).alias("_i", "forecast"))
    return told, steps_ahead.select(*keys, (F.col("_z_end") + F.col("_i") + 1).alias(index), "forecast")


def seasonal(df: DataFrame, train: Column, keys: list[str], index: str, value: str, period: int, waves: int = 3) -> DataFrame:
    """df with fitted: a straight trend and waves sines and cosines of a period of places, by least squares over the rows of
    each key where train holds; null for keys without such rows."""
    place = F.col(index).cast("double")
    turns = [place * (2 * pi * k / period) for k in range(1, waves + 1)]
    terms = [F.lit(1.0), place, *[f(t) for t in turns for f in (F.sin, F.cos)]]
    model = regress(df.filter(train), keys, terms, F.col(value)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("coef").alias("_c"))
    return df.join(model, _same(keys, [f"_{k}" for k in keys]), "left").withColumn("fitted", _line("_c", terms)).select(*df.columns, "fitted")


def errors(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """(keys, n, mae, mse, rmse, r2) of predictions; rows with a null are left out."""
    both = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    gap = F.col(actual) - F.col(predicted)
    square = F.avg(gap * gap)
    fit = (1 - F.try_divide(square, F.var_pop(actual))).alias("r2")
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), square.alias("mse"), F.sqrt(square).alias("rmse"), fit)
