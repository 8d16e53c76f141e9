"""Crowded places, long decays, many different values, detectors by window: what a hot key or a crowd must not break."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltaic.functions import ladders
from voltaic.operators import cep, joins, ranks, windows


@pytest.mark.parametrize("levels", [24, 4])
def test_nearest_of_a_crowd(spark, monkeypatch, levels):
    """Most places stand in one spot of the map, many spots far from it; ties go to the smaller key; 4 levels leave places together."""
    monkeypatch.setattr(joins, "LEVELS", levels)
    rng = np.random.default_rng(3)
    city = rng.normal(size=(800, 2)) * 1e-4 + [48, 11]
    places = [(f"p{i:04}", *map(float, p)) for i, p in enumerate(np.concatenate([city, rng.uniform(-60, 60, size=(40, 2)), [[0.0, 0.0], [0.0, 0.0], [2.0, 0.0]]]))]
    spots = [tuple(map(float, s)) for s in np.concatenate([rng.normal(size=(60, 2)) * 2e-4 + [48, 11], rng.uniform(-90, 90, size=(60, 2)), [[1.0, 0.0], [500.0, -500.0]]])]
    df = spark.createDataFrame([*spots, (None, 1.0), spots[0]], "lat double, lon double")
    got = {(r.lat, r.lon): (r.nearest_key, r.distance) for r in joins.nearest(df, spark.createDataFrame([*places, ("none", None, 1.0)], "key string, lat double, lon double"), "lat", "lon", "key").collect()}
    assert len(got) == len(spots)
    for s in spots:
        far, key = min((((s[0] - p[1]) ** 2 + (s[1] - p[2]) ** 2, p[0]) for p in places))
        assert got[s] == (key, pytest.approx(far**0.5)), s
    assert joins.nearest(df, spark.createDataFrame([], "key string, lat double, lon double"), "lat", "lon", "key").count() == 0
    one = spark.createDataFrame([("a", 1.0, 1.0)], "key string, lat double, lon double")
    assert {r.nearest_key for r in joins.nearest(df, one, "lat", "lon", "key").collect()} == {"a"}


@pytest.mark.parametrize("alpha", [0.02, 0.3, 0.9, 1.0])
def test_exponential_means_are_those_of_pandas(spark, alpha):
    rng = np.random.default_rng(4)
    rows = [(k, i, None if i < 2 or rng.random() < 0.2 else float(rng.normal() * 10 + 100)) for k, n in (("hot", 1500), ("b", 7), (None, 40)) for i in range(n)]
    got = {(r.k, r.i): r.v_ewm for r in windows.ewm(spark.createDataFrame(rows, "k string, i int, v double"), "v", ["k"], ["i"], alpha).collect()}
    assert len(got) == len(rows)
    for key in ("hot", "b", None):
        own = pd.Series([v for k, _, v in rows if k == key], dtype=float)
        want = own.dropna().ewm(alpha=alpha, adjust=True).mean().reindex(own.index).ffill()
        mine = [got[key, i] for i in range(len(own))]
        assert [m is None for m in mine] == want.isna().tolist()
        assert [m for m in mine if m is not None] == pytest.approx(want.dropna().tolist(), rel=1e-9)


def test_estimates_of_many_different_values(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 20_000).alias("v"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    kept = windows.distinct_sketches(df, ["k"], "ts", "v")
    assert kept.select("day").distinct().count() > 30
    exact = {r.k: r.n for r in df.groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
    got = {r.k: r.estimate for r in windows.distinct_estimates(kept, ["k"]).collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - n) <= 5 * 1.04 / 64 * n for k, n in exact.items())


def test_cells_follow_the_session(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).cast("double").alias("x"), F.lit(1).alias("n"))
    got = ranks.running(df, "x", ["n"])
    assert got.filter("before_n <> x or (x < 4999 and next_x <> x + 1)").count() == 0


def test_detectors_see_a_window_of_a_key(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(hours=h), float(h)) for k in ("a", None) for h in range(0, 72, 5)] + [("a", None, 9.0)]
    seen = lambda part: pd.DataFrame({"k": part["k"].iloc[:1], "n": [len(part)], "at": part["window_start"].iloc[:1]})
    got = cep.custom(spark.createDataFrame(rows, "k string, ts timestamp, v double"), ["k"], seen, "k string, n long, at timestamp", "ts", "1 day").collect()
    assert sorted((r.k or "", r.at.day, r.n) for r in got) == sorted((k, d, n) for k in ("", "a") for d, n in ((1, 5), (2, 5), (3, 5)))


def test_fair_rounding(spark):
    x = spark.createDataFrame([(0.1 + 0.2,), (1.000005,), (0.29999499999999999,), (None,), (-2.5e-6,)], "x double")
    assert [r[0] for r in x.select(ladders.fair(F.col("x"), 5)).collect()] == [0.3, 1.00001, 0.3, None, 0.0]
