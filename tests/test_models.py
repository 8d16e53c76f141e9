"""Queries that fit models, held against numpy or against what a right answer must reach; ranks and tables against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.operators import cep, drift, joins, learning, ranks, sourcing
from voltaic.plans.registry import QUERIES
from voltaic.sources import registry
from voltaic.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_failure_risk_ranks_failures_first(spark):
    got = QUERIES["failure_risk"](spark, SF).toPandas()
    bad, good = got[got.failed == 1].risk, got[got.failed == 0].risk
    assert len(bad) > 10 and np.mean([(b > good).mean() for b in bad]) > 0.95 and got.risk.between(0, 1).all()


def test_forecasts_beat_the_mean_of_the_past(spark):
    got = QUERIES["forecast_errors"](spark, SF).first()
    spread = spark.read.parquet(f"{SF}/events.parquet").agg(F.stddev("value")).first()[0]
    assert got.n > 100 and 0 < got.mae <= got.rmse < 1.3 * spread


def test_component_drift_is_that_of_numpy(spark):
    rng = np.random.default_rng(1)
    ref, cur = rng.normal(size=(400, 3)) @ np.array([[3, 1, 0], [0, 1, 0.5], [0, 0, 0.2]]), rng.normal(size=(300, 3)) + [0, 2.0, 0]
    frames = [spark.createDataFrame([tuple(map(float, x)) for x in a], "a double, b double, c double") for a in (ref, cur)]
    got = {r.component: r.ks for r in learning.component_drift(*frames, ["a", "b", "c"]).collect()}
    mean, std = ref.mean(0), ref.std(0, ddof=1)
    values, axes = np.linalg.eigh(np.cov(((ref - mean) / std).T))
    for k, axis in enumerate(axes.T[np.argsort(-values)]):
        x, y = np.sort((ref - mean) / std @ axis), np.sort((cur - mean) / std @ axis)
        at = np.concatenate([x, y])
        assert got[k] == pytest.approx(np.abs(np.searchsorted(x, at, "right") / len(x) - np.searchsorted(y, at, "right") / len(y)).max(), abs=1e-9)
    assert [r.component for r in QUERIES["component_drift"](spark, SF).collect()] == [0, 1, 2]


def test_far_rows_are_cluster_anomalies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=2) + (5 * (i % 4)))) for i in range(400)] + [(1000, 60.0, -60.0)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double")
    got = learning.cluster_distances(df, ["a", "b"], k=3).filter("is_anomaly").collect()
    assert len(got) <= 8
    assert QUERIES["cluster_anomalies"](spark, SF).filter("distance < 0 or cluster not between 0 and 3").count() == 0


def test_the_telling_features_are_selected(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(*map(float, r), float(2 * r[1] + 0.1 * rng.normal())) for r in x], "a double, b double, c double, y double")
    out = learning.best_features(["a", "b", "c"], "y", 1).fit(df).transform(df).collect()
    assert all(r.features[0] == r.b for r in out)
    assert {len(r.features) for r in QUERIES["selected_features"](spark, SF).collect()} == {2}


@pytest.mark.parametrize("cells", [2, 7, 500])
def test_running_sums_and_quantiles(spark, cells):
    values = np.random.default_rng(cells).integers(0, 60, 500).tolist()
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    counts = df.filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    got = {r.v: (r.before_n, r.next_v if "next_v" in r else r.next_x) for r in ranks.running(counts, "v", ["n"], cells).collect()}
    seen = sorted(set(values))
    assert got == {v: (sum(x < v for x in values), seen[i + 1] if i + 1 < len(seen) else None) for i, v in enumerate(seen)}
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    assert ranks.quantiles(df, "v", shares).first().q == pytest.approx(np.quantile(values, shares).tolist())
    assert ranks.quantiles(df.limit(0), "v", [0.5]).first().q == [None]


def test_one_hot_key_goes_through_joins_sequences_and_places(spark):
    """A third of the rows in one key, the rest spread; results as brute force has them."""
    rng = np.random.default_rng(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(int(0 if i % 3 == 0 else rng.integers(1, 40)), t0 + dt.timedelta(seconds=int(rng.integers(0, 50_000))), i) for i in range(600)]
    a = spark.createDataFrame(rows[::2], "k int, ts timestamp_ntz, i int")
    b = spark.createDataFrame(rows[1::2], "k int, b_ts timestamp_ntz, j int")
    near = {(x[2], y[2]) for x in rows[::2] for y in rows[1::2] if x[0] == y[0] and abs((x[1] - y[1]).total_seconds()) <= 60}
    left = {(x[2], None) for x in rows[::2] if x[2] not in {p[0] for p in near}}
    right = {(None, y[2]) for y in rows[1::2] if y[2] not in {p[1] for p in near}}
    for how, want in (("inner", near), ("left", near | left), ("right", near | right), ("full", near | left | right)):
        assert {(r.i, r.j) for r in joins.interval_join(a, b, ["k"], "ts", "b_ts", 60, how).collect()} == want, how
    kinds = ["A", "B", "C"]
    events = [(k, t, i, kinds[int(rng.integers(0, 3))]) for k, t, i in rows]
    got = {r.k: r.matched for r in cep.sequence(spark.createDataFrame(events, "k int, t timestamp_ntz, i int, e string"), ["k"], "t", "i", "e", ["A", "B", "C", "A"]).collect()}
    for k in {r[0] for r in rows}:
        n = 0
        for _, _, e in sorted((t, i, e) for kk, t, i, e in events if kk == k):
            n += n < 4 and e == ["A", "B", "C", "A"][n]
        assert got[k] == n
    places = [(f"p{i:03}", float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.normal(size=(40, 2)), 2))] + [("far", 500.0, 500.0)]
    spots = [(float(x), float(y)) for x, y in np.round(rng.normal(size=(60, 2)) * 3, 2)] + [(480.0, 510.0), (-300.0, 2.0)]
    found = joins.nearest(spark.createDataFrame(spots, "lat double, lon double"), spark.createDataFrame(places, "key string, lat double, lon double"), "lat", "lon", "key").collect()
    want = {s: min((((s[0] - p[1]) ** 2 + (s[1] - p[2]) ** 2) ** 0.5, p[0]) for p in places) for s in spots}
    assert len(found) == len(spots) and all(r.distance == pytest.approx(want[r.lat, r.lon][0]) and r.nearest_key == want[r.lat, r.lon][1] for r in found)


def test_drift_of_near_unique_values(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=700), rng.normal(size=500) + 0.3
    a, b = (spark.createDataFrame([(float(v),) for v in s], "v double") for s in (x, y))
    at = np.sort(np.concatenate([x, y]))
    gaps = np.abs(np.searchsorted(np.sort(x), at, "right") / len(x) - np.searchsorted(np.sort(y), at, "right") / len(y))
    assert drift.kolmogorov_smirnov(a, b, "v").first().ks == pytest.approx(gaps.max())
    assert drift.wasserstein(a, b, "v").first().wasserstein == pytest.approx((gaps[:-1] * np.diff(at)).sum())


def test_upserts_keep_history(spark, tmp_path):
    run = jobs.upsert(["k"], "t", f"{tmp_path}/t", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k int, t int, v string")
    run(frame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]), 0)
    run(frame([(1, 3, "d"), (2, 0, "late")]), 5)  # batch numbers may have gaps
    run(frame([(1, 3, "d"), (2, 0, "late")]), 5)  # and come again
    state = lambda: {r.k: r.v for r in jobs.current(spark, f"{tmp_path}/t").collect()}
    assert state() == {1: "d", 2: "b", 3: "c"} and jobs.versions(spark, f"{tmp_path}/t") == [0, 5]
    run(frame([(4, 1, "e")]), 6)
    assert state() == {1: "d", 2: "b", 3: "c", 4: "e"}
    with pytest.raises(ValueError, match="holds version"):
        run(frame([(9, 1, "x")]), 2)


def test_appends_expect_a_version(spark):
    store = spark.createDataFrame([("a", 1), ("a", 2)], "k string, version long")
    new = spark.createDataFrame([("a", 10, 2), ("a", 11, 2), ("b", 12, 0), ("c", 13, 4)], "k string, at long, expected_version long")
    accepted, refused = sourcing.append(store, new, ["k"], ["at"])
    assert sorted((r.k, r.at, r.version) for r in accepted.collect()) == [("a", 10, 3), ("a", 11, 4), ("b", 12, 1)]
    assert [(r.k, r.stored) for r in refused.collect()] == [("c", 0)]


def test_sinks_and_sources_by_name(spark, tmp_path):
    assert registry.jdbc_options({"url": "jdbc:x", "dbtable": "t", "batch_rows": 5})["batchsize"] == "5"
    with pytest.raises(ValueError):
        registry.jdbc_options({"url": "jdbc:x"})
    for name in "ab":
        registry.write(spark.range(3 if name == "a" else 4), f"{tmp_path}/{name}")
    named = registry.Sources({n: {"type": "parquet", "path": f"{tmp_path}/{n}"} for n in "ab"}, "a", {"B_PATH": f"{tmp_path}/a"})
    assert named.read(spark).count() == 3 and named.read(spark, "b").count() == 3
    named.switch("b")
    assert named.primary == "b"
    with pytest.raises(ValueError):
        named.switch("c")
    messages = spark.createDataFrame([(b"k", b'{"m": "x", "v": 1.5}', "t", 0, 7, dt.datetime(2024, 1, 1))], "key binary, value binary, topic string, partition int, offset long, timestamp timestamp")
    messages.write.parquet(f"{tmp_path}/kafka")
    stream = registry.parse_messages(spark.readStream.schema(messages.schema).parquet(f"{tmp_path}/kafka"), "m string, v double")
    got = jobs.drain(stream, f"{tmp_path}/parsed").first()
    assert (got.m, got.v, got.message_offset) == ("x", 1.5, 7)
    assert registry.kafka_options({"servers": "s", "topic": "t", "offsets": "latest"})["startingOffsets"] == "latest"
