"""Grids, interpolation, autoregressive and seasonal models against pandas and numpy; nested privacy; rules from tables."""

import hashlib
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltaic.operators import nested, rules, series
from voltaic.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def test_resampling_is_that_of_pandas(spark, monkeypatch):
    monkeypatch.setattr(series, "_CHUNK", 7)  # long gaps come from several arrays
    rng = np.random.default_rng(1)
    minutes = np.sort(rng.choice(20_000, 80, replace=False))
    rows = [(k, T0 + timedelta(minutes=int(m)), i, None if i % 9 == 0 else float(i), None if i % 4 else f"x{i}") for i, m in enumerate(minutes) for k in ("a", None)[: 1 + i % 2]]
    df = spark.createDataFrame(rows + [("a", None, 99, 5.0, "y")], "k string, ts timestamp_ntz, id int, v double, s string")
    got = series.resample(df, ["k"], "ts", "id", 3600, ["v"], ["s"]).toPandas()
    for key in ("a", None):
        own = pd.DataFrame([r[1:] for r in rows if r[0] == key], columns=["ts", "id", "v", "s"]).set_index("ts").resample("1h").agg({"v": "mean", "s": "first", "id": "count"})
        mine = got[got.k.isna() if key is None else got.k == key].sort_values("ts").set_index("ts")
        assert mine.index.tolist() == own.index.tolist() and mine.n.tolist() == own.id.tolist()
        assert mine.v.fillna(-1).tolist() == pytest.approx(own.v.fillna(-1).tolist()) and mine.s.fillna("").tolist() == own.s.fillna("").tolist()
    assert series.resample(df.limit(0), ["k"], "ts", "id", 3600, ["v"], ["s"]).count() == 0


@pytest.mark.parametrize("how", ["time", "linear"])
@pytest.mark.parametrize("bucket", [60, 86_400, 10**7])
def test_interpolation_is_that_of_pandas(spark, how, bucket):
    """Gaps at both ends and over many buckets, ties of time, a hot key, a key without values and one with a null name."""
    rng = np.random.default_rng(2)
    rows = []
    for key, n in (("hot", 300), ("b", 20), (None, 12), ("bare", 5)):
        minutes = np.cumsum(rng.integers(1, 400, n))
        values = [None if key == "bare" or i < 3 or i >= n - 2 or rng.random() < 0.6 else float(rng.normal()) for i in range(n)]
        rows += [(key, T0 + timedelta(minutes=int(m)), i, v) for i, (m, v) in enumerate(zip(minutes, values, strict=True))]
    df = spark.createDataFrame([*rows, ("b", None, 77, 3.0), ("b", None, 78, None)], "k string, ts timestamp_ntz, id int, v double")
    got = {(r.k, r.id): r.v for r in series.interpolate(df, ["k"], "ts", "id", "v", how, bucket).collect()}
    assert len(got) == len(rows) + 2 and got["b", 77] == 3.0 and got["b", 78] is None
    for key in {r[0] for r in rows}:
        own = pd.Series({r[1]: r[3] for r in rows if r[0] == key}, dtype=float).interpolate(method=how)
        mine = [got[r[0], r[2]] for r in rows if r[0] == key]
        assert [None if v is None else round(v, 9) for v in mine] == [None if np.isnan(v) else round(v, 9) for v in own]


def test_ties_of_time(spark):
    df = spark.createDataFrame([(1, T0, 1, 2.0), (1, T0, 2, None), (1, T0, 3, 8.0)], "k int, ts timestamp_ntz, id int, v double")
    assert {r.id: r.v for r in series.interpolate(df, ["k"], "ts", "id", "v").collect()} == {1: 2.0, 2: 2.0, 3: 8.0}
    assert {r.id: r.v for r in series.interpolate(df, ["k"], "ts", "id", "v", "linear").collect()} == {1: 2.0, 2: 5.0, 3: 8.0}


def two_regressions(y, p, d, q, long, ahead):
    """Hannan and Rissanen's estimates and the forecasts, in numpy."""
    z = np.diff(y, d)
    lags = lambda x, n, m: np.stack([x[m - k : len(x) - k] for k in range(1, n + 1)], 1) if n else np.zeros((len(x) - m, 0))
    a = np.hstack([np.ones((len(z) - long, 1)), lags(z, long, long)])
    e = z[long:] - a @ np.linalg.lstsq(a, z[long:], rcond=None)[0]
    z, back = z[long:], max(p, q, 1)
    b = np.hstack([np.ones((len(z) - back, 1)), lags(z, p, back), lags(e, q, back)])
    c = np.linalg.lstsq(b, z[back:], rcond=None)[0]
    zs, es, ys, out = list(z), list(e), list(y), []
    for _ in range(ahead):
        zs.append(c[0] + sum(c[k] * zs[-k] for k in range(1, p + 1)) + sum(c[p + k] * es[-k] for k in range(1, q + 1)))
        es.append(0.0)
        level = zs[-1] + (ys[-1] if d == 1 else 0)
        ys.append(level)
        out.append(level)
    return c, out


@pytest.mark.parametrize(("p", "d", "q"), [(2, 0, 1), (1, 1, 1), (0, 0, 2), (3, 1, 0)])
def test_arima_is_that_of_numpy(spark, p, d, q):
    rng = np.random.default_rng(p + 10 * d + 100 * q)
    rows, truth = [], {}
    for key, n in (("a", 900), ("b", 60), (None, 80)):
        shock, x = rng.normal(size=n + 2), np.zeros(n)
        for i in range(2, n):
            x[i] = 1 + 0.5 * x[i - 1] - 0.3 * x[i - 2] + shock[i] + 0.4 * shock[i - 1]
        y = np.cumsum(x) if d else x
        truth[key] = two_regressions(y, p, d, q, 6, 5)
        rows += [(key, 100 + i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame([*rows, ("short", 1, 1.0)], "k string, i long, v double")
    models, ahead = series.arima(df, ["k"], "i", "v", p, d, q, ahead=5, long=6)
    got = {r.k: r for r in models.collect()}
    assert got.keys() == truth.keys()
    for key, (c, _) in truth.items():
        assert [got[key].const, *got[key].ar, *got[key].ma] == pytest.approx(c.tolist(), abs=1e-6)
    if (p, d, q) == (2, 0, 1):  # and near what the series was made with
        assert got["a"].ar == pytest.approx([0.5, -0.3], abs=0.12) and got["a"].ma == pytest.approx([0.4], abs=0.15)
    forecasts = {(r.k, r.i): r.forecast for r in ahead.collect()}
    ends = {"a": 999, "b": 159, None: 179}
    assert forecasts == {(k, ends[k] + 1 + j): pytest.approx(v, abs=1e-5) for k, (_, out) in truth.items() for j, v in enumerate(out)}


def test_seasons_are_fitted(spark):
    rng = np.random.default_rng(5)
    at = np.arange(200)
    y = {k: 3 + 0.1 * at + 2 * np.sin(2 * np.pi * at / 24 + s) + 0.01 * rng.normal(size=200) for k, s in (("a", 0.3), ("b", 1.0))}
    df = spark.createDataFrame([(k, int(i), float(v)) for k, x in y.items() for i, v in enumerate(x)] + [("new", 180, 1.0)], "k string, i long, v double")
    out = series.seasonal(df, F.col("i") < 150, ["k"], "i", "v", 24, 2)
    assert {r.k: r.fitted for r in out.filter("k = 'new'").collect()} == {"new": None}
    told = {r.k: r for r in series.errors(out.filter("i >= 150"), ["k"], "v", "fitted").collect()}
    assert told.keys() == {"a", "b"} and all(r.n == 50 and r.r2 > 0.999 and r.mae < 0.05 and r.rmse == pytest.approx(r.mse**0.5) for r in told.values())
    for name in ("arima_errors", "seasonal_errors"):
        rows = QUERIES[name](spark, SF).collect()
        assert len(rows) == 5 and all(r.n == 12 and 0 < r.mae <= r.rmse for r in rows)


# ---- nested columns

NESTED = "id long, name string, s struct<email: string, deep: struct<note: string, n: int>, `odd name`: double>, a array<struct<phone: string, k: int>>, m map<string, array<string>>, t timestamp"


@pytest.fixture
def people(spark):
    rows = [
        (1, "Ann", ("ann@x.org", ("call 555-123-4567 now", 5), 1.5), [("555-123-4567", 1), None], {"x": ["abcde", None, "ab"]}, T0),
        (2, None, None, None, None, None),
        (3, "", (None, None, None), [], {}, T0),
        (4, "123-45-6789", ("", ("plain", None), None), [(None, 2)], {"y": None}, T0),
    ]
    return spark.createDataFrame(rows, NESTED)


def digest(text, n):
    return hashlib.sha256(text.encode()).hexdigest()[:n]


def test_nested_columns_are_anonymised(people):
    got = {r.id: r for r in nested.anonymise(people, "medium", ["s", "a", "m", "t"]).collect()}
    assert got[1].s.email == "[EMAIL]" and got[1].s.deep.note == "call [PHONE] now" and got[1].s.deep.n == 5 and got[1].name == "Ann"
    assert got[1].a[0].phone == "[PHONE]" and got[1].a[1] is None and got[1].m == {"x": ["a***e", None, "**"]} and got[1].t == T0
    assert got[2].s is None and got[2].a is None and got[2].m is None
    assert got[3].s.email is None and got[3].s.deep is None and got[3].a == [] and got[3].m == {}
    high = {r.id: r for r in nested.anonymise(people, "high", ["s", "m"]).collect()}
    assert high[1].m["x"] == [digest("abcde", 8), None, digest("ab", 8)] and high[1].s.deep.n == digest("5", 8) and high[1].s["odd name"] == digest("1.5", 8)
    assert nested.anonymise(people, "low", ["m"]).select("m").collect() == people.select("m").collect()
    assert nested.anonymise(people, "medium").schema == people.schema or nested.anonymise(people, "medium").columns == people.columns


def test_nested_columns_get_pseudonyms(people):
    got = {r.id: r for r in nested.pseudonymise(people, "salt").collect()}
    assert got[1].name == digest("Annsalt", 16) and got[1].s.email == digest("ann@x.orgsalt", 16) and got[1].s.deep.note == "call 555-123-4567 now"
    assert got[1].a[0].phone == digest("555-123-4567salt", 16) and got[1].a[0].k == 1 and got[1].s["odd name"] == digest("1.5salt", 16)
    assert got[2].name is None and got[3].name == digest("salt", 16) and got[1].m == {"x": ["abcde", None, "ab"]}


def test_nested_columns_are_classified(people):
    got = {r.id: r for r in nested.classify(people, ["name", "s", "a", "m", "t"]).collect()}
    assert (got[1].name, got[1].s, got[1].a, got[1].m, got[1].t) == ("low", "medium", "medium", "low", "low")
    assert (got[4].name, got[4].s, got[4].a) == ("high", "low", "low") and {got[2].s, got[2].a, got[2].m, got[3].a} == {"low"}


# ---- rules


def test_rules_hold_by_definition(spark):
    events = [("u", 1, "a", 5.0), ("u", 2, "b", None), ("u", 3, "c", 20.0), ("v", 1, "c", 1.0), ("v", 2, "a", 2.0), (None, 1, "a", 100.0), ("w", None, "a", None)]
    df = spark.createDataFrame([(k, None if t is None else T0 + timedelta(minutes=t), i, e, v) for i, (k, t, e, v) in enumerate(events)], "k string, ts timestamp_ntz, id int, e string, v double")
    none = dict.fromkeys(["event_types", "field", "aggregation", "operator", "threshold", "conditions", "sequence", "enabled"])
    table = [
        none | {"rule_id": "sum", "kind": "aggregation", "priority": 1, "field": "v", "threshold": 25.0},
        none | {"rule_id": "count", "kind": "aggregation", "priority": 3, "field": "v", "aggregation": "count", "operator": "eq", "threshold": 2.0},
        none | {"rule_id": "any", "kind": "threshold", "priority": 3, "field": "v", "operator": "lt", "threshold": 3.0, "event_types": ["a"]},
        none | {"rule_id": "both", "kind": "conditional", "priority": None, "conditions": [("v", "gt", 15.0), ("v", "lte", 5.0)]},
        none | {"rule_id": "ac", "kind": "sequence", "priority": 2, "sequence": ["a", "c"]},
        none | {"rule_id": "empty", "kind": "sequence", "priority": 0, "sequence": []},
        none | {"rule_id": "off", "kind": "sequence", "priority": 9, "sequence": [], "enabled": False},
        none | {"rule_id": "nothing", "kind": "aggregation", "priority": 9, "field": None, "threshold": 1.0},
    ]
    names = ["rule_id", "kind", "priority", "enabled", "event_types", "field", "aggregation", "operator", "threshold", "conditions", "sequence"]
    make = lambda rows: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], rules.SCHEMA)
    run = lambda rows: rules.execute(df, make(rows), ["k"], "ts", "id", "e")
    got = {}
    for r in sorted(run(table).collect(), key=lambda r: r.place):
        got.setdefault(r.k, []).append((r.rule_id, r.priority))
    assert got == {
        "u": [("count", 3), ("ac", 2), ("sum", 1), ("both", 0), ("empty", 0)],
        "v": [("any", 3), ("count", 3), ("empty", 0)],
        None: [("sum", 1), ("empty", 0)],
        "w": [("empty", 0)],
    }
    assert run([]).count() == 0
    for wrong in ({"kind": "other"}, {"kind": "threshold", "operator": "like", "field": "v", "threshold": 1.0}, {"kind": "aggregation", "aggregation": "mode", "field": "v", "threshold": 1.0}):
        with pytest.raises(ValueError, match="rule x"):
            run([none | {"rule_id": "x", "priority": 1} | wrong])
    with pytest.raises(ValueError, match="over 2"):
        rules.execute(df, make(table), ["k"], "ts", "id", "e", most=2)
