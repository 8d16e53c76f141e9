"""Isolation forest, density clusters, one-class machine and their vote against numpy, brute force and planted outliers; components and depths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltaic.operators import detectors, graphs, privacy
from voltaic.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{c} double" for c in "abc"[: len(rows[0])]))


def path(forest, tree, row, node=0, depth=0):
    """One row's path through one tree, by recursion."""
    k = forest.feature[tree, node]
    if k < 0:
        return forest.length[tree, node]
    return path(forest, tree, row, 2 * node + (1 if row[k] < forest.split[tree, node] else 2), depth + 1)


def test_forest_scores_are_those_of_its_trees(spark):
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(size=(700, 2)), [[9.0, 9.0], [-8.0, 7.0], [0.0, 11.0]]])
    df = frame(spark, rows.tolist())
    odd = spark.createDataFrame([(5000, None, 1.0), (5001, float("nan"), 1.0)], df.schema)
    grown = detectors.forest(df, "id", ["a", "b"], trees=40, sample=64)
    got = {r.id: r for r in detectors.isolation_forest(df.union(odd), "id", ["a", "b"], trees=40, sample=64, contamination=0.05).collect()}
    c = 2 * (math.log(63) + 0.5772156649015329) - 2 * 63 / 64
    for i in (0, 5, 700, 702):
        assert got[i].score == pytest.approx(2 ** (-np.mean([path(grown, t, rows[i]) for t in range(40)]) / c))
    assert {700, 701, 702} <= set(sorted(range(703), key=lambda i: -got[i].score)[:10])
    assert got[5000].score is None and not got[5000].is_anomaly and got[5001].score is None
    assert sum(r.is_anomaly for r in got.values()) == math.ceil(0.05 * 702)
    assert detectors.isolation_forest(df.limit(0), "id", ["a", "b"]).count() == 0
    same = frame(spark, [[1.0, 2.0]] * 5)
    assert not any(r.is_anomaly for r in detectors.isolation_forest(same, "id", ["a", "b"]).collect())


def by_definition(points, eps, least):
    """(cluster, core) of each place."""
    n = len(points)
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    core = (far <= eps).sum(1) >= least
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if core[i] and core[j] and far[i, j] <= eps and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    names = {r: min(i for i in range(n) if core[i] and root[i] == r) for r in {root[i] for i in range(n) if core[i]}}
    out = []
    for i in range(n):
        near = [(far[i, j], j) for j in range(n) if core[j] and far[i, j] <= eps]
        out.append((names[root[i]] if core[i] else names[root[min(near)[1]]] if near else None, bool(core[i])))
    return out


@pytest.mark.parametrize(("d", "eps", "pointwise"), [(1, 0.05, 4096), (2, 0.3, 4096), (2, 0.3, 1), (3, 0.6, 4)])
def test_density_clusters_are_those_of_all_pairs(spark, monkeypatch, d, eps, pointwise):
    monkeypatch.setattr(detectors, "POINTWISE", pointwise)  # 1: dense cells are told apart by boxes alone
    rng = np.random.default_rng(d)
    points = np.concatenate([rng.normal(size=(150, d)) * 0.3, rng.normal(size=(60, d)) * 0.2 + 2, rng.uniform(-4, 4, size=(60, d)), np.zeros((30, d))])
    names = list("abc"[:d])
    got = {r.id: r for r in detectors.dbscan(frame(spark, points.tolist()), "id", names, eps, 5).collect()}
    want = by_definition(points, eps, 5)
    assert [(got[i].cluster, got[i].is_core) for i in range(len(points))] == want
    assert all(r.is_anomaly == (r.cluster is None) for r in got.values()) and 1 < len({c for c, _ in want}) < 100


def test_density_query_on_all_readings(spark):
    from voltaic.plans import detection

    rows = detection.placed(spark, SF).toPandas().sort_values("event_id").reset_index(drop=True)
    full = rows.dropna().reset_index(drop=True)
    want = by_definition(full[["volts", "amps"]].to_numpy(), 0.1, 5)
    got = {r.event_id: (r.cluster, r.is_core, r.is_anomaly) for r in QUERIES["density_clusters"](spark, SF).collect()}
    assert len(got) == len(rows) > len(full)
    ids = full.event_id.tolist()
    assert all(got[i] == (None if c is None else ids[c], core, c is None) for i, (c, core) in zip(ids, want, strict=True))
    assert all(got[i] == (None, False, False) for i in set(rows.event_id) - set(ids))


def objective(z, w, rho, nu):
    return w @ w / 2 - rho + np.maximum(0, rho - z @ w).mean() / nu


def test_one_class_reaches_the_least_objective(spark):
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.normal(size=(400, 2)), rng.uniform(-9, 9, size=(12, 2))])
    df = frame(spark, rows.tolist())
    nu = 0.1
    model = detectors.one_class(df, "id", ["a", "b"], nu)
    z = model.features(rows)
    w, rho, best = np.zeros(64), 0.0, math.inf
    for k in range(1, 40_001):  # plain subgradient steps, the best objective kept
        pull = (rho - z @ w > 0) / (nu * len(z))
        w, rho = w - (w - pull @ z) / (5 + 0.02 * k), rho - (pull.sum() - 1) / (200 + k)
        if k % 50 == 0:
            best = min(best, objective(z, w, np.quantile(z @ w, nu), nu))
    own = objective(z, model.weights, np.quantile(z @ model.weights, nu), nu)
    assert own <= best + 0.01 * abs(best) and own < 0
    got = {r.id: r for r in detectors.one_class_machine(df, "id", ["a", "b"], nu).collect()}
    assert sum(r.is_anomaly for r in got.values()) == pytest.approx(nu * len(rows), abs=1)
    far = [i for i in range(len(rows)) if np.abs(rows[i]).max() > 4.5]
    assert len(far) > 5 and all(got[i].is_anomaly for i in far)
    assert detectors.one_class_machine(df.limit(0), "id", ["a", "b"]).count() == 0


def test_votes(spark):
    df = spark.range(4).withColumnRenamed("id", "k")
    of = lambda ids: spark.createDataFrame([(i, i in ids) for i in range(3)], "k long, is_anomaly boolean")
    got = {r.k: (r.votes, r.is_anomaly) for r in detectors.vote(df, "k", {"x": (of({0, 1}), 0.4), "y": (of({1, 2}), 0.3), "z": (of({0, 2}), 0.3)}).collect()}
    assert got == {0: (0.7, True), 1: (0.7, True), 2: (0.6, True), 3: (0.0, False)}
    rows = QUERIES["anomaly_vote"](spark, SF).collect()
    assert all(r.is_anomaly == (0.4 * bool(r.by_forest) + 0.3 * bool(r.by_machine) + 0.3 * bool(r.by_density) >= 0.5 - 1e-9) for r in rows) and 0 < sum(r.is_anomaly for r in rows) < len(rows) / 4


def test_components_of_a_graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(7000, 7000)] + [(5000, k) for k in range(5001, 5050)]
    root = {v: v for e in edges for v in e}
    for a, b in edges * 2:
        if root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if r == high else r for k, r in root.items()}
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_longest_paths(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d"), ("p", "q"), ("q", "p"), ("q", "r"), ("a", "r"), ("s", "s"), ("a", "b")]
    got = {r.node: r.depth for r in graphs.depths(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {"a": 0, "x": 0, "b": 1, "c": 2, "d": 3, "p": None, "q": None, "r": None, "s": None}
    assert graphs.depths(spark.createDataFrame([], "a string, b string")).agg(F.count("*")).first()[0] == 0


def test_lineage_goes_to_its_end(spark):
    """Deeper than ten steps, through a cycle."""
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(14)] + [("14", "0")], "source string, target string")
    got = privacy.impact(edges, spark.createDataFrame([("0",), ("9",), ("x",)], "node string")).collect()
    assert {r.start: (r.downstream, r.depth) for r in got} == {"0": (14, 14), "9": (14, 14), "x": (0, 0)}
    assert privacy.impact(edges, spark.createDataFrame([("0",)], "node string"), depth=3).first().downstream == 3
