"""Unsupervised detectors of anomalies over numeric columns: isolation forest, DBSCAN, one-class machine, and their vote.

Rows with a null or NaN in one of the columns are left without a score, and are no anomaly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltaic.operators import graphs, ranks, steps

_EULER = 0.5772156649015329


def _complete(columns: list[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return ok


def _vector(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# ---- isolation forest


def path_correction(n: np.ndarray) -> np.ndarray:
    """The mean depth at which n rows would be told apart by a random tree."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(n - 1) + _EULER) - 2 * (n - 1) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Random split trees in arrays, (trees, nodes) each: the children of node i are 2 i + 1 and 2 i + 2."""

    def __init__(self, samples: list[np.ndarray], seed: int):
        rng = np.random.default_rng(seed)
        self.sample = max((len(s) for s in samples), default=0)
        self.depth = max(1, math.ceil(math.log2(max(2, self.sample))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full((len(samples), nodes), -1, np.int32)
        self.split = np.zeros((len(samples), nodes))
        self.length = np.zeros((len(samples), nodes))  # of a path that ends there
        for t, rows in enumerate(samples):
            self._grow(t, 0, 0, rows, rng)

    def _grow(self, tree: int, node: int, depth: int, rows: np.ndarray, rng: np.random.Generator) -> None:
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        varied = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) < 2 or not len(varied):
            self.length[tree, node] = depth + path_correction(np.array(len(rows)))
            return
        k = int(rng.choice(varied))
        at = rng.uniform(low[k], high[k])
        self.feature[tree, node], self.split[tree, node] = k, at
        left = rows[:, k] < at
        self._grow(tree, 2 * node + 1, depth + 1, rows[left], rng)
        self._grow(tree, 2 * node + 2, depth + 1, rows[~left], rng)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected one): near 1 for rows that few splits set apart."""
        total, place = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, length in zip(self.feature, self.split, self.length, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                k = feature[node]
                right = rows[place, np.maximum(k, 0)] >= split[node]
                node = np.where(k >= 0, 2 * node + 1 + right, node)
            total += length[node]
        expected = float(path_correction(np.array(self.sample)))
        return 2.0 ** (-total / max(1, len(self.feature)) / expected) if expected else np.full(len(rows), 0.5)


def forest(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> Forest:
    """A forest grown from the table: each tree has its own rows, drawn without repetition, sample of them at most.

    trees * sample rows come to the driver, whatever the table's size: those with the smallest hashes of their keys. If
    the table holds fewer, each tree draws from all of them.
    """
    rows = df.filter(_complete(columns)).select(_vector(columns).alias("v"), F.xxhash64(F.lit(seed), key).alias("u"))
    drawn = rows.orderBy("u", "v").limit(trees * sample).toArrow()
    pool = _matrix(drawn.column(0).combine_chunks(), len(columns))
    if len(pool) == trees * sample:
        samples = [pool[t::trees] for t in range(trees)]
    else:
        rng = np.random.default_rng(seed + 1)
        samples = [pool[rng.permutation(len(pool))[:sample]] for _ in range(trees)]
    return Forest(samples, seed)


def _scored(df: DataFrame, columns: list[str], score, name: str) -> DataFrame:
    """df with the column name: score(rows) of rows without nulls in columns."""
    kept, ok = df.columns, _complete(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(len(kept))
            here = vectors.is_valid().to_numpy(zero_copy_only=False)
            out = np.full(batch.num_rows, np.nan)
            if here.any():
                out[here] = score(_matrix(vectors.drop_null(), len(columns)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.float64(), mask=~here)], [*kept, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.select(*kept, F.when(ok, _vector(columns)).alias("_v")).mapInArrow(run, schema)


def _over_quantile(df: DataFrame, score: str, share: float, flag: str) -> DataFrame:
    """df with flag: whether the score is over the quantile above which share of the rows lie."""
    df = steps.cut(df)
    bound = ranks.quantiles(df, score, [1 - share]).select(F.col("q")[0].alias("_bound"))  # one row
    return df.crossJoin(F.broadcast(bound)).withColumn(flag, F.coalesce(F.col(score) > F.col("_bound"), F.lit(False))).drop("_bound")


def isolation_forest(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """df with score and is_anomaly: the share contamination of all rows with the highest scores."""
    grown = forest(df, key, columns, trees, sample, seed)
    return _over_quantile(_scored(df, columns, grown.scores, "score"), "score", contamination, "is_anomaly")


# ---- DBSCAN

#: Pairs of sub-cells with so many pairs of points at most are compared point by point, the others split further.
POINTWISE = 4096


def _near_cells(d: int) -> list[tuple[int, ...]]:
    """Offsets of cells of width 1 / sqrt(d) that hold points within distance 1, a cell itself aside."""
    reach = math.ceil(math.sqrt(d))
    gap = lambda o: sum(max(0, abs(k) - 1) ** 2 for k in o) / d
    return [o for o in product(range(-reach, reach + 1), repeat=d) if any(o) and gap(o) <= 1]


def _shifted(cell: str, d: int) -> Column:
    """The cells near a cell."""
    return F.explode(F.array(*[F.array(*[F.col(cell)[i] + o[i] for i in range(d)]) for o in _near_cells(d)]))


def _square(a: str, b: str, d: int) -> Column:
    return sum(((F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(d)), F.lit(0.0))


def _linked_cells(core: DataFrame, eps: float, d: int) -> DataFrame:
    """(a, b): adjacent cells with core points within eps of each other.

    Cells are halved again and again. Of two sub-cells the boxes around their points tell whether all, or none, of their points
    are within eps; what they don't tell is split once more, or compared point by point once there are few. So two
    dense cells are never compared pair by pair.
    """
    width = eps / math.sqrt(d)
    corner = lambda pick, sub: F.array(*[pick(F.col("v")[i]) for i in range(d)]).alias(sub)

    def boxes(points: DataFrame) -> DataFrame:
        return points.groupBy("cell", "sub").agg(corner(F.min, "low"), corner(F.max, "high"), F.count("*").alias("n"))

    side = lambda table, s: table.select(*[F.col(c).alias(f"{c}_{s}") for c in table.columns])
    points = core.select("cell", "v", F.lit(0).cast("long").alias("sub"))
    table = steps.cut(boxes(points))
    pairs = side(table, "a").withColumn("cell_b", _shifted("cell_a", d)).filter(F.col("cell_a") < F.col("cell_b")).join(side(table, "b"), "cell_b")
    found, level = None, 0
    while True:
        least = sum((F.pow(F.greatest(F.lit(0.0), F.col("low_a")[i] - F.col("high_b")[i], F.col("low_b")[i] - F.col("high_a")[i]), 2) for i in range(d)), F.lit(0.0))
        most = sum((F.pow(F.greatest(F.col("high_a")[i] - F.col("low_b")[i], F.col("high_b")[i] - F.col("low_a")[i]), 2) for i in range(d)), F.lit(0.0))
        judged = steps.cut(pairs.select("cell_a", "sub_a", "cell_b", "sub_b", "n_a", "n_b", least.alias("least"), most.alias("most")).filter(F.col("least") <= eps * eps))
        sure = judged.filter(F.col("most") <= eps * eps).select("cell_a", "cell_b").distinct()
        open_ = judged.join(sure, ["cell_a", "cell_b"], "left_anti")
        few = open_.filter(F.col("n_a") * F.col("n_b") <= POINTWISE)
        near = few.join(side(points.select("cell", "sub", "v"), "a"), ["cell_a", "sub_a"]).join(side(points.select("cell", "sub", "v"), "b"), ["cell_b", "sub_b"])
        near = near.filter(_square("v_a", "v_b", d) <= eps * eps).select("cell_a", "cell_b").distinct()
        now = steps.cut(sure.union(near).distinct())
        found = now if found is None else found.union(now)
        open_ = steps.cut(open_.filter(F.col("n_a") * F.col("n_b") > POINTWISE).join(now, ["cell_a", "cell_b"], "left_anti").select("cell_a", "sub_a", "cell_b", "sub_b"))
        if open_.isEmpty():
            return found.select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b")).distinct()
        level += 1
        # which half of its sub-cell a point lies in, by dimension
        bits = sum((F.pmod(F.floor(F.col("v")[i] / (width / 2**level)), F.lit(2)).cast("long") * 2**i for i in range(d)), F.lit(0).cast("long"))
        of = lambda s: F.struct(F.col(f"cell_{s}").alias("cell"), F.col(f"sub_{s}").alias("sub"))
        wanted = open_.select(F.explode(F.array(of("a"), of("b"))).alias("x")).select("x.*").distinct()
        points = steps.cut(points.join(wanted, ["cell", "sub"]).select("cell", "v", F.col("sub").alias("above"), (F.col("sub") * 2**d + bits).alias("sub")))
        table = steps.cut(points.groupBy("cell", "above", "sub").agg(corner(F.min, "low"), corner(F.max, "high"), F.count("*").alias("n")))
        up = lambda s: side(table, s).withColumnRenamed(f"above_{s}", f"up_{s}")  # noqa: E731, B023
        pairs = open_.withColumnRenamed("sub_a", "up_a").withColumnRenamed("sub_b", "up_b").join(up("a"), ["cell_a", "up_a"]).join(up("b"), ["cell_b", "up_b"])


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """df with cluster, is_core and is_anomaly: density-based clusters of rows by the Euclidean distance of one to four columns.

    A core row has min_points rows, itself among them, within eps; core rows within eps of each other are of one
    cluster, named by its smallest key of a core row; a row with core rows within eps, but not core itself, is of the nearest one's
    cluster (ties to the smaller key); all others are noise: no cluster, and anomalies. Keys are unique.

    In cells of width eps / sqrt(d) all rows are within eps of each other, so a cell of min_points rows is all core without a comparison. Only the rows
    of sparser cells, fewer than min_points a cell, meet those of the cells near, which is linear in the table; cells join to
    clusters by boxes and rounds of contraction.
    """
    d = len(columns)
    if not 1 <= d <= 4 or not eps > 0:
        raise ValueError("one to four columns, and a positive eps")
    width = eps / math.sqrt(d)
    kept, ok = df.columns, _complete(columns)
    rows = df.filter(ok).select(F.col(key).alias("k"), _vector(columns).alias("v")).withColumn("cell", F.transform("v", lambda x: F.floor(x / width).cast("long")))
    rows = steps.cut(rows)
    sizes = steps.cut(rows.groupBy("cell").agg(F.count("*").alias("n")))
    rows = steps.cut(rows.join(sizes, "cell"))
    sparse = rows.filter(F.col("n") < min_points).select("k", "v", "cell", "n")
    asks = sparse.select("k", "v", F.explode(F.array(F.col("cell"))).alias("cell")).union(sparse.select("k", "v", _shifted("cell", d).alias("cell")))
    partner = rows.select("cell", F.col("k").alias("other"), F.col("v").alias("w"), (F.col("n") >= min_points).alias("dense"))
    near = asks.join(partner, "cell").select("k", "other", "dense", _square("v", "w", d).alias("far")).filter(F.col("far") <= eps * eps)
    near = steps.cut(near)
    cores = near.groupBy("k").agg(F.count("*").alias("met")).filter(F.col("met") >= min_points).select("k")
    cores = steps.cut(cores)
    core = steps.cut(rows.filter(F.col("n") >= min_points).select("k", "v", "cell").union(sparse.join(cores, "k").select("k", "v", "cell")))
    cells = core.select("cell").distinct()
    roots = graphs.components(_linked_cells(core, eps, d))
    root = cells.join(roots.withColumnRenamed("node", "cell"), "cell", "left").select("cell", F.coalesce("root", "cell").alias("root"))
    of_core = steps.cut(core.select("k", "cell").join(root, "cell").select("k", "root"))
    names = of_core.groupBy("root").agg(F.min("k").alias("cluster"))
    of_core = steps.cut(of_core.join(names, "root").select("k", "cluster"))
    border = near.join(cores, "k", "left_anti").join(of_core.select(F.col("k").alias("other"), "cluster"), "other")
    border = border.groupBy("k").agg(F.min_by("cluster", F.struct("far", "other")).alias("cluster"))
    told = of_core.withColumn("is_core", F.lit(True)).unionByName(border.withColumn("is_core", F.lit(False)))
    out = df.join(told.withColumnRenamed("k", "_k"), df[key] == F.col("_k"), "left")
    return out.select(*[df[c] for c in kept], "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core"), (ok & F.col("cluster").isNull()).alias("is_anomaly"))


# ---- one-class machine


class OneClass:
    """A linear one-class machine over random Fourier features of a Gaussian kernel."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, gamma: float, features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.centre, self.scale = centre, np.where(scale > 0, scale, 1.0)
        self.turns = rng.normal(size=(len(centre), features)) * math.sqrt(2 * gamma)
        self.shift = rng.uniform(0, 2 * math.pi, features)
        self.weights, self.rho = np.zeros(features), 0.0

    def features(self, rows: np.ndarray) -> np.ndarray:
        return math.sqrt(2 / len(self.shift)) * np.cos((rows - self.centre) / self.scale @ self.turns + self.shift)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Over zero inside, under it outside."""
        return self.features(rows) @ self.weights - self.rho


def _sums(rows: DataFrame, width: int, model: OneClass, bend: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Over all rows: the sums of the losses' gradients, of their second derivatives, and of the losses, in (weights, rho)."""
    size = len(model.shift) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, curve, lost = np.zeros(size), np.zeros((size, size)), 0.0
        for batch in batches:
            z = model.features(_matrix(batch.column(0), width))
            short = model.rho - z @ model.weights
            moves = np.hstack([-z, np.ones((len(z), 1))])  # of what a row is short by
            slope += np.clip(short / bend + 0.5, 0, 1) @ moves
            bent = moves[np.abs(short) < bend / 2]
            curve += bent.T @ bent / bend
            lost += np.where(short > bend / 2, short, np.where(short < -bend / 2, 0, (short + bend / 2) ** 2 / (2 * bend))).sum()
        total = np.concatenate([slope, curve.ravel(), [lost]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])

    got = rows.select("v").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    return got[:size], got[size:-1].reshape(size, size), float(got[-1])


def one_class(df: DataFrame, key: str, columns: list[str], nu: float = 0.1, features: int = 64, rounds: int = 30, most_rows: int = 1_000_000, seed: int = 42) -> OneClass:
    """The machine for a table: 1/2 |w|^2 - rho + mean of max(0, rho - w z) / nu is made least by Newton steps, each from sums over the rows.

    Columns are centred on their medians and divided by their quartile ranges; the kernel's gamma is 1 over columns and
    mean variance of what results. Steps run over most_rows rows at most (by hash of the key), medians, quartiles and
    variances over all. The hinge is rounded off over a width of 0.02; features have length 1, about. The driver gets (features + 1) ** 2 numbers a step.
    """
    d = len(columns)
    rows = df.filter(_complete(columns)).select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = steps.cut(rows)
    bounds = [ranks.quantiles(rows, f"c{i}", [0.25, 0.5, 0.75]).first().q for i in range(d)]
    if bounds[0][0] is None:
        return OneClass(np.zeros(d), np.ones(d), 1.0, features, seed)
    centre, scale = np.array([q[1] for q in bounds]), np.array([q[2] - q[0] for q in bounds])
    scale = np.where(scale > 0, scale, 1.0)
    spread, n = rows.agg(F.array(*[F.var_pop(f"c{i}") for i in range(d)]).alias("s"), F.count("*")).first()
    gamma = 1 / (d * max(1e-12, float(np.mean(np.array(spread) / scale**2))))
    model = OneClass(centre, scale, gamma, features, seed)
    share = min(1.0, most_rows / n)
    used = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    used = steps.cut(used.select(F.array(*[f"c{i}" for i in range(d)]).alias("v")))
    m, bend = used.count(), 0.02

    def judged(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        model.weights, model.rho = x[:-1], float(x[-1])
        slope, curve, lost = _sums(used, d, model, bend)
        own = np.append(x[:-1], -1.0)
        return float(x[:-1] @ x[:-1] / 2 - x[-1] + lost / (nu * m)), own + slope / (nu * m), np.diag(np.append(np.ones(features), 1e-9)) + curve / (nu * m)

    # at rho far above every margin each row pulls fully: the mean of the features is the best w for that
    model.weights, model.rho = np.zeros(features), 10.0
    mean = -_sums(used, d, model, bend)[0][:-1] / m
    x = np.append(mean, mean @ mean)
    value, slope, curve = judged(x)
    for _ in range(rounds):
        way = np.linalg.solve(curve, -slope)
        if -slope @ way < 1e-9:
            break
        length = min(1.0, 0.5 / max(1e-12, float(np.linalg.norm(way))))
        while True:
            new = judged(x + length * way)
            if new[0] <= value + 1e-4 * length * (slope @ way) or length < 1e-4:
                break
            length /= 2
        if new[0] > value:
            break
        x = x + length * way
        value, slope, curve = new
    model.weights, model.rho = x[:-1], float(x[-1])
    return model


def one_class_machine(df: DataFrame, key: str, columns: list[str], nu: float = 0.1, **how) -> DataFrame:
    """df with score, how far outside a row is, and is_anomaly: rho is the bound that leaves the share nu of all rows outside,
    which for given weights is the best one."""
    model = one_class(df, key, columns, nu, **how)
    return _over_quantile(_scored(df, columns, lambda rows: -model.margins(rows), "score"), "score", nu, "is_anomaly")


def vote(df: DataFrame, key: str, votes: dict[str, tuple[DataFrame, float]], least: float = 0.5) -> DataFrame:
    """df with a column for each detector, the weighted share of those that call a row an anomaly, and is_anomaly: least or more.
    votes: a frame (key, is_anomaly) and a weight for each."""
    out, total = df, sum(w for _, w in votes.values())
    for name, (frame, _) in votes.items():
        out = out.join(frame.select(key, F.col("is_anomaly").alias(name)), key, "left")
    share = sum((F.when(F.col(n), F.lit(w)).otherwise(0.0) for n, (_, w) in votes.items()), F.lit(0.0)) / total
    return out.withColumn("votes", F.round(share, 9)).withColumn("is_anomaly", F.col("votes") >= least)
