"""Features and models with MLlib, and trends of series."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltaic.operators import drift, ranks


def prepared(df: DataFrame, columns: list[str], features: str = "features") -> Pipeline:
    """An unfitted pipeline: medians for nulls, one vector, mean 0 and deviation 1."""
    filled = [f"{c}_filled" for c in columns]
    return Pipeline(stages=[Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol=features, withMean=True)])


def forecaster(columns: list[str], label: str, depth: int = 4, rounds: int = 10) -> Pipeline:
    """Boosted trees on lag features; rows without a label or a feature are left out by the caller."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), GBTRegressor(featuresCol="features", labelCol=label, maxDepth=depth, maxIter=rounds, seed=1)])


def errors(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    gap = F.col(label) - F.col(prediction)
    return df.agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def clipped(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values held within two percentiles of the column, which are one row."""
    bounds = ranks.quantiles(df, column, [low, high]).withColumnRenamed("q", "_b")
    return df.crossJoin(F.broadcast(bounds)).withColumn(column, F.greatest(F.col("_b")[0], F.least(F.col("_b")[1], F.col(column)))).drop("_b")


def series_trend(df: DataFrame, keys: list[str], index: str, value: str, flat: float = 0.01) -> DataFrame:
    """Slope, fit and direction of each key's series, and its relative spread."""
    out = df.groupBy(*keys).agg(F.regr_slope(value, index).alias("slope"), F.regr_r2(value, index).alias("r2"), F.try_divide(F.stddev(value), F.avg(value)).alias("volatility"))
    return out.withColumn("direction", F.when(F.col("slope") > flat, "improving").when(F.col("slope") < -flat, "declining").otherwise("stable"))


def nearest_fill(df: DataFrame, column: str, by: str, keys: list[str], order: str, k: int = 5) -> DataFrame:
    """Nulls become the mean of the k nearest known values of their key, near by the column by; ties to smaller distance, then value.

    Along one column the k nearest known rows are among the k on either side in its order, so no pairs are formed. Rows
    whose by is null, and keys without a known value, keep their null. order must be unique.
    """
    w = Window.partitionBy(*keys).orderBy(by, order)
    known = F.when(F.col(column).isNotNull() & F.col(by).isNotNull(), F.struct(F.col(by).cast("double").alias("x"), F.col(column).alias("v")))
    # every row carries the known rows' running number; the k before and after are then joined from the known rows alone
    ranked = df.withColumns({"_known": known, "_n": F.count(known).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    table = ranked.filter("_known is not null").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_n").alias("_m"), "_known")
    empty = ranked.filter(F.col(column).isNull() & F.col(by).isNotNull()).drop("_known")
    wanted = empty.withColumn("_m", F.explode(F.sequence(F.col("_n") - (k - 1), F.col("_n") + k)))
    same = wanted["_m"] == table["_m"]
    for i, c in enumerate(keys):
        same &= wanted[c].eqNullSafe(table[f"_k{i}"])
    near = F.struct(F.abs(F.col("_known.x") - F.col(by)).alias("d"), F.col("_known.v").alias("v"))
    found = wanted.join(table, same).groupBy(order).agg(F.slice(F.array_sort(F.collect_list(near)), 1, k).alias("_near"))
    mean = F.aggregate("_near", F.lit(0.0), lambda a, x: a + x["v"]) / F.size("_near")
    return df.join(found.select(order, mean.alias("_fill")), order, "left").withColumn(column, F.coalesce(column, "_fill")).drop("_fill")


def classifier(kind: str, columns: list[str], label: str) -> Pipeline:
    """A failure predictor (forest, boosted or logistic) over columns without nulls; label is 0 or 1."""
    kinds = {
        "forest": lambda: RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=20, maxDepth=5, seed=1),
        "boosted": lambda: GBTClassifier(featuresCol="features", labelCol=label, maxIter=10, maxDepth=4, seed=1),
        "logistic": lambda: LogisticRegression(featuresCol="features", labelCol=label, maxIter=50),
    }
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), kinds[kind]()])


def probability(df: DataFrame, name: str = "risk") -> DataFrame:
    """The probability of label 1 as a column, from a classifier's output."""
    return df.withColumn(name, vector_to_array("probability")[1])


def best_features(columns: list[str], label: str, k: int) -> Pipeline:
    """The k columns that explain a continuous label best one by one; nulls count as 0, which the caller fills."""
    pick = UnivariateFeatureSelector(featuresCol="_all", labelCol=label, outputCol="features", selectionMode="numTopFeatures")
    pick.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(k)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_all"), pick])


def encoded(columns: list[str]) -> Pipeline:
    """One-hot vectors of category columns; unknown categories get a place of their own."""
    index = StringIndexer(inputCols=columns, outputCols=[f"{c}_index" for c in columns], handleInvalid="keep")
    return Pipeline(stages=[index, OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}_vector" for c in columns])])


def cluster_distances(df: DataFrame, columns: list[str], k: int = 4, limit: float = 3.0) -> DataFrame:
    """Anomalies by distance: each row's distance to its cluster's centre in scaled features, and whether it is over limit deviations of all distances."""
    scaled = prepared(df, columns).fit(df).transform(df)
    model = KMeans(k=k, seed=1, featuresCol="features", predictionCol="cluster").fit(scaled)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    gaps = F.zip_with(vector_to_array("features"), F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b))
    out = model.transform(scaled).withColumn("distance", F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x)))
    stats = out.agg(F.avg("distance").alias("_m"), F.stddev("distance").alias("_s"))  # one row
    return out.crossJoin(F.broadcast(stats)).withColumn("is_anomaly", F.coalesce(F.col("distance") > F.col("_m") + F.col("_s") * limit, F.lit(False))).select(*df.columns, "cluster", "distance", "is_anomaly")


def mahalanobis(df: DataFrame, first: str, second: str) -> DataFrame:
    """The Mahalanobis distance of two columns' values from their means; null where either is, or they don't vary."""
    both = F.col(first).isNotNull() & F.col(second).isNotNull()
    pair = lambda c: F.when(both, F.col(c))
    stats = df.agg(F.avg(pair(first)).alias("_ma"), F.avg(pair(second)).alias("_mb"), F.var_samp(pair(first)).alias("_va"), F.var_samp(pair(second)).alias("_vb"), F.covar_samp(pair(first), pair(second)).alias("_c"))
    a, b = F.col(first) - F.col("_ma"), F.col(second) - F.col("_mb")
    square = F.try_divide(a * a * F.col("_vb") - 2 * a * b * F.col("_c") + b * b * F.col("_va"), F.col("_va") * F.col("_vb") - F.col("_c") * F.col("_c"))
    return df.crossJoin(F.broadcast(stats)).withColumn("distance", F.sqrt(square)).select(*df.columns, "distance")


def component_drift(reference: DataFrame, current: DataFrame, columns: list[str], components: int | None = None) -> DataFrame:
    """(component, ks): how far two samples differ along the principal components of the scaled reference; all, up to 10, by default."""
    components = min(10, len(columns)) if components is None else components
    fit = Pipeline(stages=[*prepared(reference, columns).getStages(), PCA(k=components, inputCol="features", outputCol="_parts")]).fit(reference)
    parts = lambda df: fit.transform(df).select(vector_to_array("_parts").alias("_p"))
    one = lambda i: drift.kolmogorov_smirnov(parts(reference).select(F.col("_p")[i].alias("x")), parts(current).select(F.col("_p")[i].alias("x")), "x").withColumn("component", F.lit(i))
    out = one(0)
    for i in range(1, components):
        out = out.unionByName(one(i))
    return out


def ensemble(predictions: dict[str, float]) -> Column:
    """The weighted mean of prediction columns; a null one leaves its weight to the others."""
    held = [(F.col(c), w) for c, w in predictions.items()]
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in held[1:]), F.when(held[0][0].isNotNull(), F.lit(held[0][1])).otherwise(0.0))
    added = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in held[1:]), F.coalesce(held[0][0] * held[0][1], F.lit(0.0)))
    return F.try_divide(added, total)


def risk_portfolio(df: DataFrame, factors: dict[str, tuple[Column, float]]) -> DataFrame:
    """(factor, probability, impact, risk) of each factor, a condition and its impact; null conditions don't hold. One pass."""
    n = F.count("*")
    one = df.agg(F.array(*[F.struct(F.lit(name).alias("factor"), F.coalesce(F.try_divide(F.count_if(test), n), F.lit(0.0)).alias("probability"), F.lit(impact).alias("impact")) for name, (test, impact) in factors.items()]).alias("_f"))
    return one.select(F.explode("_f").alias("f")).select("f.*", (F.col("f.probability") * F.col("f.impact")).alias("risk"))
