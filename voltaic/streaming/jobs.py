"""Structured Streaming: event-time windows, interval joins and state, with watermarks for late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema, ts: str, files_a_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; times without zone become timestamps, as watermarks need."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(df: DataFrame, ts: str, keys: list[str], value: str, size: str, slide: str | None = None, late: str = "15 seconds") -> DataFrame:
    """Count, sum, mean, least and greatest by key and tumbling or sliding window; later rows than late are dropped."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.withWatermark(ts, late).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "mean", "low", "high")


def sessions(df: DataFrame, ts: str, keys: list[str], gap: str, late: str = "15 seconds") -> DataFrame:
    out = df.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, right_key: str, left_ts: str, right_ts: str, seconds: int, late: str = "15 seconds", how: str = "inner") -> DataFrame:
    """Pairs of equal keys at most seconds apart; both watermarks and the range let Spark drop old state."""
    a, b = left.withWatermark(left_ts, late), right.withWatermark(right_ts, late)
    near = F.expr(f"{right_ts} BETWEEN {left_ts} - INTERVAL {seconds} SECONDS AND {left_ts} + INTERVAL {seconds} SECONDS")
    return a.join(b, (F.col(key) == F.col(right_key)) & near, how)


def running_zscore(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, z) of each row against the key's running mean and deviation, kept as state (count, mean, squares)."""

    def score(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, squares = state.get if state.exists else (0, 0.0, 0.0)
        for part in parts:
            x = part[value].dropna().to_numpy(float)
            if not len(x):
                continue
            # running sums of the batch around its first value, joined to the state as two samples are
            shift = x[0]
            own_n = np.arange(1, len(x) + 1)
            own_mean = np.cumsum(x - shift) / own_n
            own_squares = np.maximum(0.0, np.cumsum((x - shift) ** 2) - own_n * own_mean**2)
            gap = own_mean + shift - mean
            ns = n + own_n
            means = mean + gap * own_n / ns
            sums = squares + own_squares + gap**2 * n * own_n / ns
            before_n, before_mean, before_squares = np.r_[n, ns[:-1]], np.r_[mean, means[:-1]], np.r_[squares, sums[:-1]]
            deviation = np.sqrt(before_squares / np.maximum(1, before_n - 1)) * (before_n > 1)
            z = np.where(deviation > 0, np.abs(x - before_mean) / np.where(deviation > 0, deviation, 1), 0.0)
            yield pd.DataFrame({key: keys[0], value: x, "z": z})
            n, mean, squares = int(ns[-1]), float(means[-1]), float(sums[-1])
        state.update((n, mean, squares))

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(score, f"{key} {kind}, {value} double, z double", "n long, mean double, squares double", "append", GroupStateTimeout.NoTimeout)


def upsert(keys: list[str], order: str, path: str, buckets: int | None = None, whole: bool = False) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the latest row of each key, as a new version of the table at path; a batch again changes nothing.

    Keys lie in buckets, as many as the session has shuffle partitions when the table begins (or buckets); a table keeps its number. A version
    holds the buckets that its batch touched and names, for all others, the version that holds them, so a batch rewrites only what it
    touches. whole: each batch is all there is (complete mode), and nothing of the version before stays. A batch builds on the
    latest version before it, whatever its number; a new checkpoint over a table that has later versions is refused, as it would lose them.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = versions(spark, path)
        if any(v > number for v in known):
            raise ValueError(f"{path} holds version {max(known)}, batch {number} comes after it: take a new folder for a new checkpoint")
        before = max((v for v in known if v < number), default=None)
        held, count = ({}, None) if before is None else places(spark, path, before)
        count = count or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = lambda df: df.withColumn("upsert_bucket", F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int"))
        keyed = dealt(batch).persist()
        touched = [r.upsert_bucket for r in keyed.select("upsert_bucket").distinct().collect()]
        held = {} if whole else held
        old = [f"{path}/version={v}/upsert_bucket={b}" for b, v in held.items() if b in touched]
        rows = keyed if not old else keyed.unionByName(dealt(spark.read.schema(batch.schema).parquet(*old)))
        others = [c for c in batch.columns if c not in keys]
        latest = rows.groupBy("upsert_bucket", *keys).agg(F.max_by(F.struct(*others), order).alias("r")).select("upsert_bucket", *keys, "r.*")
        latest.write.mode("overwrite").partitionBy("upsert_bucket").parquet(f"{path}/version={number}")
        now = held | dict.fromkeys(touched, number)
        spark.createDataFrame([(b, v, count) for b, v in sorted(now.items())], "bucket int, at long, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/places={number}")
        keyed.unpersist()

    return run


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of the table at path: those whose list of places is written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/places=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("places=")) for f in found)


def places(spark: SparkSession, path: str, version: int) -> tuple[dict[int, int], int | None]:
    """Of each bucket, the version that holds it; and how many buckets there are, None if none holds a row."""
    rows = spark.read.parquet(f"{path}/places={version}").collect()
    return {r.bucket: r.at for r in rows}, rows[0].buckets if rows else None


def current(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table at path as its latest version has it; without a version or a row, an empty one of that schema."""
    known = versions(spark, path)
    held = places(spark, path, known[-1])[0] if known else {}
    if not held:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{path}/version={v}/upsert_bucket={b}" for b, v in held.items()])


def scored_patterns(df: DataFrame, ts: str, keys: list[str], kind: str, size: str, rules: dict[str, Column], late: str = "15 seconds") -> DataFrame:
    """Each rule, an aggregate condition on a key's events of a window, as a boolean: patterns and rules on a stream."""
    out = df.withWatermark(ts, late).groupBy(*keys, F.window(ts, size).alias("w")).agg(F.count(kind).alias("n"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()])
    return out.select(*keys, F.col("w.start").alias("start"), "n", *rules)


def scored(df: DataFrame, model, columns: list[str]) -> DataFrame:
    """A fitted pipeline's predictions on a stream; rows with a null in one of its columns are left out."""
    return model.transform(df.dropna(subset=columns))


def settle(df: DataFrame, keys: list[str], order: str, path: str, mode: str = "update") -> DataFrame:
    """Run a stream over what is there, its latest row of each key into the table at path, and return that. In complete
    mode a batch takes the place of the whole table: what it no longer has, as a session that grew and begins earlier, is gone."""
    spark = df.sparkSession
    query = df.writeStream.outputMode(mode).foreachBatch(upsert(keys, order, path, whole=mode == "complete")).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return current(spark, path, df.schema)


def drain(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet at path, and return that."""
    spark = df.sparkSession
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(df.schema).parquet(path)
