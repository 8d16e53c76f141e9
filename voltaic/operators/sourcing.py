"""Event sourcing on append-only tables: versions, replays, projections, optimistic appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltaic.operators import steps


def versioned(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Events numbered from 1 within their aggregate."""
    return df.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def between(df: DataFrame, after: int, upto: int) -> DataFrame:
    return df.filter((F.col("version") > after) & (F.col("version") <= upto))


def project(df: DataFrame, keys: list[str], order: list[str], latest: dict[str, str], more: dict[str, Column] | None = None) -> DataFrame:
    """The state of each aggregate: the last value of some fields, the number of events, further aggregates. One pass."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, at).alias(n) for n, c in latest.items()], F.count("*").alias("version"), *[c.alias(n) for n, c in (more or {}).items()])


def conflicts(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates of new (keys, expected_version) whose stored version is another; one without events has version 0."""
    now = store.groupBy(*keys).agg(F.max("version").alias("stored"))
    return new.join(now, keys, "left").withColumn("stored", F.coalesce("stored", F.lit(0))).filter("stored <> expected_version")


def append(store: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts): new events, which state the version they expect (expected_version), numbered on from it
    where the store has just that, and the aggregates where it has another. Of a batch's events of one aggregate all go
    in or none; whoever appends writes accepted before the next append reads the store."""
    refused = conflicts(store, new.select(*keys, "expected_version").distinct(), keys)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") + F.col("expected_version")
    return new.join(refused.select(*keys).distinct(), keys, "left_anti").withColumn("version", number).drop("expected_version"), refused


def with_status(events: DataFrame, updates: DataFrame, key: str, status: str = "status") -> DataFrame:
    """events with the status that updates (key, status) gives; others keep theirs. An update of an unknown event does nothing."""
    new = updates.select(key, F.col(status).alias("_new"))
    return events.join(new, key, "left").withColumn(status, F.coalesce("_new", status)).select(*events.columns)


def rewrite(spark: SparkSession, path: str, by: str, change: Callable[[DataFrame], DataFrame], touched: list) -> None:
    """Apply change (an update of states, a deletion) to the partitions of a table at path whose column by is in touched;
    the others aren't read or written. What is written is cut from what is read. A crash on the way leaves each partition as it was or as it
    should be, and rows of emptied ones alive: run it again, which for changes of states and deletions gives the same."""
    part = spark.read.parquet(path).filter(F.col(by).isin(touched))
    done = steps.cut(change(part))
    empty = set(touched) - {r[0] for r in done.select(by).distinct().collect()}
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for value in empty:  # nothing is left of these
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def migration_path(edges: set[tuple[int, int]], start: int, goal: int, hops: int = 10) -> list[int]:
    """Versions from start to goal: straight if there is such an edge, else by the smallest next version."""
    path = [start]
    while path[-1] != goal:
        here = path[-1]
        step = goal if (here, goal) in edges else min((b for a, b in edges if a == here and b > here), default=None)
        if step is None or len(path) > hops:
            raise ValueError(f"no path from version {start} to {goal}")
        path.append(step)
    return path
