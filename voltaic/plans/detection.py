"""Queries of unsupervised detectors, held against brute force and numpy in tests: models and labels that SQL can't express."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltaic.operators import detectors, steps
from voltaic.plans.readings import readings
from voltaic.plans.registry import query

NAMES = ["voltage_v", "current_a", "temperature_c"]


def measured(spark, sf_dir):
    return readings(spark, sf_dir).select("event_id", *NAMES)


def placed(spark, sf_dir):
    """Readings in two scaled columns."""
    volts, current = ((F.col("voltage_v") - 230) / 10).alias("volts"), (F.col("current_a") / 5).alias("amps")
    return readings(spark, sf_dir).select("event_id", volts, current)


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    out = detectors.isolation_forest(measured(spark, sf_dir), "event_id", NAMES)
    return out.select("event_id", F.round("score", 9).alias("score"), "is_anomaly")


@query("density_clusters")
def density_clusters(spark, sf_dir):
    return detectors.dbscan(placed(spark, sf_dir), "event_id", ["volts", "amps"], eps=0.1, min_points=5).select("event_id", "cluster", "is_core", "is_anomaly")


@query("one_class_machine")
def one_class_machine(spark, sf_dir):
    out = detectors.one_class_machine(measured(spark, sf_dir), "event_id", NAMES)
    return out.select("event_id", F.round("score", 6).alias("score"), "is_anomaly")


@query("anomaly_vote")
def anomaly_vote(spark, sf_dir):
    """Forest, machine and clusters vote with weights 0.4, 0.3 and 0.3."""
    df = steps.cut(measured(spark, sf_dir))
    votes = {
        "by_forest": (detectors.isolation_forest(df, "event_id", NAMES), 0.4),
        "by_machine": (detectors.one_class_machine(df, "event_id", NAMES), 0.3),
        "by_density": (density_clusters(spark, sf_dir), 0.3),
    }
    return detectors.vote(df.select("event_id"), "event_id", votes).select("event_id", *votes, "votes", "is_anomaly")
