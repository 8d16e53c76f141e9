"""Every registered query with SQL gives what DuckDB gives."""

import pytest
from compare import connect, difference

from voltaic.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) is None


def test_the_others_are_models():
    """Queries without SQL fit models or find clusters; test_models.py, test_detectors.py and test_series.py hold them against numpy, brute force and bounds."""
    models = {"failure_risk", "forecast_errors", "component_drift", "cluster_anomalies", "selected_features"}
    assert QUERIES.keys() - ORACLE_SQL.keys() == models | {"isolation_forest", "density_clusters", "one_class_machine", "anomaly_vote", "arima_errors", "seasonal_errors"}
