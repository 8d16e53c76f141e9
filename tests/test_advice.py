"""Cases from review."""

from voltaic.operators import learning, windows


def test_global_outliers_keep_null_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, 2.0), (4, 2.0), (5, None), (6, 9.0)], "id int, x double")
    got = {r.id: (r.z is None, r.pct_rank, r.is_iqr_outlier is None) for r in windows.global_outliers(df, "x").collect()}
    assert got == {1: (True, None, True), 2: (False, 0.25, False), 3: (False, 0.625, False), 4: (False, 0.625, False), 5: (True, None, True), 6: (False, 1.0, False)}


def test_component_drift_reports_every_component(spark):
    rows = [(float(i % 7), float(i % 5), float(i % 3)) for i in range(105)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r.component: r.ks for r in learning.component_drift(df, df, ["a", "b", "c"]).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0}
