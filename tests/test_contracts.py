"""Payload and schema contracts on small fixtures."""

import pytest
from pyspark.sql import functions as F

from voltaic.operators import contracts


@pytest.mark.parametrize(
    "payload,fits",
    [('{"a": "x", "n": 1}', True), ('{"a": null}', False), ('{"n": 1}', False), ('{"a": "x", "n": 1.5}', False), ('{"a": "x", "n": true}', True), ('{"a": "x", "o": {"z": 1}}', True), ('{"a": "x", "o": [1]}', False), ("[1]", False), ("{", False), ("", False), (None, False)],
)
def test_payloads(spark, payload, fits):
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(contracts.payload_fits(F.col("p"), ["a"], {"a": "string", "n": "integer", "o": "object", "q": "other"})).first()[0] is fits


def test_compatibility():
    assert contracts.compatibility(["a"], ["a"]) == "FORWARD_COMPATIBLE"
    assert contracts.compatibility(["a"], ["a", "b"]) == contracts.compatibility(["a", "b"], ["a"]) == contracts.compatibility(None, ["a"]) == "BREAKING_CHANGE"
    assert contracts.compatibility(["a"], ["b"], migration=True) == "MIGRATION_REQUIRED"


def test_migrated(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (None, 5), (1, None)], "version int, x int")
    steps = {(1, 2): {"x": F.col("x") + 1}, (2, 3): {"x": F.col("x") * 10, "y": F.lit("new")}}
    assert [tuple(r) for r in contracts.migrated(df, steps, 3).collect()] == [(3, 60, "new"), (3, 50, "new"), (3, 5, None), (None, 5, None), (3, None, "new")]
    with pytest.raises(ValueError):
        contracts.migrated(df, {(1, 2): {}}, 3)


def test_schema_differences(spark):
    a, b = spark.createDataFrame([], "x int, y string, z date").schema, spark.createDataFrame([], "x long, y string, w int").schema
    assert contracts.schema_differences(a, b) == {"missing": ["w"], "extra": ["z"], "mismatched": ["x"]}


def test_column_tests_of_an_empty_table_and_nulls(spark):
    tests = lambda df: {(r["column"], r["test"]): r["violations"] for r in contracts.column_tests(df, ["a"], {"b": ["x"]}, {"a": (0, 1)}, ["a"]).collect()}
    rows = [(1, "x"), (1, "y"), (None, None), (None, "x"), (7, None)]
    assert tests(spark.createDataFrame(rows, "a int, b string")) == {("a", "not_null"): 2, ("b", "accepted_values"): 1, ("a", "between"): 1, ("a", "unique"): 1}
    assert set(tests(spark.createDataFrame([], "a int, b string")).values()) == {0}
