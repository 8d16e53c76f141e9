"""Sources, sinks, streaming and small fixtures of operators that SQL can't hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from voltaic.functions import energy, ladders, text
from voltaic.operators import cep, drift, joins, quality, sourcing
from voltaic.sources import registry
from voltaic.streaming import jobs

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("kwh,label", [(0.0, "ZERO_CONSUMPTION"), (0.09, "VERY_LOW"), (0.1, "LOW"), (1.0, "MEDIUM"), (10.0, "HIGH"), (50.0, "VERY_HIGH"), (None, "VERY_HIGH")])
def test_consumption_ladder(spark, kwh, label):
    assert one(spark, ladders.consumption_category(F.lit(kwh).cast("double"))) == label


def test_nulls_pass_checks(spark):
    assert one(spark, ladders.in_range(F.lit(None).cast("double"), 0, 1)) is True
    assert one(spark, ladders.quality_flag({"a": F.lit(None).cast("boolean"), "b": F.lit(False)})) == "INVALID_B"
    assert one(spark, ladders.completeness([F.lit(1), F.lit(None)])) == "PARTIAL"
    assert one(spark, energy.utilization(F.lit(5), F.lit(0))) is None


def test_text_cleaning(spark):
    assert one(spark, text.synonyms(F.lit(" tou "), text.TARIFFS)) == "TIME_OF_USE"
    assert one(spark, text.boolean(F.lit("Yes "))) is True and one(spark, text.boolean(F.lit("maybe"))) is None
    assert one(spark, text.list_field(F.lit("a|b"), "|")) == ["a", "b"]
    assert one(spark, text.clean_number(F.lit(" 12.5 "))) == 12.5 and one(spark, text.clean_number(F.lit("x"))) == 0.0
    assert one(spark, text.is_meter_id(F.lit("MET-NOR-R-000001"))) is True


def test_weekend_nights_as_published_and_intended(spark):
    assert one(spark, energy.demand_period(F.lit(3), F.lit(0))) == "OFF_PEAK_WEEKDAY"
    assert one(spark, energy.demand_period(F.lit(3), F.lit(0), intended=True)) == "OFF_PEAK_WEEKEND"


def test_sequence_skips_others(spark):
    rows = [(1, i, k) for i, k in enumerate("AXBCA")] + [(2, i, k) for i, k in enumerate("CBA")]
    got = {r.k: r.matched for r in cep.sequence(spark.createDataFrame(rows, "k int, t int, e string"), ["k"], "t", "t", "e", ["A", "B", "C"]).collect()}
    assert got == {1: 3, 2: 1}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k int, ts timestamp_ntz, v double")
    assert joins.interval_join(e, e.select("k", F.col("ts").alias("t2"), F.col("v").alias("v2")), ["k"], "ts", "t2", 5, "full").count() == 0
    assert cep.cyclic(e, ["k"], "ts", 60, 1.0).count() == 0
    assert quality.profile(e, ["k"], {"v": (0, 1)}).first()["total"] == 0
    assert drift.kolmogorov_smirnov(e, e, "v").first()["ks"] is None


def test_fills_and_conflicts(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5.0), (1, 3, None)], "k int, t int, v double")
    assert [r.v for r in quality.forward_fill(df, "v", ["k"], ["t"]).orderBy("t").collect()] == [None, 5.0, 5.0]
    assert [r.v for r in quality.backward_fill(df, "v", ["k"], ["t"]).orderBy("t").collect()] == [5.0, 5.0, None]
    store = spark.createDataFrame([(1, 1), (1, 2)], "k int, version long")
    new = spark.createDataFrame([(1, 2), (2, 1)], "k int, expected_version long")
    assert [r.k for r in sourcing.conflicts(store, new, ["k"]).collect()] == [2]
    assert sourcing.migration_path({(1, 2), (2, 3), (1, 4)}, 1, 3) == [1, 2, 3]
    with pytest.raises(ValueError):
        sourcing.migration_path({(1, 2)}, 1, 3)


def test_ab_variant_follows_md5(spark):
    import hashlib

    keys = [f"key{i}" for i in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", drift.ab_variant(F.col("k"), "t", 0.3).alias("v"))
    for r in df.collect():
        assert r.v == ("B" if int(hashlib.md5(f"{r.k}_t".encode()).hexdigest(), 16) % 100 / 100 < 0.3 else "A")


@pytest.mark.parametrize("kind", ["csv", "json", "parquet", "orc"])
def test_round_trips(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    registry.write(df, f"{tmp_path}/x", kind, **({"header": True} if kind == "csv" else {}))
    assert sorted(map(tuple, registry.read(spark, kind, path=f"{tmp_path}/x", schema="id int, name string").collect()), key=str) == [(1, "a"), (2, None)]


def test_source_errors_and_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        registry.read(spark, "nothing")
    with pytest.raises(ValueError):
        registry.check_csv({"delimiter": "||"})

    def fails(df):
        raise RuntimeError("full")

    got = registry.write_all(spark.range(3), {"a": lambda d: registry.write(d, f"{tmp_path}/a"), "b": fails})
    assert got["a"] == "success" and got["b"].startswith("failed")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    source = jobs.stream(spark, f"{tmp_path}/in", events.schema, "ts")
    got = jobs.windowed(source, "ts", ["user_id"], "value", "1 day", late="60 days")
    query = got.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = events.groupBy("user_id", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    assert spark.table("daily").agg(F.count("*"), F.sum("n")).first() == batch.agg(F.count("*"), F.sum("n")).first()


def test_late_rows_are_dropped(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    for m in (0, 50, 51, 1):  # the last batch lies behind the watermark
        spark.createDataFrame([(1, t(m), 1.0)], "k int, ts timestamp, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = jobs.stream(spark, f"{tmp_path}/in", "k int, ts timestamp, v double", "ts", files_a_batch=1)
    got = jobs.drain(jobs.windowed(source, "ts", ["k"], "v", "5 minutes", late="1 minute"), f"{tmp_path}/out").collect()
    assert [(r.start.minute, r.n) for r in got] == [(0, 1)]


def test_running_state(spark, tmp_path):
    rows = [(1, float(v)) for v in (10, 10, 11, 9, 100)]
    spark.createDataFrame(rows, "k int, v double").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("k int, v double").parquet(f"{tmp_path}/in")
    got = {r.v: r.z for r in jobs.drain(jobs.running_zscore(source, "k", "v"), f"{tmp_path}/out").collect()}
    assert got[100.0] > 10 and len(got) == 4
